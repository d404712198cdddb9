"""Queries for the join operators (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.wma import WMA, Naive
from ..operators import enrich, evaluate
from ..sources.tables import brand_panel, brand_sales, cents, region_panel, scan
from . import inputs as i
from . import model_sql as ms
from .events_sql import EVENTS_US, INTERVALS, intervals, us_events
from .registry import query


@query("j1_inner_join", i.with_sql(i.REGION, i.WEATHER) + """SELECT series_id, r.ds, y, round(temperature, 6) AS temperature, rainfall
  FROM region_panel r JOIN weather w ON r.ds = w.ds""")
def j1(spark: SparkSession, folder: str) -> DataFrame:
    out = enrich.join_factor(region_panel(spark, folder), i.weather(spark, folder))
    return out.select("series_id", "ds", "y", F.round("temperature", 6).alias("temperature"), "rainfall")


def _daily(source: str, expr: str) -> str:
    return f"(SELECT ds, {expr} AS v FROM {source} GROUP BY ds)"


@query("j2_regressors", i.with_sql(i.REGION, i.PROMOTIONS, i.MEDIA, i.HOLIDAYS, i.EVENTS) + f"""SELECT series_id, r.ds, y,
  coalesce(p.v, 0) AS promo_discount, coalesce(round(m.v, 2), 0) AS media_spend, coalesce(h.v - 1, 0) AS holiday_impact,
  coalesce(e.v - 1, 0) AS event_impact FROM region_panel r
  LEFT JOIN {_daily('promotions', 'max(discount)')} p ON p.ds = r.ds LEFT JOIN {_daily('media_plan', 'sum(media_spend)')} m ON m.ds = r.ds
  LEFT JOIN {_daily('holidays', 'max(holiday_impact)')} h ON h.ds = r.ds LEFT JOIN {_daily('promo_events', 'max(event_impact)')} e ON e.ds = r.ds""")
def j2(spark: SparkSession, folder: str) -> DataFrame:
    out = enrich.align_regressors(region_panel(spark, folder), i.factors(spark, folder))
    return out.withColumn("media_spend", cents(F.col("media_spend")))


_HOT = ", ".join(
    f'coalesce({how}(CASE WHEN {col} = \'{v}\' THEN 1.0::DOUBLE ELSE 0 END), 0) AS "{kind}_{col}_{v}"'
    for kind, col, how, vs in [("promotions", "promo_type", "sum", "ANR")] for v in vs)


@query("j3_wide_factors", i.with_sql(i.REGION, *i.FACTOR_SQL) + f"""SELECT series_id, r.ds, y,
  coalesce(promotions_discount, 0) AS promotions_discount, coalesce("promotions_promo_type_A", 0) AS "promotions_promo_type_A",
  coalesce(media_plan_media_spend, 0) AS media_plan_media_spend, coalesce(media_plan_reach, 0) AS media_plan_reach,
  coalesce(holidays_holiday_impact, 0) AS holidays_holiday_impact, coalesce(events_event_impact, 0) AS events_event_impact,
  coalesce(round(weather_temperature, 6), 0) AS weather_temperature, coalesce(weather_rainfall, 0) AS weather_rainfall,
  coalesce(competitor_competitor_price, 0) AS competitor_competitor_price,
  coalesce("competitor_competitor_name_N", 0) AS "competitor_competitor_name_N", coalesce(economic_confidence, 0) AS economic_confidence
  FROM region_panel r
  LEFT JOIN (SELECT ds, round(sum(discount), 2) AS promotions_discount, {_HOT} FROM promotions GROUP BY 1) p ON p.ds = r.ds
  LEFT JOIN (SELECT ds, round(sum(media_spend), 2) AS media_plan_media_spend, sum(reach) AS media_plan_reach FROM media_plan GROUP BY 1) m ON m.ds = r.ds
  LEFT JOIN (SELECT ds, max(holiday_impact) AS holidays_holiday_impact FROM holidays GROUP BY 1) h ON h.ds = r.ds
  LEFT JOIN (SELECT ds, max(event_impact) AS events_event_impact FROM promo_events GROUP BY 1) e ON e.ds = r.ds
  LEFT JOIN (SELECT ds, avg(temperature) AS weather_temperature, avg(rainfall) AS weather_rainfall FROM weather GROUP BY 1) w ON w.ds = r.ds
  LEFT JOIN (SELECT ds, round(avg(competitor_price), 6) AS competitor_competitor_price,
    round(avg(CASE WHEN competitor_name = 'N' THEN 1.0 ELSE 0.0 END), 8) AS "competitor_competitor_name_N" FROM competitor GROUP BY 1) c ON c.ds = r.ds
  LEFT JOIN (SELECT ds, avg(confidence) AS economic_confidence FROM economic GROUP BY 1) k ON k.ds = r.ds""")
def j3(spark: SparkSession, folder: str) -> DataFrame:
    out = enrich.attach_factors(region_panel(spark, folder), i.factors(spark, folder))
    rounded = {
        "promotions_discount": 2, "media_plan_media_spend": 2, "weather_temperature": 6,
        "competitor_competitor_price": 6, "competitor_competitor_name_N": 8,
    }
    out = out.withColumns({c: F.round(c, d) for c, d in rounded.items()})
    return out.select(
        "series_id", "ds", "y", "promotions_discount", "promotions_promo_type_A", "media_plan_media_spend", "media_plan_reach",
        "holidays_holiday_impact", "events_event_impact", "weather_temperature", "weather_rainfall",
        "competitor_competitor_price", "competitor_competitor_name_N", "economic_confidence",
    )


@query("j4_flags", i.with_sql(i.REGION, i.PROMOTIONS, i.HOLIDAYS, i.EVENTS) + """SELECT series_id, ds, y,
  CAST(ds IN (SELECT ds FROM promotions) AS DOUBLE) AS promotions_flag, CAST(ds IN (SELECT ds FROM holidays) AS DOUBLE) AS holidays_flag,
  CAST(ds IN (SELECT ds FROM promo_events) AS DOUBLE) AS events_flag FROM region_panel""")
def j4(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {k: f(spark, folder) for k, f in [("promotions", i.promotions), ("holidays", i.holidays), ("events", i.promo_events)]}
    return enrich.attach_flags(region_panel(spark, folder), kinds)


@query("j5_flags_asof", i.with_sql(i.REGION, i.HOLIDAYS, i.EVENTS, """counts AS (SELECT ds, count(*) FILTER (WHERE k = 'h') AS h,
  count(*) FILTER (WHERE k = 'e') AS e FROM (SELECT ds, 'h' AS k FROM holidays UNION ALL SELECT ds, 'e' FROM promo_events) GROUP BY 1)""") + """
  SELECT series_id, r.ds, y, coalesce(h, 0) AS holidays_flag, coalesce(e, 0) AS events_flag FROM region_panel r ASOF LEFT JOIN counts c ON r.ds >= c.ds""")
def j5(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {"holidays": i.holidays(spark, folder), "events": i.promo_events(spark, folder)}
    return enrich.attach_flags_asof(i.regions(spark, folder), kinds)


DAILY_EVENTS = """daily_events AS (SELECT event_id, event_name, series_id,
  CAST(unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM intervals),
one_event AS (SELECT series_id, ds, event_id, event_name FROM daily_events
  QUALIFY row_number() OVER (PARTITION BY series_id, ds ORDER BY event_id, event_name) = 1)"""


@query("j6_event_join", i.with_sql(i.BRAND, INTERVALS, DAILY_EVENTS) + """SELECT b.series_id, b.ds, y, event_id, event_name
  FROM brand_panel b LEFT JOIN one_event e ON b.series_id = e.series_id AND b.ds = e.ds""")
def j6(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.events import explode_intervals

    daily = explode_intervals(intervals(spark, folder), ["series_id"])
    panel = brand_panel(spark, folder).select("series_id", "ds", "y")
    return enrich.attach_events(panel, daily, ["series_id"])


BACKTEST = [
    """bt_sized AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, count(*) OVER s AS n,
      max(ds) OVER s AS last_day, min(ds) OVER s AS first_day FROM region_panel WINDOW s AS (PARTITION BY series_id))""",
    """bt_split AS (SELECT series_id, ds, y, CASE WHEN size > 0 AND n > size + 5 AND last_day - size > first_day THEN
        CASE WHEN ds >= last_day - size AND idx >= 5 THEN 'test' ELSE 'train' END END AS split FROM (
        SELECT *, CAST(CASE WHEN n > 50 THEN greatest(1, floor(n * 0.2)) ELSE 0 END AS INTEGER) AS size FROM bt_sized))""",
    "bt_train AS (SELECT series_id, ds, y FROM bt_split WHERE split = 'train')",
    "bt_test AS (SELECT series_id, ds, y FROM bt_split WHERE split = 'test')",
]


@query("j7_forecast_actual", i.with_sql(i.REGION, *BACKTEST, *ms.wma("bt_train", 400)) + """SELECT f.series_id, f.ds,
  round(yhat, 4) AS yhat, y FROM wma_forecast f JOIN bt_test t ON f.series_id = t.series_id AND f.ds = t.ds""")
def j7(spark: SparkSession, folder: str) -> DataFrame:
    split = evaluate.backtest_split(i.regions(spark, folder))
    model = WMA()
    forecast = model.forecast(model.fit(split.filter("split = 'train'").drop("split")), 400)
    out = enrich_match(forecast, split.filter("split = 'test'"))
    return out.select("series_id", "ds", F.round("yhat", 4).alias("yhat"), "y")


def enrich_match(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    return evaluate.match_actuals(forecast, actual)


@query("j8_event_windows", i.with_sql(i.REGION, EVENTS_US) + """SELECT series_id, e.ds AS event_ds, name,
  round(avg(CASE WHEN r.ds < e.ds THEN y END), 7) AS baseline, count(CASE WHEN r.ds < e.ds THEN y END) AS baseline_rows,
  round(avg(CASE WHEN r.ds >= e.ds THEN y END), 7) AS during, count(CASE WHEN r.ds >= e.ds THEN y END) AS event_rows
  FROM us_events e JOIN region_panel r ON r.ds BETWEEN e.ds - 21 AND e.ds + 1 GROUP BY 1, 2, 3""")
def j8(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    out = enrich.window_means(us_events(panel).select(F.col("ds").alias("event_ds"), "name"), panel)
    return out.withColumns({"baseline": F.round("baseline", 7), "during": F.round("during", 7)})


@query("j9_chart_rows", i.with_sql(i.REGION, *BACKTEST, *ms.wma("bt_train", 30), *ms.naive("region_panel", 10), *ms.wma("region_panel", 10, name="base")) + """
  SELECT coalesce(a.series_id, f.series_id) AS series_id, coalesce(a.ds, f.ds) AS ds, a.y AS actual,
  round(coalesce(b.yhat, f.yhat), 4) AS yhat, round(coalesce(b.lower_ci, f.lower_ci), 4) AS lower_ci,
  round(coalesce(b.upper_ci, f.upper_ci), 4) AS upper_ci, round(base.yhat, 4) AS baseline
  FROM region_panel a FULL OUTER JOIN naive_forecast f ON a.series_id = f.series_id AND a.ds = f.ds
  FULL OUTER JOIN wma_forecast b ON coalesce(a.series_id, f.series_id) = b.series_id AND coalesce(a.ds, f.ds) = b.ds
  LEFT JOIN base_forecast base ON coalesce(a.series_id, f.series_id) = base.series_id AND coalesce(a.ds, f.ds) = base.ds
  WHERE coalesce(a.series_id, f.series_id) IS NOT NULL
  UNION ALL SELECT b.series_id, b.ds, NULL, round(b.yhat, 4), round(b.lower_ci, 4), round(b.upper_ci, 4), NULL FROM wma_forecast b
  WHERE NOT EXISTS (SELECT 1 FROM region_panel a WHERE a.series_id = b.series_id AND a.ds = b.ds)
    AND NOT EXISTS (SELECT 1 FROM naive_forecast a WHERE a.series_id = b.series_id AND a.ds = b.ds)""")
def j9(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    train = evaluate.backtest_split(panel).filter("split = 'train'").drop("split")
    wma, naive = WMA(), Naive()
    out = enrich.chart_rows(
        panel, naive.forecast(naive.fit(panel), 10), wma.forecast(wma.fit(panel), 10), wma.forecast(wma.fit(train), 30)
    )
    return out.select("series_id", "ds", "actual", *[F.round(c, 4).alias(c) for c in ("yhat", "lower_ci", "upper_ci", "baseline")])


@query("j10_scenarios", i.with_sql(i.REGION, *ms.wma("region_panel", 10), *ms.naive("region_panel", 14)) + """
  SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.ds, b.ds) AS ds, round(a.yhat, 4) AS original, round(b.yhat, 4) AS scenario,
  round(b.yhat - a.yhat, 4) AS difference, round(coalesce((b.yhat - a.yhat) / abs(a.yhat) * 100, 0), 6) AS change_pct
  FROM wma_forecast a FULL OUTER JOIN naive_forecast b ON a.series_id = b.series_id AND a.ds = b.ds""")
def j10(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    wma, naive = WMA(), Naive()
    out = enrich.compare_scenarios(wma.forecast(wma.fit(panel), 10), naive.forecast(naive.fit(panel), 14))
    return out.select("series_id", "ds", *[F.round(c, 4).alias(c) for c in ("original", "scenario", "difference")],
                      F.round("change_pct", 6).alias("change_pct"))


PLAN = """plan AS (SELECT p_brand AS series_id, CAST(l_shipdate + INTERVAL 60 DAY AS DATE) AS ds,
  CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END AS promo_flag, l_discount AS discount, l_orderkey * 10 + l_linenumber AS no,
  l_returnflag AS note FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 25),
first_plan AS (SELECT * FROM plan QUALIFY row_number() OVER (PARTITION BY series_id, ds ORDER BY no, discount, note) = 1)"""


def plan(spark: SparkSession, folder: str) -> DataFrame:
    """Future promotions: shipped lines of high quantity, 60 days on."""
    lines = scan(spark, folder, "lineitem").filter(F.col("l_quantity") >= 25)
    part = scan(spark, folder, "part").select("p_partkey", "p_brand")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("series_id"), F.date_add(F.to_date("l_shipdate"), 60).alias("ds"),
        (F.col("l_discount") >= 0.08).cast("int").alias("promo_flag"), F.col("l_discount").alias("discount"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("no"), F.col("l_returnflag").alias("note"),
    )


@query("j11_plan_lookup", i.with_sql(i.BRAND, PLAN) + """SELECT b.series_id, b.ds, y, p.promo_flag, p.discount FROM brand_panel b
  LEFT JOIN first_plan p ON b.series_id = p.series_id AND b.ds = p.ds""")
def j11(spark: SparkSession, folder: str) -> DataFrame:
    targets = brand_panel(spark, folder).select("series_id", "ds", "y")
    out = enrich.lookup(targets, plan(spark, folder), ["series_id", "ds"], ["no", "discount", "note"])
    return out.select("series_id", "ds", "y", "promo_flag", "discount")


@query("j12_event_lookup", i.with_sql(i.BRAND, INTERVALS, DAILY_EVENTS) + """SELECT b.series_id, b.ds, event_name
  FROM brand_panel b JOIN one_event e ON b.series_id = e.series_id AND b.ds = e.ds""")
def j12(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.events import explode_intervals

    daily = explode_intervals(intervals(spark, folder), ["series_id"])
    targets = brand_panel(spark, folder).select("series_id", "ds")
    out = enrich.lookup(targets, daily, ["series_id", "ds"], ["event_id", "event_name"])
    return out.filter(F.col("event_name").isNotNull()).select("series_id", "ds", "event_name")


@query("j13_candidates", i.with_sql(i.REGION) + """SELECT series_id, CAST(candidate AS INTEGER) AS candidate, CAST(w AS INTEGER) AS window, fold, count(*) AS rows FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM region_panel)
  CROSS JOIN (SELECT unnest([0, 1, 2]) AS candidate, unnest([4, 8, 20]) AS w) CROSS JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range(5))
  WHERE idx < 14 + (fold + 1) * least(7, greatest(1, (n - 14) // 6)) GROUP BY 1, 2, 3, 4""")
def j13(spark: SparkSession, folder: str) -> DataFrame:
    grid = [{"window": w} for w in (4, 8, 20)]
    rows = enrich.with_candidates(evaluate.cv_folds(region_panel(spark, folder)), grid)
    return rows.groupBy("series_id", "params.candidate", "params.window", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query("j14_hierarchy", """SELECT l_returnflag AS flag, p_type AS category, p_brand AS brand, count(*) AS lines, round(sum(l_extendedprice), 2) AS y
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
def j14(spark: SparkSession, folder: str) -> DataFrame:
    # one row per part and flag before the join, so a hot part is small when shuffled
    sales = scan(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("flag")).agg(
        F.sum("l_extendedprice").alias("y"), F.count(F.lit(1)).alias("lines")
    )
    hierarchy = scan(spark, folder, "part").select("p_partkey", F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    return enrich.with_hierarchy(sales, hierarchy, "p_partkey").groupBy("flag", "category", "brand").agg(
        F.sum("lines").alias("lines"), cents(F.sum("y")).alias("y")
    )
