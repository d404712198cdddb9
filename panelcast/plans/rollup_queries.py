"""Queries for the aggregation (A), ranking (L) and union (U) operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import period_label
from ..models.wma import WMA, Naive
from ..models.base import with_baseline
from ..operators import evaluate, grid, ranking, rollup
from ..sources.tables import brand_panel, brand_sales, cents, event_panel, region_panel, region_sales, scan
from . import inputs as i
from . import model_sql as ms
from .registry import query


@query("a1_daily_totals", """SELECT CAST(o_orderdate AS DATE) AS ds, round(sum(o_totalprice), 2) AS y
  FROM orders GROUP BY 1""")
def a1(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "orders").select(F.to_date("o_orderdate").alias("ds"), F.col("o_totalprice").alias("y"))
    return rollup.daily_totals(rows)


@query("a2_category_series", i.with_sql(i.PRODUCT) + """SELECT series_id, category, brand, ds, y FROM (
  SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM (
    SELECT category || ' ||| ' || brand AS series_id, category, brand, ds, y FROM product_sales
    UNION ALL SELECT '(all)', NULL, NULL, ds, round(sum(y), 2) FROM product_sales GROUP BY ds))
  WHERE n >= 20""")
def a2(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.category_series(brand_sales(spark, folder), ["category", "brand"])


@query("a3_daily_numeric_totals", """SELECT CAST(l_shipdate AS DATE) AS ds,
  round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_quantity), 2) AS l_quantity,
  round(sum(l_tax), 2) AS l_tax FROM lineitem GROUP BY 1""")
def a3(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("ds"), "l_returnflag", "l_extendedprice", "l_quantity", "l_tax"
    )
    return rollup.daily_numeric_totals(rows)


_LABELS = {
    "W": "CAST(ds + CAST(7 - isodow(ds) AS INTEGER) AS DATE)",
    "F": "CAST(first_ds + CAST(floor((ds - first_ds) / 14) * 14 AS INTEGER) AS DATE)",
    "M": "last_day(ds)",
    "Q": "CAST(date_trunc('quarter', ds) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)",
    "Y": "CAST(date_trunc('year', ds) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE)",
}


@query("a4_time_rollup", i.with_sql(i.REGION, """first AS (SELECT *,
  min(ds) OVER (PARTITION BY series_id) AS first_ds FROM region_panel)""") + " UNION ALL ".join(
  f"SELECT series_id, '{f}' AS freq, {label} AS ds, round(sum(y), 2) AS y FROM first GROUP BY 1, 3"
  for f, label in _LABELS.items()))
def a4(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    parts = [rollup.time_rollup(panel, f).withColumn("freq", F.lit(f)) for f in _LABELS]
    return ranking.union_all(parts).withColumn("y", cents(F.col("y")))


@query("a5_product_rollup", i.with_sql(i.PRODUCT) + """SELECT category, brand, last_day(ds) AS period,
  round(sum(y), 2) AS y, round(sum(units), 2) AS units,
  CAST(2 - grouping(category) - grouping(brand) AS INTEGER) AS depth
  FROM product_sales GROUP BY GROUPING SETS ((3), (category, 3), (category, brand, 3))""".replace("(3)", "(period)").replace(", 3)", ", period)"))
def a5(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.hierarchy_rollup(
        brand_sales(spark, folder), ["category", "brand"], F.last_day("ds"), ["y", "units"]
    )


@query("a6_region_rollup", i.with_sql(i.STORE) + """SELECT region, store, last_day(ds) AS period,
  round(sum(y), 2) AS y, CAST(2 - grouping(region) - grouping(store) AS INTEGER) AS depth
  FROM store_sales GROUP BY GROUPING SETS ((period), (region, period), (region, store, period))""")
def a6(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.hierarchy_rollup(region_sales(spark, folder), ["region", "store"], F.last_day("ds"))


@query("a7_aggregate_choice", """SELECT o_orderpriority AS priority, last_day(CAST(o_orderdate AS DATE)) AS month,
  round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean,
  round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1, 2""")
def a7(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("priority"),
        F.last_day(F.to_date("o_orderdate")).alias("month"), F.col("o_totalprice").alias("v"),
    )
    keys = ["priority", "month"]
    total = rollup.rollup_values(rows, keys, "v", "sum").withColumn("total", cents(F.col("v"))).drop("v")
    mean = rollup.rollup_values(rows, keys, "v", "mean").withColumn("mean", F.round("v", 4)).drop("v")
    median = rollup.rollup_values(rows, keys, "v", "median").withColumn("median", F.round("v", 4)).drop("v")
    return total.join(mean, keys).join(median, keys)


@query("a7_whole_table_median", """SELECT l_returnflag AS flag, round(median(l_extendedprice), 4) AS median
  FROM lineitem GROUP BY 1""")
def a7_whole(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return rollup.exact_median(rows, ["flag"], "l_extendedprice").withColumn("median", F.round("median", 4))


@query("a8_weekday_factors", i.with_sql(i.BRAND) + """SELECT series_id, dow, round(m / o, 6) AS factor FROM (
  SELECT DISTINCT series_id, CAST(isodow(ds) - 1 AS INTEGER) AS dow,
    avg(y) OVER (PARTITION BY series_id, isodow(ds)) AS m, avg(y) OVER (PARTITION BY series_id) AS o
  FROM brand_panel)""")
def a8(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.weekday_factors(brand_panel(spark, folder)).withColumn("factor", F.round("factor", 6))


@query("a9_counts", """SELECT column_name, rows, nulls, distinct_values, nulls / rows AS null_share FROM (
  SELECT 'part' AS column_name, count(*) AS rows, count(*) FILTER (WHERE p IS NULL) AS nulls,
    count(DISTINCT p) AS distinct_values FROM (
      SELECT CASE WHEN l_linenumber <> 3 THEN l_partkey END AS p FROM lineitem)
  UNION ALL SELECT 'flag', count(*), 0, count(DISTINCT l_returnflag) FROM lineitem
  UNION ALL SELECT 'ship', count(*), 0, count(DISTINCT l_shipdate) FROM lineitem)""")
def a9(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("part"),
        F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("ship"),
    )
    return rollup.null_profile(rows, ["part", "flag", "ship"])


@query("a10_factor_totals", i.with_sql(*i.FACTOR_SQL) + """SELECT 'promotions' AS factor, count(*) AS rows,
  round(sum(discount), 2) AS total FROM promotions
  UNION ALL SELECT 'media_plan', count(*), round(sum(media_spend), 2) FROM media_plan
  UNION ALL SELECT 'holidays', count(*), round(sum(holiday_impact), 2) FROM holidays
  UNION ALL SELECT 'events', count(*), NULL FROM promo_events
  UNION ALL SELECT 'weather', count(*), NULL FROM weather
  UNION ALL SELECT 'competitor', count(*), NULL FROM competitor
  UNION ALL SELECT 'economic', count(*), NULL FROM economic""")
def a10(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.factor_totals(i.factors(spark, folder))


@query("a11_histogram", i.with_sql(i.BRAND, """stats AS (SELECT series_id, min(y) AS low, max(y) AS high
  FROM brand_panel GROUP BY 1), placed AS (SELECT b.series_id,
    least(floor((y - low) / ((high - low) / 20)), 19) AS bin, count(*) AS n
  FROM brand_panel b JOIN stats s ON b.series_id = s.series_id GROUP BY 1, 2)""") + """
  SELECT s.series_id, CAST(b.bin AS INTEGER) AS bin, round(low + (high - low) / 20 * (b.bin + 0.5), 6) AS midpoint,
  coalesce(n, 0) AS count FROM stats s CROSS JOIN range(20) b(bin)
  LEFT JOIN placed p ON p.series_id = s.series_id AND p.bin = b.bin""")
def a11(spark: SparkSession, folder: str) -> DataFrame:
    out = rollup.histogram(brand_panel(spark, folder), 20)
    return out.withColumn("midpoint", F.round("midpoint", 6))


@query("a12_forecast_summary", i.with_sql(i.REGION, i.HOLIDAYS, *ms.wma("region_panel", 7, "holiday_multiplier")) + """
  SELECT series_id, 'wma' AS model, round(sum(yhat), 4) AS total_forecast, round(sum(baseline), 4) AS total_baseline,
  round(sum(yhat) - sum(baseline), 4) AS total_uplift, round((sum(yhat) - sum(baseline)) / sum(baseline) * 100, 6) AS uplift_pct,
  round(sum(yhat) / count(*), 4) AS avg_per_step, count(*) AS horizon FROM wma_forecast GROUP BY 1""")
def a12(spark: SparkSession, folder: str) -> DataFrame:
    model, panel = WMA(), i.regions(spark, folder)
    factors = {"holidays": ms.shifted_holidays(spark, folder)}
    out = rollup.forecast_summary(with_baseline(model, model.fit(panel), 7, "D", factors))
    return out.select(
        "series_id", "model",
        *[F.round(c, 4).alias(c) for c in ("total_forecast", "total_baseline", "total_uplift")],
        F.round("uplift_pct", 6).alias("uplift_pct"), F.round("avg_per_step", 4).alias("avg_per_step"), "horizon",
    )


@query("a13_bottom_up", i.with_sql(i.STORE, """both_levels AS (
  SELECT region || ' / ' || store AS series_id, ds, y FROM store_sales
  UNION ALL SELECT region, ds, round(sum(y), 2) FROM store_sales GROUP BY 1, 2)""", *ms.wma("both_levels", 7)) + """
  SELECT split_part(series_id, ' / ', 1) AS parent, step,
  round(sum(CASE WHEN series_id LIKE '% / %' THEN yhat END), 4) AS bottom_up,
  round(max(CASE WHEN series_id NOT LIKE '% / %' THEN yhat END), 4) AS direct
  FROM wma_forecast GROUP BY 1, 2""")
def a13(spark: SparkSession, folder: str) -> DataFrame:
    sales = region_sales(spark, folder)
    children = sales.select(F.concat_ws(" / ", "region", "store").alias("series_id"), "ds", "y")
    panel = children.unionByName(region_panel(spark, folder))
    model = WMA()
    forecast = model.forecast(model.fit(panel), 7).withColumn("parent", F.substring_index("series_id", " / ", 1))
    # children may end on different days, so levels are matched by step
    out = rollup.bottom_up(forecast.drop("ds").withColumnRenamed("step", "ds"), "parent")
    return out.select(
        "parent", F.col("ds").alias("step"), F.round("bottom_up", 4).alias("bottom_up"), F.round("direct", 4).alias("direct")
    )


@query("a14_wma_median", i.with_sql(i.BRAND, """tail AS (SELECT series_id, y, 31 - age AS w FROM (SELECT *,
  row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS age FROM brand_panel) WHERE age <= 30)""") + """
  SELECT series_id, round(sum(y * w) / sum(w), 4) AS wma, round(median(y), 4) AS median FROM tail GROUP BY 1""")
def a14(spark: SparkSession, folder: str) -> DataFrame:
    out = rollup.recent_averages(brand_panel(spark, folder), 30)
    return out.select("series_id", F.round("wma", 4).alias("wma"), F.round("median", 4).alias("median"))


@query("a15_decay_trimmed", i.with_sql(i.BRAND, """tail AS (SELECT series_id, y, age FROM (SELECT *,
  row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) - 1 AS age FROM brand_panel) WHERE age < 60),
  cut AS (SELECT series_id, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM tail GROUP BY 1)""") + """
  SELECT t.series_id, round(sum(y * pow(0.9, age)) / sum(pow(0.9, age)), 4) AS decayed,
  round(avg(CASE WHEN y BETWEEN lo AND hi THEN y END), 4) AS trimmed
  FROM tail t JOIN cut c ON t.series_id = c.series_id GROUP BY 1""")
def a15(spark: SparkSession, folder: str) -> DataFrame:
    out = rollup.decayed_averages(brand_panel(spark, folder), 60, 0.9, 0.1)
    return out.select("series_id", F.round("decayed", 4).alias("decayed"), F.round("trimmed", 4).alias("trimmed"))


# --- sort, page, top-k --------------------------------------------------------------


@query("l1_sorted_totals", i.with_sql(i.EVENT) + "SELECT series_id, ds, y, v FROM event_panel ORDER BY ds, series_id")
def l1(spark: SparkSession, folder: str) -> DataFrame:
    return event_panel(spark, folder).orderBy("ds", "series_id")


@query("l2_page", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds, o_totalprice FROM orders
  ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100""")
def l2(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ds"), "o_totalprice")
    return ranking.page(rows, ["ds", "o_orderkey"], 100, 50)


@query("l3_recent_rows", i.with_sql(i.REGION) + """SELECT series_id, ds, y, age FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS INTEGER) AS age FROM region_panel) WHERE age <= 500""")
def l3(spark: SparkSession, folder: str) -> DataFrame:
    return grid.latest_rows(region_panel(spark, folder), 500)


@query("l4_top_k", i.with_sql(i.BRAND) + """SELECT series_id, ds, y, rank FROM (SELECT *, CAST(row_number() OVER
  (PARTITION BY series_id ORDER BY y DESC, ds) AS INTEGER) AS rank FROM brand_panel) WHERE rank <= 5""")
def l4(spark: SparkSession, folder: str) -> DataFrame:
    panel = brand_panel(spark, folder).select("series_id", "ds", "y")
    return ranking.top_k(panel, ["series_id"], [F.desc("y"), "ds"], 5)


@query("l5_rank_models", ms.CV_RANK_SQL)
def l5(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    folds = ranking.union_all([evaluate.cross_validate(panel, m) for m in (WMA(), Naive())])
    summary = evaluate.fold_summary(folds).select("series_id", "model", "mae", "mape")
    # a model without any metric ranks last
    missing = panel.select("series_id").distinct().select(
        "series_id", F.lit("absent").alias("model"), F.lit(None).cast("double").alias("mae"),
        F.lit(None).cast("double").alias("mape"),
    )
    out = ranking.rank_models(summary.unionByName(missing))
    return out.select(
        "series_id", "model", "rank", F.round("mae", 4).alias("mae"), F.round("score", 9).alias("score"),
        F.round("accuracy", 6).alias("accuracy"), "grade",
    )


@query("l6_search", """SELECT model_id, name, model_type, created_at FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS model_id, 'Run ' || o_orderpriority AS name,
    CASE o_orderstatus WHEN 'F' THEN 'wma' WHEN 'O' THEN 'ets' ELSE 'theta' END AS model_type,
    o_orderstatus || ' ' || o_custkey AS notes, o_orderpriority AS tag, CAST(o_orderdate AS DATE) AS created_at FROM orders)
  WHERE model_type = 'wma' AND (lower(name) LIKE '%urgent%' OR lower(notes) LIKE '%urgent%' OR lower(tag) LIKE '%urgent%')
  ORDER BY created_at DESC, model_id LIMIT 20 OFFSET 5""")
def l6(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    models = scan(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("model_id"),
        F.concat(F.lit("Run "), "o_orderpriority").alias("name"),
        F.when(status == "F", "wma").when(status == "O", "ets").otherwise("theta").alias("model_type"),
        F.concat_ws(" ", status, F.col("o_custkey").cast("string")).alias("notes"),
        F.array("o_orderpriority").alias("tags"), F.to_date("o_orderdate").alias("created_at"),
    )
    found = ranking.search(models, "wma", "Urgent", 5, 20)
    return found.select("model_id", "name", "model_type", "created_at")


# --- unions -----------------------------------------------------------------------


@query("u1_union_distinct", i.with_sql(i.HOLIDAYS, i.EVENTS) + """SELECT ds, holiday_name AS name FROM holidays
  UNION SELECT ds, event_name FROM promo_events""")
def u1(spark: SparkSession, folder: str) -> DataFrame:
    h = i.holidays(spark, folder).select("ds", F.col("holiday_name").alias("name"))
    e = i.promo_events(spark, folder).select("ds", F.col("event_name").alias("name"))
    return ranking.union_distinct([h, e], ["ds", "name"])


@query("u2_first_per_date", i.with_sql(i.HOLIDAYS, i.EVENTS) + """SELECT ds, name, impact, source FROM (
  SELECT *, row_number() OVER (PARTITION BY ds ORDER BY source, name, impact) AS rn FROM (
    SELECT ds, holiday_name AS name, holiday_impact AS impact, 0 AS source FROM holidays
    UNION ALL SELECT ds, event_name, event_impact, 1 FROM promo_events)) WHERE rn = 1""")
def u2(spark: SparkSession, folder: str) -> DataFrame:
    h = i.holidays(spark, folder).select("ds", F.col("holiday_name").alias("name"), F.col("holiday_impact").alias("impact"))
    e = i.promo_events(spark, folder).select("ds", F.col("event_name").alias("name"), F.col("event_impact").alias("impact"))
    return ranking.union_by_priority([h, e], ["ds"], ["name"])


@query("u3_flag_sums", i.with_sql(i.PROMOTIONS, i.HOLIDAYS, i.EVENTS) + """SELECT ds,
  count(*) FILTER (WHERE k = 'p') AS promotions_flag, count(*) FILTER (WHERE k = 'h') AS holidays_flag,
  count(*) FILTER (WHERE k = 'e') AS events_flag FROM (SELECT ds, 'p' AS k FROM promotions
  UNION ALL SELECT ds, 'h' FROM holidays UNION ALL SELECT ds, 'e' FROM promo_events) GROUP BY 1""")
def u3(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {"promotions": i.promotions, "holidays": i.holidays, "events": i.promo_events}
    return ranking.union_flags({k: f(spark, folder) for k, f in kinds.items()})


@query("u4_union_results", i.with_sql(i.REGION, *ms.wma("region_panel", 5), *ms.naive("region_panel", 5)) + """
  SELECT series_id, 'wma' AS model, ds, round(yhat, 4) AS yhat FROM wma_forecast
  UNION ALL SELECT series_id, 'naive', ds, round(yhat, 4) FROM naive_forecast""")
def u4(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    parts = [
        m.forecast(m.fit(panel), 5).select("series_id", F.lit(m.name).alias("model"), "ds", F.round("yhat", 4).alias("yhat"))
        for m in (WMA(), Naive())
    ]
    return ranking.union_all(parts)
