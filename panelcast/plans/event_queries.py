"""Queries for the event calendar, impact and lift operators (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import enrich, events as ev
from ..sources.tables import brand_panel, region_panel, scan
from . import events_sql as es
from . import inputs as i
from .join_queries import DAILY_EVENTS, PLAN, plan
from .registry import query


def sales_years(spark: SparkSession, folder: str) -> DataFrame:
    return ev.years_of(scan(spark, folder, "orders").select(F.col("o_orderdate").alias("ds")))


def all_years(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders").select(F.col("o_orderdate").alias("ds"))
    return ev.years_of(orders, scan(spark, folder, "events").select(F.col("ts").alias("ds")))


@query("e1_easter", i.with_sql(es.ALL_YEARS, es.EASTER) + "SELECT y AS year, western, orthodox FROM easter")
def e1(spark: SparkSession, folder: str) -> DataFrame:
    return all_years(spark, folder).select(
        "year", dates.western_easter("year").alias("western"), dates.orthodox_easter("year").alias("orthodox")
    )


@query("e2_weekday_rules", i.with_sql(es.ALL_YEARS) + f"""SELECT y AS year, {es.THANKSGIVING} AS thanksgiving,
  {es.nth_sql(5, 7, 2)} AS mothers_day, {es.nth_sql(6, 7, 3)} AS fathers_day,
  CAST(make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) AS DATE) AS last_monday_of_may FROM years""")
def e2(spark: SparkSession, folder: str) -> DataFrame:
    year = F.col("year").cast("int")
    return all_years(spark, folder).select(
        "year", dates.nth_weekday(year, 11, "THU", 4).alias("thanksgiving"), dates.nth_weekday(year, 5, "SUN", 2).alias("mothers_day"),
        dates.nth_weekday(year, 6, "SUN", 3).alias("fathers_day"), dates.last_weekday(year, 5, "MON").alias("last_monday_of_may"),
    )


@query("e3_lunar_dates", i.with_sql(es.ALL_YEARS, es.LUNAR) + """SELECT y AS year, max(d) FILTER (WHERE feast = 'cny') AS cny,
  max(d) FILTER (WHERE feast = 'diwali') AS diwali, max(d) FILTER (WHERE feast = 'holi') AS holi, max(d) FILTER (WHERE feast = 'ramadan') AS ramadan
  FROM years LEFT JOIN lunar ON year(d) = y GROUP BY 1""")
def e3(spark: SparkSession, folder: str) -> DataFrame:
    year = F.col("year").cast("int")
    return all_years(spark, folder).select(
        "year", ev.lunar(year, ev.CHINESE_NEW_YEAR).alias("cny"), ev.lunar(year, ev.DIWALI).alias("diwali"),
        ev.lunar(year, ev.HOLI).alias("holi"), ev.lunar(year, ev.RAMADAN).alias("ramadan"),
    )


FEAST_COUNTRIES = ["US", "GR", "CN", "IN", "SA", "MY"]


@query("e4_feasts", i.with_sql(es.ALL_YEARS, *es.feasts_sql(FEAST_COUNTRIES)) + "SELECT ds, name, type, country FROM feasts")
def e4(spark: SparkSession, folder: str) -> DataFrame:
    return ev.feasts(all_years(spark, folder), FEAST_COUNTRIES)


@query("e5_sports", i.with_sql(es.ALL_YEARS, es.sports_sql(["US", "IN", "FR"])) + "SELECT ds, name, type, country FROM sports")
def e5(spark: SparkSession, folder: str) -> DataFrame:
    return ev.sports(all_years(spark, folder), ["US", "IN", "FR"])


# country codes taken from the data: the first two letters of the part names and nations
_PAIRS = ", ".join(
    f"('{g}', '{c}')" for g, cs in ev.COUNTRIES.items() if cs is not None for c in cs)


@query("e6_applicability", f"""WITH countries AS (SELECT DISTINCT upper(substr(p_name, 1, 2)) AS country FROM part
  UNION SELECT DISTINCT upper(substr(p_brand, 1, 2)) FROM part UNION SELECT DISTINCT upper(substr(r_name, 1, 2)) FROM region
  UNION SELECT DISTINCT upper(substr(c_mktsegment, 1, 2)) FROM customer), pairs(event, country) AS (VALUES {_PAIRS})
  SELECT c.country, p.event FROM countries c JOIN pairs p ON c.country = p.country
  UNION ALL SELECT country, unnest(['fifa_world_cup', 'summer_olympics']) FROM countries""")
def e6(spark: SparkSession, folder: str) -> DataFrame:
    columns = [("part", "p_name"), ("part", "p_brand"), ("region", "r_name"), ("customer", "c_mktsegment")]
    codes = [scan(spark, folder, t).select(F.upper(F.substring(c, 1, 2)).alias("country")) for t, c in columns]
    countries = codes[0]
    for more in codes[1:]:
        countries = countries.union(more)
    return ev.applicability(countries.distinct())


@query("e7_event_calendar", i.with_sql(i.REGION, i.HOLIDAYS, es.EVENTS_US) + """SELECT ds, name, type, 'US' AS country FROM (
  SELECT *, row_number() OVER (PARTITION BY ds, name ORDER BY source, type) AS rn FROM (
    SELECT ds, 'Day ' || holiday_name AS name, 'public_holiday' AS type, 0 AS source FROM holidays
    UNION ALL SELECT ds, name, type, 1 FROM us_events)
  WHERE ds BETWEEN (SELECT min(ds) FROM region_panel) AND (SELECT max(ds) FROM region_panel)) WHERE rn = 1""")
def e7(spark: SparkSession, folder: str) -> DataFrame:
    public = i.holidays(spark, folder).select(
        "ds", F.concat(F.lit("Day "), "holiday_name").alias("name"), F.lit("public_holiday").alias("type"), F.lit("US").alias("country")
    )
    return ev.event_calendar(i.regions(spark, folder), ["US"], public)


IMPACT = """means AS (SELECT series_id, e.ds AS event_ds, name, avg(CASE WHEN r.ds < e.ds THEN y END) AS baseline,
    count(CASE WHEN r.ds < e.ds THEN y END) AS bn, avg(CASE WHEN r.ds >= e.ds THEN y END) AS during, count(CASE WHEN r.ds >= e.ds THEN y END) AS en
  FROM (SELECT DISTINCT ds, name FROM us_events) e JOIN {panel} r ON r.ds BETWEEN e.ds - 21 AND e.ds + 1 GROUP BY 1, 2, 3),
impacts AS (SELECT series_id, event_ds, name, baseline, CASE WHEN bn >= 3 AND en >= 1 AND baseline <> 0
  THEN round(greatest(least(during / baseline, 5.0), 0.1), 4) END AS impact FROM means)"""
TOTAL = "total_panel AS (SELECT '(all)' AS series_id, ds, round(sum(y), 2) AS y FROM region_panel GROUP BY 2)"


@query("e8_event_impact", i.with_sql(i.REGION, TOTAL, es.EVENTS_US, IMPACT.format(panel="total_panel")) + """SELECT event_ds, name, impact FROM impacts""")
def e8(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    return ev.event_impacts(us_events(panel), ev.overall_panel(panel)).select("event_ds", "name", "impact")


us_events = es.us_events


@query("e9_regional_impact", i.with_sql(i.REGION, es.EVENTS_US, IMPACT.format(panel="region_panel")) + """SELECT series_id, event_ds, name, impact FROM impacts""")
def e9(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    return ev.event_impacts(us_events(panel), panel).select("series_id", "event_ds", "name", "impact")


WEIGHTED = IMPACT.format(panel="region_panel") + """,
weighted AS (SELECT event_ds, name, sum(impact * baseline) / sum(CASE WHEN impact IS NOT NULL THEN baseline END) AS w
  FROM impacts WHERE baseline > 0 GROUP BY 1, 2)"""


@query("e10_weighted_impact", i.with_sql(i.REGION, es.EVENTS_US, WEIGHTED) + """SELECT e.ds AS event_ds, e.name,
  round(round(greatest(least(coalesce(w, 1.0), 5.0), 0.1), 4), 4) AS impact FROM (SELECT DISTINCT ds, name FROM us_events) e
  LEFT JOIN weighted w ON w.event_ds = e.ds AND w.name = e.name""")
def e10(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    return ev.weighted_impacts(us_events(panel), panel)


@query("e11_detect_events", i.with_sql(i.REGION, es.EVENTS_US, WEIGHTED, """rated AS (SELECT e.ds AS event_ds, e.name, e.type,
  round(greatest(least(coalesce(w, 1.0), 5.0), 0.1), 4) AS impact FROM us_events e LEFT JOIN weighted w ON w.event_ds = e.ds AND w.name = e.name)""") + """
  SELECT event_ds, name, type, impact, round((impact - 1) * 100, 1) AS impact_pct FROM rated""")
def e11(spark: SparkSession, folder: str) -> DataFrame:
    return ev.detect_events(i.regions(spark, folder), ["US"])


_HINTS = ", ".join(f"('{e}', '{r}')" for e, rs in ev.REGION_HINTS.items() for r in rs)


@query("e12_region_hints", f"""WITH hints(event, hint) AS (VALUES {_HINTS}), regions AS (
  SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'kerala' WHEN 'SMALL' THEN 'gujarat' WHEN 'PROMO' THEN 'goa' ELSE lower(p_type) END AS region FROM part)
  SELECT region, event FROM regions JOIN hints ON hint = region""")
def e12(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("p_type")
    region = F.when(kind == "ECONOMY", "kerala").when(kind == "SMALL", "gujarat").when(kind == "PROMO", "goa").otherwise(F.lower(kind))
    return ev.region_hints(scan(spark, folder, "part").select(region.alias("region")).distinct())


@query("e13_explode_intervals", i.with_sql(es.INTERVALS, DAILY_EVENTS) + """SELECT event_id, event_name, series_id, CAST(ds + 2 AS DATE) AS ds FROM daily_events""")
def e13(spark: SparkSession, folder: str) -> DataFrame:
    return ev.explode_intervals(es.intervals(spark, folder), ["series_id"], 2)


LIFTS = """lifts AS (SELECT series_id, CASE WHEN avg(CASE WHEN promo_flag = 0 THEN y END) > 0 THEN
    coalesce(avg(CASE WHEN promo_flag = 1 THEN y END) / avg(CASE WHEN promo_flag = 0 THEN y END), 1.0) ELSE 1.0 END AS promo_lift,
  CASE WHEN count(*) >= 10 AND stddev_samp(discount) > 0 AND avg(y) > 0 THEN regr_slope(y, discount) / avg(y) ELSE 0 END AS discount_beta
  FROM brand_panel GROUP BY 1)"""
EVENT_LIFTS = """with_events AS (SELECT b.*, event_name FROM brand_panel b LEFT JOIN one_event e ON b.series_id = e.series_id AND b.ds = e.ds),
event_lifts AS (SELECT g.series_id, event_name, g.m / p.m AS event_lift FROM (
    SELECT series_id, event_name, avg(y) AS m, count(*) AS n FROM with_events WHERE event_name IS NOT NULL GROUP BY 1, 2) g
  JOIN (SELECT series_id, avg(y) AS m FROM with_events WHERE event_name IS NULL GROUP BY 1) p ON g.series_id = p.series_id WHERE g.n >= 3 AND p.m > 0)"""


@query("e14_promo_lift", i.with_sql(i.BRAND, LIFTS) + "SELECT series_id, round(promo_lift, 8) AS promo_lift FROM lifts")
def e14(spark: SparkSession, folder: str) -> DataFrame:
    out = ev.promo_lifts(brand_panel(spark, folder))
    return out.select("series_id", F.round("promo_lift", 8).alias("promo_lift"))


@query("e15_discount_slope", i.with_sql(i.BRAND, LIFTS) + "SELECT series_id, round(discount_beta, 8) AS discount_beta FROM lifts")
def e15(spark: SparkSession, folder: str) -> DataFrame:
    out = ev.promo_lifts(brand_panel(spark, folder))
    return out.select("series_id", F.round("discount_beta", 8).alias("discount_beta"))


def sales_with_events(spark: SparkSession, folder: str, sales: DataFrame | None = None) -> DataFrame:
    daily = ev.explode_intervals(es.intervals(spark, folder), ["series_id"])
    return enrich.attach_events(i.brands(spark, folder) if sales is None else sales, daily, ["series_id"])


@query("e16_event_lift", i.with_sql(i.BRAND, es.INTERVALS, DAILY_EVENTS, EVENT_LIFTS) + "SELECT series_id, event_name, round(event_lift, 8) AS event_lift FROM event_lifts")
def e16(spark: SparkSession, folder: str) -> DataFrame:
    return ev.event_lifts(sales_with_events(spark, folder)).withColumn("event_lift", F.round("event_lift", 8))


@query("e17_combined_lift", i.with_sql(i.BRAND, es.INTERVALS, DAILY_EVENTS, LIFTS, EVENT_LIFTS, PLAN) + """SELECT p.series_id, p.ds,
  round(CASE WHEN promo_flag <> 0 THEN promo_lift ELSE 1 END * CASE WHEN discount <> 0 THEN 1 + discount_beta * discount ELSE 1 END
    * coalesce(event_lift, 1), 8) AS lift
  FROM first_plan p JOIN lifts l ON p.series_id = l.series_id LEFT JOIN one_event e ON e.series_id = p.series_id AND e.ds = p.ds
  LEFT JOIN event_lifts v ON v.series_id = p.series_id AND v.event_name = e.event_name""")
def e17(spark: SparkSession, folder: str) -> DataFrame:
    daily = ev.explode_intervals(es.intervals(spark, folder), ["series_id"])
    sales = i.brands(spark, folder)
    planned = enrich.first_match(plan(spark, folder), ["series_id", "ds"], ["no", "discount", "note"])
    rows = enrich.attach_events(planned.join(ev.promo_lifts(sales), "series_id"), daily, ["series_id"])
    lifts = ev.event_lifts(sales_with_events(spark, folder, sales))
    joined = rows.join(lifts, ["series_id", "event_name"], "left")
    lift = ev.combined_lift(F.col("promo_flag"), F.col("discount"), F.col("event_lift"))
    return joined.select("series_id", "ds", F.round(lift, 8).alias("lift"))


def _lag_rows(factor: str, columns: list[str], lags: int) -> str:
    lag = ", ".join(f"lag({c}, {k}) OVER w AS {c}_{k}" for c in columns for k in range(lags))
    rows = " UNION ALL ".join(
        f"SELECT series_id, {no} AS no, '{c}' AS col, {k} AS lag, count(*) AS n, corr(y, {c}_{k}) AS r FROM lagged GROUP BY 1"
        for no, c in enumerate(columns) for k in range(lags))
    return f"""lagged AS (SELECT series_id, y, {lag} FROM region_panel r JOIN {factor} f ON r.ds = f.ds WINDOW w AS (PARTITION BY series_id ORDER BY r.ds)),
    rows AS ({rows})"""


@query("e18_lag_analysis", i.with_sql(i.REGION, i.WEATHER, _lag_rows("weather", ["temperature", "rainfall"], 31)) + """
  SELECT series_id, col AS column, CAST(lag AS INTEGER) AS lag, round(abs(r), 3) AS correlation,
  CASE WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM rows
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(coalesce(abs(r), 0), 9) DESC, no, lag) = 1""")
def e18(spark: SparkSession, folder: str) -> DataFrame:
    return ev.lag_analysis(region_panel(spark, folder), i.weather(spark, folder))


@query("e19_factor_lags", i.with_sql(i.REGION, i.WEATHER, _lag_rows("weather", ["temperature", "rainfall"], 30)) + """
  SELECT s.series_id, 'weather/' || s.col AS factor, round(s.r, 8) AS correlation, CAST(CASE WHEN b.r > 0.1 THEN b.lag END AS INTEGER) AS best_lag,
  round(CASE WHEN b.r > 0.1 THEN b.r END, 8) AS best_correlation FROM (SELECT * FROM rows WHERE lag = 0) s JOIN (
    SELECT series_id, col, lag, abs(r) AS r FROM rows QUALIFY row_number() OVER (PARTITION BY series_id, col ORDER BY round(coalesce(abs(r), 0), 9) DESC, lag) = 1) b
  ON s.series_id = b.series_id AND s.col = b.col""")
def e19(spark: SparkSession, folder: str) -> DataFrame:
    out = ev.factor_lags(region_panel(spark, folder), {"weather": i.weather(spark, folder)})
    return out.withColumns({"correlation": F.round("correlation", 8), "best_correlation": F.round("best_correlation", 8)})


@query("e20_rule_uplift", i.with_sql(i.REGION, i.WEATHER) + """SELECT series_id, r.ds, round(y * CASE WHEN rainfall > 6 THEN 1.15
  WHEN temperature > 26 THEN 0.90 ELSE 1.0 END, 4) AS adjusted FROM region_panel r JOIN weather w ON r.ds = w.ds""")
def e20(spark: SparkSession, folder: str) -> DataFrame:
    rows = enrich.join_factor(region_panel(spark, folder), i.weather(spark, folder))
    uplift = ev.rule_uplift([(F.col("rainfall") > 6, 1.15), (F.col("temperature") > 26, 0.90)])
    return rows.select("series_id", "ds", F.round(F.col("y") * uplift, 4).alias("adjusted"))
