"""Queries for the grid, calendar and lag operators (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import grid
from ..sources.tables import brand_panel, region_panel, scan
from . import inputs as i
from .registry import query

CALENDAR_SQL = """CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek, CAST(day(ds) AS INTEGER) AS dayofmonth,
  CAST(dayofyear(ds) AS INTEGER) AS dayofyear, CAST(week(ds) AS INTEGER) AS weekofyear,
  CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter,
  CAST(year(ds) AS INTEGER) AS year, CAST(isodow(ds) >= 6 AS INTEGER) AS is_weekend,
  CAST(day(ds) = 1 AS INTEGER) AS is_month_start, CAST(ds = last_day(ds) AS INTEGER) AS is_month_end"""


@query("w1_calendar", i.with_sql(i.REGION) + f"SELECT series_id, ds, {CALENDAR_SQL} FROM region_panel")
def w1(spark: SparkSession, folder: str) -> DataFrame:
    return grid.calendar_features(region_panel(spark, folder).drop("y"))


WEEK_END = "CAST(ds + CAST(7 - isodow(ds) AS INTEGER) AS DATE)"


def _resample_sql(freq: str) -> str:
    label = {
        "W": WEEK_END,
        "F": "CAST(first_ds + CAST(floor((ds - first_ds) / 14) * 14 AS INTEGER) AS DATE)",
        "M": "last_day(ds)",
    }[freq]
    step = {"W": "INTERVAL 7 DAY", "F": "INTERVAL 14 DAY", "M": "INTERVAL 1 MONTH"}[freq]
    base = "date_trunc('month', {})" if freq == "M" else "{}"
    wrap = "last_day(CAST(g AS DATE))" if freq == "M" else "CAST(g AS DATE)"
    return i.with_sql(i.REGION, f"""labelled AS (
      SELECT series_id, {label} AS label, y
      FROM (SELECT *, min(ds) OVER (PARTITION BY series_id) AS first_ds FROM region_panel)),
    totals AS (SELECT series_id, label, sum(y) AS y FROM labelled GROUP BY 1, 2),
    frame AS (SELECT series_id, {wrap} AS ds FROM (SELECT series_id, unnest(generate_series(
      CAST({base.format('min(label)')} AS TIMESTAMP), CAST({base.format('max(label)')} AS TIMESTAMP), {step})) AS g
      FROM totals GROUP BY series_id))""") + """SELECT f.series_id, f.ds, round(coalesce(t.y, 0), 2) AS y
    FROM frame f LEFT JOIN totals t ON f.series_id = t.series_id AND f.ds = t.label"""


def _resample(freq: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = grid.resample_sum(region_panel(spark, folder), freq)
        return out.withColumn("y", F.round("y", 2))

    return run


for _freq, _name in (("W", "week"), ("F", "fortnight"), ("M", "month")):
    query(f"w2_resample_{_name}", _resample_sql(_freq))(_resample(_freq))


@query("w2_resample_day", i.with_sql(i.STORE, """totals AS (SELECT store AS series_id, ds, y FROM store_sales),
  frame AS (SELECT series_id, CAST(unnest(generate_series(CAST(min(ds) AS TIMESTAMP),
    CAST(max(ds) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM totals GROUP BY 1)""") + """
  SELECT f.series_id, f.ds, coalesce(t.y, 0) AS y FROM frame f
  LEFT JOIN totals t ON f.series_id = t.series_id AND f.ds = t.ds""")
def w2_day(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.tables import region_sales

    panel = region_sales(spark, folder).select(F.col("store").alias("series_id"), "ds", "y")
    return grid.resample_sum(panel, "D")


DOWNSAMPLE_SQL = f"""rated AS (
  SELECT series_id, ds, y, count(*) OVER s AS n, max(ds) OVER s - min(ds) OVER s AS span,
    row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS age
  FROM region_panel WINDOW s AS (PARTITION BY series_id)),
levels AS (SELECT *, CASE WHEN n <= 340 THEN 'none' WHEN n > 1700 AND span >= 1825 THEN 'weekly'
  ELSE 'tail' END AS level FROM rated),
weeks AS (SELECT series_id, {WEEK_END} AS label, sum(y) AS y FROM levels WHERE level = 'weekly' GROUP BY 1, 2),
frame AS (SELECT series_id, CAST(unnest(generate_series(CAST(min(label) AS TIMESTAMP),
  CAST(max(label) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS ds FROM weeks GROUP BY 1),
shorter AS (
  SELECT series_id, ds, y, level FROM levels WHERE level = 'none' OR (level = 'tail' AND age <= 340)
  UNION ALL
  SELECT f.series_id, f.ds, coalesce(w.y, 0), 'weekly' FROM frame f
  LEFT JOIN weeks w ON f.series_id = w.series_id AND f.ds = w.label)"""


@query("w3_downsample", i.with_sql(i.REGION, DOWNSAMPLE_SQL) + """SELECT series_id, ds,
  round(y, 2) AS y, level FROM shorter""")
def w3(spark: SparkSession, folder: str) -> DataFrame:
    out = grid.downsample(region_panel(spark, folder), 340)
    return out.withColumn("y", F.round("y", 2))


@query("w3_downsample_factor", i.with_sql(i.REGION, DOWNSAMPLE_SQL, i.PROMOTIONS) + f"""SELECT w.ds,
  round(coalesce(p.discount, 0), 2) AS discount
  FROM (SELECT DISTINCT ds FROM shorter WHERE level = 'weekly') w LEFT JOIN (
    SELECT {WEEK_END} AS ds, sum(discount) AS discount FROM promotions GROUP BY 1) p ON w.ds = p.ds""")
def w3_factor(spark: SparkSession, folder: str) -> DataFrame:
    shorter = grid.downsample(region_panel(spark, folder), 340)
    out = grid.downsample_factor(i.promotions(spark, folder), shorter)
    return out.withColumn("discount", F.round("discount", 2))


_S = "(PARTITION BY series_id ORDER BY ds)"


@query("w4_lags", i.with_sql(i.BRAND) + f"""SELECT series_id, ds, {', '.join(
  f'lag(y, {k}) OVER {_S} AS lag_{k}' for k in grid.LAGS)} FROM brand_panel""")
def w4(spark: SparkSession, folder: str) -> DataFrame:
    lagged = grid.lag_features(brand_panel(spark, folder))
    return lagged.select("series_id", "ds", *[f"lag_{k}" for k in grid.LAGS])


_ROLL_SQL = ", ".join(
    f"round(avg(y) OVER w{k}, 6) AS rolling_mean_{k}, "
    f"round(coalesce(stddev_samp(y) OVER w{k}, 0), 2) AS rolling_std_{k}, "
    f"min(y) OVER w{k} AS rolling_min_{k}, max(y) OVER w{k} AS rolling_max_{k}"
    for k in grid.ROLLING
)
_ROLL_WINDOWS = ", ".join(
    f"w{k} AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    for k in grid.ROLLING
)


@query("w5_rolling", i.with_sql(i.REGION) + f"SELECT series_id, ds, {_ROLL_SQL} FROM region_panel WINDOW {_ROLL_WINDOWS}")
def w5(spark: SparkSession, folder: str) -> DataFrame:
    rolled = grid.rolling_features(region_panel(spark, folder)).drop("y")
    return rolled.withColumns(
        {f"rolling_mean_{k}": F.round(f"rolling_mean_{k}", 6) for k in grid.ROLLING}
        | {f"rolling_std_{k}": F.round(f"rolling_std_{k}", 2) for k in grid.ROLLING}
    )


@query("w6_difference", i.with_sql(i.REGION) + f"""SELECT series_id, ds,
  round(y - lag(y) OVER {_S}, 2) AS dy FROM region_panel""")
def w6(spark: SparkSession, folder: str) -> DataFrame:
    out = grid.difference(region_panel(spark, folder))
    return out.select("series_id", "ds", F.round("dy", 2).alias("dy"))


@query("w7_fill", i.with_sql(i.BRAND) + """SELECT series_id, ds, coalesce(
    last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS UNBOUNDED PRECEDING),
    first_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v
  FROM (SELECT *, CASE WHEN promo_flag = 1 AND day(ds) > 5 THEN y END AS v FROM brand_panel)""")
def w7(spark: SparkSession, folder: str) -> DataFrame:
    holed = brand_panel(spark, folder).withColumn(
        "v", F.when((F.col("promo_flag") == 1) & (F.dayofmonth("ds") > 5), F.col("y"))
    )
    return grid.fill_along(holed, ["v"]).select("series_id", "ds", "v")


FUTURE_SQL = {
    "D": "CAST(last_ds + step AS DATE)",
    "W": "CAST(last_ds + CAST(CASE WHEN isodow(last_ds) = 7 THEN 7 ELSE 7 - isodow(last_ds) END AS INTEGER) + 7 * (step - 1) AS DATE)",
    "F": "CAST(last_ds + 14 * step AS DATE)",
    "M": "last_day(CAST(date_trunc('month', last_ds + 1) + to_months(step - 1) AS DATE))",
    "Q": "CAST(date_trunc('quarter', last_ds + 1) + to_months(3 * step) - INTERVAL 1 DAY AS DATE)",
    "Y": "CAST(date_trunc('year', last_ds + 1) + to_months(12 * step) - INTERVAL 1 DAY AS DATE)",
}


@query("w8_future_dates", i.with_sql(i.BRAND, """ends AS (SELECT series_id, max(ds) AS last_ds
  FROM brand_panel GROUP BY 1), grid AS (SELECT *, CAST(unnest(range(1, 7)) AS INTEGER) AS step FROM ends)""")
  + " UNION ALL ".join(f"SELECT series_id, '{f}' AS freq, step, {FUTURE_SQL[f]} AS ds FROM grid" for f in dates.FREQUENCIES))
def w8(spark: SparkSession, folder: str) -> DataFrame:
    ends = grid.future_grid(brand_panel(spark, folder), 6)
    return ends.select(
        "series_id", "step", F.explode(F.array(*[
            F.struct(F.lit(f).alias("freq"), dates.future_date("last_ds", "step", f).alias("ds"))
            for f in dates.FREQUENCIES
        ])).alias("f")
    ).select("series_id", "f.freq", "step", "f.ds")


@query("w9_period_start", """SELECT DISTINCT CAST(l_shipdate AS DATE) AS ds,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS monday,
  CAST(CAST(l_shipdate AS DATE) - CAST((isodow(l_shipdate) + 3) % 7 AS INTEGER) AS DATE) AS thursday,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem""")
def w9(spark: SparkSession, folder: str) -> DataFrame:
    days = scan(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("ds")).distinct()
    return days.select(
        "ds", dates.period_start("ds", "W").alias("monday"),
        dates.period_start("ds", "W", "THU").alias("thursday"),
        dates.period_start("ds", "M").alias("month"),
    )


@query("w10_week_of_month", """SELECT DISTINCT CAST(l_shipdate AS DATE) AS ds,
  CAST(date_diff('day', CAST(date_trunc('week', date_trunc('month', l_shipdate)) AS DATE),
    CAST(date_trunc('week', l_shipdate) AS DATE)) / 7 + 1 AS INTEGER) AS week FROM lineitem""")
def w10(spark: SparkSession, folder: str) -> DataFrame:
    days = scan(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("ds")).distinct()
    return days.select("ds", dates.week_of_month("ds").alias("week"))


@query("w11_centred_average", i.with_sql(i.REGION) + """SELECT series_id, ds,
  CASE WHEN count(*) OVER w7 = 7 THEN round(sum(y) OVER w7 / 7, 4) END AS ma7,
  CASE WHEN count(*) OVER w4 = 5 THEN round(sum(y) OVER w4 / 4, 4) END AS ma4 FROM region_panel
  WINDOW w7 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
  w4 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def w11(spark: SparkSession, folder: str) -> DataFrame:
    return region_panel(spark, folder).select(
        "series_id", "ds", F.round(grid.centred_average(7), 4).alias("ma7"),
        F.round(grid.centred_average(4), 4).alias("ma4"),
    )


@query("w12_position", i.with_sql(i.BRAND) + f"""SELECT series_id, ds,
  CAST(row_number() OVER {_S} - 1 AS INTEGER) AS idx FROM brand_panel""")
def w12(spark: SparkSession, folder: str) -> DataFrame:
    return brand_panel(spark, folder).select("series_id", "ds", grid.position().alias("idx"))


@query("w13_latest_rows", i.with_sql(i.BRAND) + """SELECT series_id, ds, y, age FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS INTEGER) AS age FROM brand_panel)
  WHERE age <= 14""")
def w13(spark: SparkSession, folder: str) -> DataFrame:
    return grid.latest_rows(brand_panel(spark, folder).select("series_id", "ds", "y"), 14)


@query("w14_standardise", i.with_sql(i.BRAND) + """SELECT b.series_id, ds, round((y - ym) / ysd, 6) AS y,
  round((discount - dm) / dsd, 6) AS discount FROM brand_panel b JOIN (
    SELECT series_id, avg(y) AS ym, stddev_pop(y) AS ysd, avg(discount) AS dm, stddev_pop(discount) AS dsd
    FROM brand_panel WHERE year(ds) < 2000 GROUP BY 1) s ON b.series_id = s.series_id""")
def w14(spark: SparkSession, folder: str) -> DataFrame:
    panel = brand_panel(spark, folder).select("series_id", "ds", "y", "discount")
    scaler = grid.fit_scaler(panel.filter(F.year("ds") < 2000), ["y", "discount"])
    out = grid.apply_scaler(panel, scaler, ["y", "discount"])
    return out.select("series_id", "ds", F.round("y", 6).alias("y"), F.round("discount", 6).alias("discount"))


@query("w15_one_hot", i.with_sql(i.PROMOTIONS) + """SELECT ds, discount,
  CAST(promo_type = 'A' AS DOUBLE) AS "promo_type_A", CAST(promo_type = 'N' AS DOUBLE) AS "promo_type_N",
  CAST(promo_type = 'R' AS DOUBLE) AS "promo_type_R" FROM promotions""")
def w15(spark: SparkSession, folder: str) -> DataFrame:
    return grid.one_hot(i.promotions(spark, folder), "promo_type").drop("promo_type")


@query("w16_complete_rows", i.with_sql(i.BRAND) + f"""SELECT series_id, ds, y, discount, lag_1, lag_14
  FROM (SELECT *, lag(y) OVER {_S} AS lag_1, lag(y, 14) OVER {_S} AS lag_14 FROM brand_panel)
  WHERE lag_14 IS NOT NULL""")
def w16(spark: SparkSession, folder: str) -> DataFrame:
    panel = brand_panel(spark, folder).drop("promo_flag").withColumn("note", F.lit("text"))
    out = grid.complete_rows(grid.lag_features(panel, (1, 14)))
    return out.withColumn("discount", F.col("discount"))
