"""Queries for validation and profiling (V) and the scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..models.wma import WMA, Naive
from ..operators import evaluate, profile, quality, ranking
from ..sources.tables import brand_panel, event_panel, region_panel, scan
from . import inputs as i
from . import model_sql as ms
from .registry import query


@query("v1_upload_checks", """SELECT column_name, rows, 1 - filled / rows AS null_share,
  CASE WHEN column_name = '(table)' THEN 'ok' WHEN filled = 0 THEN 'error' WHEN 1 - filled / rows > 0.5 THEN 'warning'
    ELSE 'ok' END AS severity FROM (
  SELECT 'o_orderkey' AS column_name, count(*) AS rows, count(*) AS filled FROM orders
  UNION ALL SELECT 'mostly_null', count(*), count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders
  UNION ALL SELECT 'nothing', count(*), 0 FROM orders UNION ALL SELECT '(table)', count(*), count(*) FROM orders)""")
def v1(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("mostly_null"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return quality.upload_checks(rows)


@query("v2_sales_checks", """SELECT 'order_date' AS date_column, 'amount' AS value_column, count(*) AS row_count,
  count(DISTINCT CAST(o_orderdate AS DATE)) AS unique_dates,
  count(*) FILTER (WHERE o_orderkey % 17 = 0) AS missing, true AS valid, false AS is_short FROM orders""")
def v2(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "orders").select(
        F.col("o_orderdate").alias("order_date"), "o_orderpriority",
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("amount"),
    )
    return quality.sales_checks(rows)


# every second, week-end, fortnight-end, month-end ... date of the store panel: one series per rhythm
RHYTHM = """rhythm AS (
  SELECT DISTINCT 'daily' AS series_id, CAST(o_orderdate AS DATE) AS ds FROM orders
  UNION SELECT 'weekly', CAST(date_trunc('week', o_orderdate) AS DATE) FROM orders
  UNION SELECT 'monthly', CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders
  UNION SELECT 'quarterly', CAST(date_trunc('quarter', o_orderdate) AS DATE) FROM orders
  UNION SELECT 'yearly', CAST(date_trunc('year', o_orderdate) AS DATE) FROM orders),
gaps AS (SELECT series_id, count(*) AS dates, median(gap) AS g FROM (SELECT *,
  ds - lag(ds) OVER (PARTITION BY series_id ORDER BY ds) AS gap FROM rhythm) GROUP BY 1)"""


def rhythm(spark: SparkSession, folder: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    labels = F.array(*[
        F.struct(F.lit(name).alias("series_id"), (day if unit is None else F.trunc(day, unit)).alias("ds"))
        for name, unit in [("daily", None), ("weekly", "WEEK"), ("monthly", "MONTH"), ("quarterly", "QUARTER"), ("yearly", "YEAR")]
    ])
    days = scan(spark, folder, "orders").select(day.alias("o_orderdate")).distinct()
    return days.select(F.explode(labels).alias("r")).select("r.series_id", "r.ds").distinct()


@query("v3_frequency", i.with_sql(RHYTHM) + """SELECT series_id, CASE WHEN g <= 3 THEN 'D' WHEN g <= 10 THEN 'W'
  WHEN g <= 20 THEN 'F' WHEN g <= 60 THEN 'M' WHEN g <= 180 THEN 'Q' ELSE 'Y' END AS frequency FROM gaps""")
def v3(spark: SparkSession, folder: str) -> DataFrame:
    return profile.frequencies(rhythm(spark, folder)).select("series_id", F.col("validation").alias("frequency"))


@query("v4_pattern_frequency", i.with_sql(RHYTHM) + """SELECT series_id, CASE WHEN g <= 1.5 THEN 'D' WHEN g <= 3.5 THEN '2D'
  WHEN g <= 10 THEN 'W' WHEN g <= 20 THEN '2W' WHEN g <= 45 THEN 'MS' WHEN g <= 100 THEN 'QS' ELSE 'YS' END AS frequency FROM gaps""")
def v4(spark: SparkSession, folder: str) -> DataFrame:
    return profile.frequencies(rhythm(spark, folder)).select("series_id", F.col("pattern").alias("frequency"))


@query("v5_common_gap", i.with_sql(RHYTHM) + """SELECT series_id, CASE WHEN gap = 1 THEN 'D' ELSE gap || 'D' END AS frequency
  FROM (SELECT series_id, gap, row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, gap) AS rn FROM (
    SELECT *, ds - lag(ds) OVER (PARTITION BY series_id ORDER BY ds) AS gap FROM rhythm) WHERE gap IS NOT NULL GROUP BY 1, 2)
  WHERE rn = 1""")
def v5(spark: SparkSession, folder: str) -> DataFrame:
    return profile.frequencies(rhythm(spark, folder)).select("series_id", F.col("common").alias("frequency"))


@query("v6_model_frequency", i.with_sql(RHYTHM) + """SELECT series_id, CASE WHEN g <= 1 THEN 'D' WHEN g <= 7 THEN 'W'
  WHEN g <= 31 THEN 'M' ELSE 'D' END AS frequency FROM gaps""")
def v6(spark: SparkSession, folder: str) -> DataFrame:
    return profile.frequencies(rhythm(spark, folder)).select("series_id", F.col("model").alias("frequency"))


@query("v7_season_length", i.with_sql(RHYTHM) + """SELECT series_id, CAST(CASE WHEN dates >= 14 THEN
  CASE WHEN floor(g) <= 1 THEN 7 WHEN floor(g) <= 7 THEN 52 WHEN floor(g) <= 31 THEN 12 END END AS INTEGER) AS season_length FROM gaps""")
def v7(spark: SparkSession, folder: str) -> DataFrame:
    return profile.frequencies(rhythm(spark, folder)).select("series_id", "season_length")


@query("v8_too_fine", i.with_sql(RHYTHM) + """SELECT series_id, frequency FROM (SELECT series_id, CASE WHEN g <= 3 THEN 'D'
  WHEN g <= 10 THEN 'W' WHEN g <= 20 THEN 'F' WHEN g <= 60 THEN 'M' WHEN g <= 180 THEN 'Q' ELSE 'Y' END AS frequency FROM gaps)
  WHERE frequency NOT IN ('D', 'W')""")
def v8(spark: SparkSession, folder: str) -> DataFrame:
    found = profile.frequencies(rhythm(spark, folder)).select("series_id", F.col("validation").alias("frequency"))
    return quality.frequency_mismatch(found, "W")


@query("v9_column_classes", """SELECT * FROM (SELECT 'o_orderkey' AS column_name, 'numeric' AS class
  UNION ALL SELECT 'placed_date', 'date' UNION ALL SELECT 'store_code', 'id' UNION ALL SELECT 'city', 'region'
  UNION ALL SELECT 'urgent', 'boolean'
  UNION ALL SELECT 'status', CASE WHEN count(DISTINCT o_orderstatus) < greatest(2, count(*) * 0.2) THEN 'categorical' ELSE 'text' END FROM orders
  UNION ALL SELECT 'label', CASE WHEN count(DISTINCT o_orderkey) < greatest(2, count(*) * 0.2) THEN 'categorical' ELSE 'text' END FROM orders)""")
def v9(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("placed_date"), F.col("o_orderstatus").alias("store_code"),
        F.col("o_orderpriority").alias("city"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.col("o_orderstatus").alias("status"), F.concat(F.lit("order "), "o_orderkey").alias("label"),
    )
    return quality.column_classes(rows)


CHARS = """idx AS (SELECT *, row_number() OVER w - 1 AS i, lag(y, 1) OVER w AS l1, lag(y, 7) OVER w AS l7, lag(y, 30) OVER w AS l30,
    lag(y, 365) OVER w AS l365 FROM region_panel WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
stats AS (SELECT series_id, count(*) AS n, avg(y) AS mean, stddev_samp(y) AS std, min(ds) AS a, max(ds) AS b,
  regr_slope(y, i) AS slope, regr_r2(y, i) AS r2, corr(y, l1) AS ac1, corr(y, l7) AS ac7, corr(y, l30) AS ac30, corr(y, l365) AS ac365,
  quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM idx GROUP BY 1),
outliers AS (SELECT s.series_id, CASE WHEN max(q3 - q1) <> 0 THEN
  count(*) FILTER (WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*) ELSE 0 END AS pct
  FROM region_panel r JOIN stats s ON r.series_id = s.series_id GROUP BY 1)"""


@query("v10_characteristics", i.with_sql(i.REGION, CHARS) + """SELECT series_id, n AS length, round(mean, 4) AS mean,
  round(std, 4) AS std, round(std / mean, 6) AS cv, CAST(0 AS DOUBLE) AS missing_pct, a AS min_date, b AS max_date FROM stats""")
def v10(spark: SparkSession, folder: str) -> DataFrame:
    chars = profile.characteristics(region_panel(spark, folder))
    return chars.select(
        "series_id", "length", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        F.round("cv", 6).alias("cv"), "missing_pct", "min_date", "max_date",
    )


@query("v11_trend_class", i.with_sql(i.REGION, CHARS) + """SELECT series_id, round(slope, 6) AS slope,
  CASE WHEN slope / mean * 100 > 1 THEN 'increasing' WHEN slope / mean * 100 < -1 THEN 'decreasing' ELSE 'stable' END AS trend FROM stats""")
def v11(spark: SparkSession, folder: str) -> DataFrame:
    chars = profile.characteristics(region_panel(spark, folder))
    return chars.select("series_id", F.round("slope", 6).alias("slope"), "trend")


@query("v12_season_class", i.with_sql(i.REGION, CHARS) + """SELECT series_id, CASE WHEN n < 14 THEN 'none' WHEN abs(ac7) > 0.5 THEN 'weekly'
  WHEN n > 30 AND abs(ac30) > 0.5 THEN 'monthly' WHEN n > 365 AND abs(ac365) > 0.5 THEN 'yearly' ELSE 'none' END AS seasonality FROM stats""")
def v12(spark: SparkSession, folder: str) -> DataFrame:
    return profile.characteristics(region_panel(spark, folder)).select("series_id", "seasonality")


@query("v13_outlier_share", i.with_sql(i.REGION, CHARS) + "SELECT series_id, round(pct, 8) AS outliers_pct FROM outliers")
def v13(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.outlier_share(region_panel(spark, folder))
    return out.withColumn("outliers_pct", F.round("outliers_pct", 8))


UNIT_ROOT = """moves AS (SELECT *, y - x AS d FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS x, count(*) OVER (PARTITION BY series_id) AS all_rows FROM brand_panel)),
  lagged AS (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY ds) AS d1 FROM moves),
  sums AS (SELECT series_id, max(all_rows) AS all_rows, count(d1) AS n, var_pop(x) * count(d1) AS xx, var_pop(d1) * count(d1) AS ll, var_pop(d) * count(d1) AS dd,
    covar_pop(x, d1) * count(d1) AS xl, covar_pop(x, d) * count(d1) AS xd, covar_pop(d1, d) * count(d1) AS ld FROM lagged WHERE d1 IS NOT NULL GROUP BY 1),
  solved AS (SELECT *, (xd * ll - ld * xl) / (xx * ll - xl * xl) AS b, (ld * xx - xd * xl) / (xx * ll - xl * xl) AS c FROM sums),
  tested AS (SELECT series_id, b / sqrt((dd - b * xd - c * ld) / (n - 3) * ll / (xx * ll - xl * xl)) AS statistic,
    -2.86154 - 2.8903 / n - 4.234 / pow(n, 2) - 40.04 / pow(n, 3) AS critical FROM solved WHERE all_rows >= 30)"""


@query("v14_fixed_lag", i.with_sql(i.BRAND, UNIT_ROOT) + """SELECT b.series_id, round(statistic, 6) AS statistic, round(critical, 9) AS critical, CASE WHEN statistic IS NOT NULL THEN CAST(1 AS INTEGER) END AS lags,
  coalesce(statistic < critical, true) AS stationary FROM (SELECT DISTINCT series_id FROM brand_panel) b LEFT JOIN tested t ON t.series_id = b.series_id""")
def v14_fixed(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.stationarity(brand_panel(spark, folder).select("series_id", "ds", "y"), lags=1)
    return out.withColumns({"statistic": F.round("statistic", 6), "critical": F.round("critical", 9)})


@query("v14_stationarity")
def v14(spark: SparkSession, folder: str) -> DataFrame:
    return profile.stationarity(brand_panel(spark, folder).select("series_id", "ds", "y"))


@query("v15_autocorrelation", i.with_sql(i.BRAND, """centred AS (SELECT series_id, ds, y - avg(y) OVER (PARTITION BY series_id) AS c FROM brand_panel)""")
  + "SELECT series_id, n, lag, round(s / v, 8) AS acf FROM (" + " UNION ALL ".join(
    f"SELECT series_id, count(*) AS n, {k} AS lag, sum(c * l) AS s, sum(c * c) AS v FROM (SELECT *, lag(c, {k}) OVER (PARTITION BY series_id ORDER BY ds) AS l FROM centred) GROUP BY 1"
    for k in range(1, 21)) + ")")
def v15(spark: SparkSession, folder: str) -> DataFrame:
    panel = brand_panel(spark, folder).select("series_id", "ds", "y")
    return profile.autocorrelation(panel).withColumn("acf", F.round("acf", 8))


@query("v15_partial_autocorrelation")
def v15_partial(spark: SparkSession, folder: str) -> DataFrame:
    return profile.partial_autocorrelation(region_panel(spark, folder))


@query("v15_arima_orders")
def v15_orders(spark: SparkSession, folder: str) -> DataFrame:
    return profile.arima_orders(i.regions(spark, folder))


@query("v16_insights", i.with_sql(i.REGION, CHARS, """c AS (SELECT s.*, std / mean AS cv, pct, CASE WHEN abs(ac7) > 0.5 THEN 'weekly'
  WHEN abs(ac30) > 0.5 THEN 'monthly' WHEN abs(ac365) > 0.5 THEN 'yearly' ELSE 'none' END AS season
  FROM stats s JOIN outliers o ON s.series_id = o.series_id)""") + """SELECT * FROM (
  SELECT series_id, 1 AS no, 'info' AS type, 'Data spans ' || a || ' to ' || b || ' (' || n || ' observations).' AS text FROM c
  UNION ALL SELECT series_id, 2, CASE WHEN slope / mean * 100 < -1 THEN 'warning' ELSE 'info' END,
    CASE WHEN slope / mean * 100 > 1 THEN 'Upward trend: use models with a trend component.' WHEN slope / mean * 100 < -1
      THEN 'Downward trend: look for causes; damped trends may help.' ELSE 'No strong trend: simple models will do.' END FROM c
  UNION ALL SELECT series_id, 3, 'info', CASE WHEN season <> 'none' THEN 'Clear ' || season || ' seasonality: use seasonal models.'
    ELSE 'No strong seasonality: non-seasonal models may do.' END FROM c
  UNION ALL SELECT series_id, 4, CASE WHEN cv > 0.5 THEN 'warning' ELSE 'info' END,
    CASE WHEN cv > 0.5 THEN 'High volatility (CV=' || printf('%.1f', round(cv * 100, 1)) || '%): boosted trees cope better.'
      ELSE 'Low volatility (CV=' || printf('%.1f', round(cv * 100, 1)) || '%): simple methods work well.' END FROM c WHERE cv > 0.5 OR cv < 0.2
  UNION ALL SELECT series_id, 5, 'warning', printf('%.1f', round(pct, 1)) || '% outliers: use robust models or clean the data.' FROM c WHERE pct > 5)""")
def v16(spark: SparkSession, folder: str) -> DataFrame:
    return profile.insights(profile.characteristics(region_panel(spark, folder)))


@query("v17_recommend", i.with_sql(i.REGION, CHARS) + """SELECT series_id, model, max(score) AS score,
  CAST(row_number() OVER (PARTITION BY series_id ORDER BY max(score) DESC, min(rule)) AS INTEGER) AS rank FROM (
  SELECT s.series_id, 'lightgbm' AS model, 0.88::DOUBLE AS score, 3 AS rule FROM stats s WHERE std / mean > 0.5
  UNION ALL SELECT series_id, 'xgboost', 0.85, 4 FROM stats WHERE std / mean > 0.5
  UNION ALL SELECT series_id, 'wma', 0.82, 5 FROM stats WHERE std / mean < 0.2
  UNION ALL SELECT series_id, 'ets', 0.80, 6 FROM stats WHERE std / mean < 0.2
  UNION ALL SELECT series_id, unnest(['prophet', 'sarimax', 'stl', 'theta']), unnest([0.92, 0.85, 0.82, 0.78]), unnest([7, 8, 9, 10])
    FROM stats WHERE abs(ac7) > 0.5 OR abs(ac30) > 0.5 OR abs(ac365) > 0.5
  UNION ALL SELECT series_id, 'arima', 0.78, 11 FROM stats
  UNION ALL SELECT series_id, unnest(['prophet', 'stl']), unnest([0.83, 0.80]), unnest([18, 19]) FROM outliers WHERE pct > 5
  UNION ALL SELECT series_id, 'theta', 0.7, 20 FROM stats) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY max(score) DESC, min(rule)) <= 5""")
def v17(spark: SparkSession, folder: str) -> DataFrame:
    chars = profile.characteristics(region_panel(spark, folder)).withColumn("stationary", F.lit(True))
    return profile.recommend(chars)


@query("v17_recommend_from_cv", i.with_sql(*ms.CV_PARTS, """scored AS (SELECT c.series_id, model,
    round(greatest(least(1 - mae / mean, 0.98), 0.5), 4) AS score, mae FROM (SELECT series_id, model, avg(mae) AS mae FROM (
    SELECT * FROM wma_folds UNION ALL SELECT * FROM naive_folds) GROUP BY 1, 2 HAVING count(*) >= 2) c
    JOIN (SELECT series_id, avg(y) AS mean FROM region_panel GROUP BY 1) m ON c.series_id = m.series_id)""") + """
  SELECT series_id, model, score, CAST(row_number() OVER (PARTITION BY series_id ORDER BY score DESC, mae, model) AS INTEGER) AS rank FROM scored""")
def v17_cv(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    folds = ranking.union_all([evaluate.cross_validate(panel, m) for m in (WMA(), Naive())])
    return profile.recommend_from_cv(profile.characteristics(panel), evaluate.fold_summary(folds))


@query("v18_pattern_stats", i.with_sql(i.EVENT) + """SELECT series_id, count(*) AS n_points, count(DISTINCT ds) AS n_unique_dates,
  avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS sparsity, round(var_samp(y), 6) AS variance, round(stddev_samp(y) / avg(y), 8) AS cv
  FROM event_panel GROUP BY 1""")
def v18(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.pattern_profile(event_panel(spark, folder).select("series_id", "ds", "y"))
    return out.select("series_id", "n_points", "n_unique_dates", "sparsity", F.round("variance", 6).alias("variance"), F.round("cv", 8).alias("cv"))


_CORRS = {p: f"corr(d, lag_{p})" for p in (7, 14, 30, 365)}


@query("v19_season_strength", i.with_sql(i.REGION, """moved AS (SELECT * FROM (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS d
    FROM region_panel) WHERE d IS NOT NULL), lagged AS (SELECT *, """ + ", ".join(
    f"lag(d, {p}) OVER (PARTITION BY series_id ORDER BY ds) AS lag_{p}" for p in _CORRS) + " FROM moved), scored AS ("
    + " UNION ALL ".join(f"SELECT series_id, {p} AS period, {c} AS r FROM lagged GROUP BY 1" for p, c in _CORRS.items()) + ")")
  + """SELECT s.series_id, CAST(arg_max(period, r) FILTER (WHERE r > 0) AS INTEGER) AS seasonal_period,
  round(coalesce(max(r) FILTER (WHERE r > 0), 0), 8) AS seasonal_strength FROM scored s GROUP BY 1""")
def v19(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.season_strength(region_panel(spark, folder))
    return out.withColumn("seasonal_strength", F.round("seasonal_strength", 8))


@query("v20_linear_trend", i.with_sql(i.REGION, CHARS) + """SELECT series_id, CASE WHEN r2 > 0.2 THEN 'linear' WHEN abs(ac1) < 0.05 THEN 'none'
  ELSE 'unknown' END AS trend_type, CASE WHEN r2 > 0.2 THEN round(r2, 8) ELSE 0 END AS trend_strength,
  CASE WHEN r2 > 0.2 THEN round(slope, 6) ELSE 0 END AS trend_slope FROM stats""")
def v20(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.linear_trend(region_panel(spark, folder))
    return out.withColumns({"trend_strength": F.round("trend_strength", 8), "trend_slope": F.round("trend_slope", 6)})


_LAG_ROWS = " UNION ALL ".join(
    f"SELECT series_id, {k} AS lag, count(*) AS n, corr(y, l) AS r FROM (SELECT *, lag(y, {k}) OVER (PARTITION BY series_id ORDER BY ds) AS l FROM brand_panel) GROUP BY 1"
    for k in range(1, 31))


@query("v21_significant_lags", i.with_sql(i.BRAND, f"lags AS ({_LAG_ROWS})") + """SELECT series_id,
  coalesce(string_agg(CASE WHEN abs(r) > 1.96 / sqrt(n) THEN lag END, ',' ORDER BY lag), '') AS peaks,
  sum(CASE WHEN lag <= 3 THEN abs(r) END) / 3 > 2 * 1.96 / sqrt(max(n)) AS has_ar,
  count(*) FILTER (WHERE abs(r) > 1.96 / sqrt(n)) <= 2 AS has_ma FROM lags GROUP BY 1""")
def v21(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.memory_signature(brand_panel(spark, folder).select("series_id", "ds", "y"))
    return out.select("series_id", F.array_join("acf_peaks", ",").alias("peaks"), "has_ar", "has_ma")


@query("v22_full_report")
def v22(spark: SparkSession, folder: str) -> DataFrame:
    report = profile.analyze(i.regions(spark, folder))
    best = report["recommendations"].filter(F.col("rank") == 1).select("series_id", F.col("model").alias("best_model"))
    return (
        report["characteristics"].join(report["frequencies"].select("series_id", "validation", "season_length"), "series_id")
        .join(report["orders"].select("series_id", "p", "d", "q"), "series_id").join(best, "series_id")
        .crossJoin(report["validation"])  # one row
    )


@query("v22_validation", i.with_sql(i.REGION) + """SELECT 'ds' AS date_column, 'y' AS value_column, count(*) AS row_count,
  count(DISTINCT ds) AS unique_dates, count(*) FILTER (WHERE y IS NULL) AS missing, true AS valid, count(DISTINCT ds) < 14 AS is_short FROM region_panel""")
def v22_validation(spark: SparkSession, folder: str) -> DataFrame:
    return profile.analyze(i.regions(spark, folder))["validation"]


# --- scalar functions ----------------------------------------------------------------------


@query("f1_clamp", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN greatest(least(o_totalprice / 100000, 4.0), 1.5) END AS v FROM orders""")
def f1(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice") / 100000)
    return scan(spark, folder, "orders").select("o_orderkey", sc.clamp(value, 1.5, 4.0).alias("v"))


@query("f2_accuracy_grade", f"""SELECT l_orderkey, l_linenumber, acc AS accuracy, {ms.GRADE.format(a='acc')} AS grade FROM (
  SELECT *, greatest(least(100 - l_quantity * 2.5, 100), 0) AS acc FROM lineitem)""")
def f2(spark: SparkSession, folder: str) -> DataFrame:
    accuracy = sc.accuracy_pct(F.col("l_quantity") * 2.5)
    return scan(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", accuracy.alias("accuracy"), sc.accuracy_grade(accuracy).alias("grade")
    )


@query("f3_uplift", """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0 THEN 0 ELSE (l_discount - l_tax) / abs(l_tax) * 100 END, 6)
  AS uplift FROM lineitem""")
def f3(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(sc.uplift_pct("l_discount", "l_tax"), 6).alias("uplift")
    )


@query("f4_impact_pct", """SELECT l_orderkey, l_linenumber, round((l_quantity / 10 - 1) * 100, 1) AS impact_pct FROM lineitem""")
def f4(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", sc.impact_pct(F.col("l_quantity") / 10).alias("impact_pct")
    )


@query("f5_strength_label", """SELECT strength, count(*) AS n FROM (SELECT CASE WHEN r > 0.5 THEN 'strong' WHEN r > 0.3 THEN 'moderate'
  ELSE 'weak' END AS strength FROM (SELECT abs(l_discount * 10 - l_tax * 10) AS r FROM lineitem)) GROUP BY 1""")
def f5(spark: SparkSession, folder: str) -> DataFrame:
    label = sc.strength_label(F.col("l_discount") * 10 - F.col("l_tax") * 10)
    return scan(spark, folder, "lineitem").groupBy(label.alias("strength")).agg(F.count(F.lit(1)).alias("n"))


@query("f6_rank_weights", i.with_sql(i.EVENT) + """SELECT series_id, ds, round(2.0 * rk / (n * (n + 1)), 10) AS weight FROM (SELECT *,
  row_number() OVER (PARTITION BY series_id ORDER BY ds) AS rk, count(*) OVER (PARTITION BY series_id) AS n FROM event_panel)""")
def f6(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.grid import along
    from pyspark.sql.window import Window

    sized = event_panel(spark, folder).withColumns(
        {"rk": F.row_number().over(along()), "n": F.count(F.lit(1)).over(Window.partitionBy("series_id"))}
    )
    return sized.select("series_id", "ds", F.round(sc.rank_weight("rk", "n"), 10).alias("weight"))


@query("f7_pct_change", i.with_sql(i.REGION) + """SELECT series_id, ds, round((y - p) / p, 8) AS change FROM (SELECT *,
  lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS p FROM region_panel)""")
def f7(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.grid import along

    panel = region_panel(spark, folder).withColumn("p", F.lag("y").over(along()))
    return panel.select("series_id", "ds", F.round(sc.pct_change("y", "p"), 8).alias("change"))


@query("f8_composite_key", """SELECT p_partkey, p_type || ' ||| ' || p_brand || ' ||| ' || p_size AS key, p_type AS type, p_brand AS brand,
  CAST(p_size AS VARCHAR) AS size FROM part""")
def f8(spark: SparkSession, folder: str) -> DataFrame:
    keyed = scan(spark, folder, "part").select("p_partkey", sc.composite_key("p_type", "p_brand", "p_size").alias("key"))
    return keyed.select("p_partkey", "key", *sc.split_key("key", ["type", "brand", "size"]))


@query("f9_date_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def f9(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "orders").select("o_orderkey", sc.date_text("o_orderdate").alias("day"))


@query("f10_safe_ratio", """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN -1 ELSE l_tax / l_discount END, 8) AS ratio FROM lineitem""")
def f10(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(sc.ratio("l_tax", "l_discount", -1.0), 8).alias("ratio")
    )


@query("f11_residuals", i.with_sql(*ms.CV_PARTS) + """SELECT h.series_id, fold, ds, round(y - yhat, 4) AS residual FROM cv_hold h
  JOIN (SELECT series_id, step, yhat FROM wma_forecast) f ON h.key = f.series_id AND h.step = f.step""")
def f11(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.cv_folds(i.regions(spark, folder))
    keyed = rows.withColumn("key", sc.composite_key("series_id", "fold"))
    model = WMA()
    train = keyed.filter("role = 'train'").select(F.col("key").alias("series_id"), "ds", "y")
    forecast = model.forecast(model.fit(train), 7).select(F.col("series_id").alias("key"), "step", "yhat")
    joined = keyed.filter("role = 'test'").join(forecast, ["key", "step"])
    return joined.select("series_id", F.col("fold").cast("long").alias("fold"), "ds", F.round(sc.residual("y", "yhat"), 4).alias("residual"))
