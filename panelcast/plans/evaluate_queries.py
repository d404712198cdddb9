"""Queries for evaluation, tuning, scenarios and the learned models (X, M, P)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import run as runs
from .. import store
from ..functions.scalars import composite_key
from ..models.additive import AdditiveRegression, rank_contributions
from ..models.arima import ARIMA, SARIMAX
from ..models.auto import AutoML, Hybrid, route
from ..models.base import with_baseline
from ..models.boosted import Boosted, boosted_rows
from ..models.smoothing import Theta
from ..models.wma import WMA, Naive
from ..operators import decompose as dc
from ..operators import evaluate as ev
from ..operators import scenario as sn
from ..operators.ranking import union_all
from ..operators.rollup import category_series
from ..operators.tuning import tune
from ..sources.tables import brand_panel, brand_sales, event_panel, region_panel
from ..store import materialize
from . import events_sql as es
from . import inputs as i
from . import model_sql as ms
from .event_queries import WEIGHTED
from .join_queries import BACKTEST
from .model_queries import BAND, SEASONAL_PARAMS, WEIGHTS, WITH_PARAMS, rounded, waves_sql
from .registry import query

METRICS = ("mae", "rmse", "mape", "r2")


def round_metrics(df: DataFrame) -> DataFrame:
    present = [c for m in METRICS for c in (m, f"{m}_std") if c in df.columns]
    return df.withColumns({c: F.round(c, 8 if c.startswith("r2") else 4) for c in present})


def metric_sql(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{m}, {8 if m == 'r2' else 4}) AS {m}" for m in METRICS)


# --- splits, folds, metrics ----------------------------------------------------------------


@query("x1_split", i.with_sql(i.REGION) + """SELECT series_id, ds, y, CASE WHEN n >= 10 THEN CASE WHEN idx >= n - least(greatest(1, CAST(floor(n * 0.19999999999999996::DOUBLE) AS BIGINT)), n - 5)
  THEN 'test' ELSE 'train' END END AS split FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx,
  count(*) OVER (PARTITION BY series_id) AS n FROM region_panel)""")
def x1(spark: SparkSession, folder: str) -> DataFrame:
    return ev.split_panel(region_panel(spark, folder), 0.8)


@query("x1_split_by_horizon", i.with_sql(i.EVENT) + """SELECT series_id, ds, y, CASE WHEN idx >= n - least(7, greatest(1, n // 5)) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM event_panel)""")
def x1_horizon(spark: SparkSession, folder: str) -> DataFrame:
    return ev.split_panel(event_panel(spark, folder).select("series_id", "ds", "y"), horizon=7)


_FOLD_ROWS = """SELECT series_id, CAST(fold AS INTEGER) AS fold, CASE WHEN idx < train_end THEN 'train' ELSE 'test' END AS role, ds, y,
  CAST(CASE WHEN idx >= train_end THEN idx - train_end + 1 END AS INTEGER) AS step FROM {t} WHERE idx < train_end + size"""


@query("x2_cv_folds", i.with_sql(i.REGION, *ms.cv_rows("region_panel")) + _FOLD_ROWS.format(t="cv_all"))
def x2(spark: SparkSession, folder: str) -> DataFrame:
    return ev.cv_folds(region_panel(spark, folder))


@query("x3_tuning_folds", i.with_sql(i.REGION, """sized AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx,
    count(*) OVER (PARTITION BY series_id) AS n FROM region_panel),
  tuned AS (SELECT s.*, fold, size, 30 + fold * size AS train_end FROM (SELECT *, least(greatest(1, (n - 30) // 6), greatest(1, n // 7)) AS size
    FROM sized WHERE n >= 35) s CROSS JOIN (SELECT unnest(range(1, 6)) AS fold) WHERE 30 + (fold + 1) * size <= n)""") + _FOLD_ROWS.format(t="tuned"))
def x3(spark: SparkSession, folder: str) -> DataFrame:
    return ev.tuning_folds(region_panel(spark, folder))


@query("x4_fold_metrics", i.with_sql(*ms.CV_PARTS) + f"""SELECT series_id, CAST(fold AS INTEGER) AS fold, model, {metric_sql()}, rows FROM (
  SELECT * FROM wma_folds UNION ALL SELECT * FROM naive_folds)""")
def x4(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    return round_metrics(union_all([ev.cross_validate(panel, m) for m in (WMA(), Naive())]))


@query("x5_fold_summary", i.with_sql(*ms.CV_PARTS) + "SELECT series_id, model, count(*) AS n_folds, " + ", ".join(
    f"round(avg({m}), {8 if m == 'r2' else 4}) AS {m}, round(stddev_pop({m}), {8 if m == 'r2' else 4}) AS {m}_std" for m in METRICS)
  + " FROM (SELECT * FROM wma_folds UNION ALL SELECT * FROM naive_folds) GROUP BY 1, 2")
def x5(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    return round_metrics(ev.fold_summary(union_all([ev.cross_validate(panel, m) for m in (WMA(), Naive())])))


@query("x6_backtest_split", i.with_sql(i.REGION, *BACKTEST) + "SELECT series_id, ds, y, split FROM bt_split")
def x6(spark: SparkSession, folder: str) -> DataFrame:
    return ev.backtest_split(region_panel(spark, folder))


@query("x6_backtest_by_days", i.with_sql(i.REGION, """sized AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, count(*) OVER s AS n,
  max(ds) OVER s AS last_day FROM region_panel WINDOW s AS (PARTITION BY series_id))""") + """SELECT series_id, ds, y,
  CASE WHEN ds >= last_day - 60 AND idx >= 5 THEN 'test' ELSE 'train' END AS split FROM sized""")
def x6_days(spark: SparkSession, folder: str) -> DataFrame:
    return ev.backtest_split(region_panel(spark, folder), overlap=60)


BACKTEST_ROWS = [
    i.REGION, *BACKTEST, "bt_sizes AS (SELECT series_id, count(*) AS test_rows FROM bt_test GROUP BY 1)",
    *ms.wma("bt_train", 600, name="bw"), *ms.naive("bt_train", 600, name="bn"),
    """bt_rows AS (SELECT f.series_id, f.ds, step, model, yhat, lower_ci, upper_ci, y FROM (
      SELECT series_id, ds, step, 'wma' AS model, yhat, lower_ci, upper_ci FROM bw_forecast
      UNION ALL SELECT series_id, ds, step, 'naive', yhat, lower_ci, upper_ci FROM bn_forecast) f
      JOIN bt_sizes s ON s.series_id = f.series_id AND f.step <= test_rows JOIN bt_test t ON t.series_id = f.series_id AND t.ds = f.ds)""",
    """bt_metrics AS (SELECT series_id, model, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse,
      avg(abs(yhat - y) / greatest(abs(y), 1e-9) * 100) AS mape, 1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*)) AS r2, count(*) AS rows
      FROM bt_rows GROUP BY 1, 2)""",
]


def region_backtest(spark: SparkSession, folder: str) -> DataFrame:
    return ev.backtest(i.regions(spark, folder), [WMA(), Naive()])


@query("x7_backtest_metrics", i.with_sql(*BACKTEST_ROWS) + f"""SELECT series_id, model, {metric_sql()}, rows,
  round(greatest(least(100 - mape, 100), 0), 4) AS accuracy, {ms.GRADE.format(a='greatest(least(100 - mape, 100), 0)')} AS grade FROM bt_metrics""")
def x7(spark: SparkSession, folder: str) -> DataFrame:
    out = ev.graded(ev.error_metrics(region_backtest(spark, folder), ["series_id", "model"]))
    return round_metrics(out).withColumn("accuracy", F.round("accuracy", 4))


@query("x8_ensemble_backtest", i.with_sql(*BACKTEST_ROWS, *ms.CV_PARTS[1:], WEIGHTS) + """SELECT b.series_id, ds, round(sum(yhat * weight) / sum(weight), 4) AS yhat,
  round(min(lower_ci), 4) AS lower_ci, round(max(upper_ci), 4) AS upper_ci, 'ensemble' AS model FROM bt_rows b JOIN weights w ON b.series_id = w.series_id AND b.model = w.model GROUP BY 1, 2""")
def x8(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    folds = union_all([ev.cross_validate(panel, m) for m in (WMA(), Naive())])
    weights = ev.inverse_error_weights(ev.fold_summary(folds).select("series_id", "model", "mae"))
    return rounded(ev.combine_forecasts(region_backtest(spark, folder), weights), 4, *BAND)


@query("x9_holdout_boosted")
def x9(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder).filter(F.col("ds").isNotNull())
    model = Boosted()
    tests = ev.graded(ev.error_metrics(ev.holdout(panel, [model]), ["series_id", "model"]))
    refit = model.forecast(model.fit(panel), 3)  # the final model uses all rows
    return refit.join(tests, "series_id")


@query("x10_rank_from_test", i.with_sql(*BACKTEST_ROWS, *ms.CV_PARTS[1:], """merged AS (SELECT c.series_id, c.model, coalesce(t.mae, c.mae) AS mae,
    coalesce(t.rmse, c.rmse) AS rmse, coalesce(t.mape, c.mape) AS mape, coalesce(t.r2, c.r2) AS r2, CASE WHEN t.mae IS NULL THEN 'cv' ELSE 'test' END AS source FROM (
    SELECT series_id, model, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, avg(r2) AS r2 FROM (SELECT * FROM wma_folds UNION ALL SELECT * FROM naive_folds)
    GROUP BY 1, 2 HAVING count(*) >= 2) c LEFT JOIN (SELECT * FROM bt_metrics WHERE model = 'wma') t ON c.series_id = t.series_id AND c.model = t.model)""") + f"""
  SELECT series_id, model, {metric_sql()}, source, CAST(row_number() OVER (PARTITION BY series_id ORDER BY mae, model) AS INTEGER) AS rank,
  round(1 / (mae + 1), 9) AS score, round(greatest(least(100 - mape, 100), 0), 4) AS accuracy, {ms.GRADE.format(a='greatest(least(100 - mape, 100), 0)')} AS grade FROM merged""")
def x10(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    cv = ev.fold_summary(union_all([ev.cross_validate(panel, m) for m in (WMA(), Naive())]))
    test = ev.error_metrics(region_backtest(spark, folder).filter(F.col("model") == "wma"), ["series_id", "model"])
    out = round_metrics(ev.rank_from_test(test, cv))
    return out.withColumns({"score": F.round("score", 9), "accuracy": F.round("accuracy", 4)})


# --- tuning and seasonal parameters ---------------------------------------------------------


TUNED_FOLDS = """sized AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM region_panel),
  windows AS (SELECT unnest([4, 8, 12, 20, 30, 52]) AS w, unnest(range(6)) AS candidate),
  grid AS (SELECT s.*, fold, w, candidate, size, 30 + fold * size AS train_end, s.series_id || '#' || w || '#' || fold AS key FROM (
    SELECT *, least(greatest(1, (n - 30) // 6), greatest(1, n // 7)) AS size FROM sized WHERE n >= 35) s
    CROSS JOIN (SELECT unnest(range(1, 6)) AS fold) CROSS JOIN windows WHERE 30 + (fold + 1) * size <= n),
  grid_train AS (SELECT key AS series_id, ds, y, w FROM grid WHERE idx < train_end)"""


def best_windows(multiplier: str | None = None) -> list[str]:
    """CTEs up to ``best_window``: each series' window with the smallest mean MAE over the tuning folds."""
    return [TUNED_FOLDS, *ms.wma("grid_train", 500, multiplier, name="tuned", window="w"), """window_folds AS (SELECT g.series_id, w, candidate, fold, avg(abs(yhat - y)) AS mae,
    sqrt(avg((yhat - y) * (yhat - y))) AS rmse, avg(least(abs(yhat - y) / greatest(abs(y), 1e-9) * 100, 1000)) AS mape
    FROM grid g JOIN tuned_forecast f ON f.series_id = key AND f.step = idx - train_end + 1 WHERE idx >= train_end AND idx < train_end + size GROUP BY 1, 2, 3, 4),
  best_window AS (SELECT series_id, w, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, count(*) AS n_folds FROM window_folds GROUP BY series_id, w, candidate
    HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY avg(mae), candidate) = 1)"""]


@query("x11_tune_wma", i.with_sql(i.REGION, *best_windows()) + f"""SELECT series_id, 'wma' AS model, '{{"window":"' || w || '"}}' AS params,
  round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape, n_folds FROM best_window""")
def x11(spark: SparkSession, folder: str) -> DataFrame:
    return round_metrics(tune(i.regions(spark, folder), "wma")).withColumn("params", F.to_json("params"))


@query("x11_tune_halving")
def x11_halving(spark: SparkSession, folder: str) -> DataFrame:
    return tune(i.regions(spark, folder), "theta", halving=True).withColumn("params", F.to_json("params"))


# the additive decomposition at each series' own strongest period, and its strength
OWN_PARTS = """own AS (SELECT t.series_id, ds, y, idx, n, p1 AS p, p1 // 2 AS half, sum(y) OVER (PARTITION BY t.series_id ORDER BY ds) AS total FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM region_panel) t
    JOIN first1 f ON f.series_id = t.series_id),
  own_trend AS (SELECT o.*, (a.total - b.total + b.y) / o.p AS trend FROM own o LEFT JOIN own a ON a.series_id = o.series_id AND a.idx = o.idx + o.half
    LEFT JOIN own b ON b.series_id = o.series_id AND b.idx = o.idx - o.half WHERE o.n >= 2 * o.p),
  own_raw AS (SELECT *, coalesce(avg(CASE WHEN trend <> 0 THEN y - trend END) OVER (PARTITION BY series_id, idx % p), 0) AS raw FROM own_trend),
  own_parts AS (SELECT *, raw - sum(CASE WHEN idx < p THEN raw END) OVER (PARTITION BY series_id) / p AS seasonal FROM own_raw),
  strengths AS (SELECT series_id, greatest(0, coalesce(1 - var_pop(y - trend - seasonal) / var_pop(y - trend), 0)) AS strength FROM own_parts GROUP BY 1)"""
OWN_PARAMS = SEASONAL_PARAMS.format(params="auto_params", first="first1", second="first2")
MERGED = """merged AS (SELECT a.series_id, model, '{' || concat_ws(',',
    CASE WHEN strength > 0.15 THEN '"seasonal_periods":"' || seasonal_periods || '"' END,
    CASE WHEN strength > 0.15 THEN '"seasonal_period":"' || seasonal_period || '"' END,
    CASE WHEN strength > 0.15 THEN '"yearly_seasonality":"' || yearly_seasonality || '"' END,
    CASE WHEN strength > 0.15 THEN '"weekly_seasonality":"' || weekly_seasonality || '"' END,
    CASE model WHEN 'ets' THEN '"trend":"add"' WHEN 'wma' THEN '"window":"12"' END) || '}' AS params
    FROM auto_params a JOIN strengths s ON a.series_id = s.series_id)"""


def own_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Automatic parameters of each series and model under the user's."""
    panel = i.regions(spark, folder)
    periods = materialize(dc.spectral_periods(panel))
    own = panel.join(periods.select("series_id", F.get("periods", F.lit(0)).alias("own_period")), "series_id")
    strength = dc.seasonal_strength(dc.classical(own.filter(F.col("own_period").isNotNull()), None))
    return dc.merged_params(dc.seasonal_params(periods, WITH_PARAMS), strength, {"ets": {"trend": "add"}, "wma": {"window": "12"}})


@query("x12_merged_params", i.with_sql(i.REGION, waves_sql("region_panel"), OWN_PARTS, OWN_PARAMS, MERGED) + "SELECT * FROM merged")
def x12(spark: SparkSession, folder: str) -> DataFrame:
    return own_settings(spark, folder).select("series_id", "model", F.to_json("params").alias("params"))


# theta with a cycle per series: column p of own_cycle
OWN_THETA = """own_cycle AS (SELECT f.series_id, CASE WHEN strength > 0.15 THEN p1 ELSE 7 END AS p FROM first1 f JOIN strengths s ON f.series_id = s.series_id),
  tx AS (SELECT t.*, p FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM region_panel) t
    JOIN own_cycle c ON c.series_id = t.series_id),
  ts AS (SELECT *, avg(y) OVER (PARTITION BY series_id, idx % p) / avg(y) OVER (PARTITION BY series_id) AS season FROM tx),
  tf AS (SELECT series_id, max(ds) AS last_ds, max(n) AS n, max(p) AS p, regr_slope(y / season, idx) AS slope,
    sum(0.2 * pow(0.8, n - 1 - idx) * y / season) + max(CASE WHEN idx = 0 THEN pow(0.8, n) * y / season END) AS level FROM ts GROUP BY 1),
  tp AS (SELECT DISTINCT series_id, idx % p AS phase, season FROM ts), tg AS (SELECT *, CAST(unnest(range(1, 15)) AS INTEGER) AS step FROM tf)"""


@query("x12_own_theta", i.with_sql(i.REGION, waves_sql("region_panel"), OWN_PARTS, OWN_THETA) + """SELECT g.series_id, step, CAST(last_ds + step AS DATE) AS ds,
  round((level + 0.5 * slope * (step - 1 + (1 - pow(0.8, n)) / 0.2)) * season, 3) AS yhat, CAST(g.p AS INTEGER) AS cycle FROM tg g
  JOIN tp p ON g.series_id = p.series_id AND p.phase = (n + step - 1) % g.p""")
def x12_theta(spark: SparkSession, folder: str) -> DataFrame:
    model, settings = Theta(alpha=0.2), own_settings(spark, folder).filter(F.col("model") == "theta")
    fitted = model.fit(region_panel(spark, folder), settings=settings)
    out = model.forecast(fitted, 14).join(fitted.select("series_id", "cycle"), "series_id")
    return out.select("series_id", "step", "ds", F.round("yhat", 3).alias("yhat"), "cycle")


@query("x12_own_wma", i.with_sql(i.REGION, """own_window AS (SELECT series_id, 7 + length(series_id) AS w FROM (SELECT DISTINCT series_id FROM region_panel)),
  own_panel AS (SELECT p.*, w FROM region_panel p JOIN own_window o ON p.series_id = o.series_id)""", *ms.wma("own_panel", 7, window="w")) + """
  SELECT series_id, step, ds, round(yhat, 4) AS yhat FROM wma_forecast""")
def x12_wma(spark: SparkSession, folder: str) -> DataFrame:
    panel = i.regions(spark, folder)
    window = F.create_map(F.lit("window"), (7 + F.length("series_id")).cast("string"))
    settings = panel.select("series_id").distinct().withColumn("params", window)
    out = WMA().forecast(WMA().fit(panel, settings=settings), 7)
    return out.select("series_id", "step", "ds", F.round("yhat", 4).alias("yhat"))


# --- scenarios ----------------------------------------------------------------------------


EVENT_MULTIPLIER = """event_multiplier AS (SELECT CAST(ds + 30 AS DATE) AS ds, product(event_impact) AS multiplier FROM promo_events GROUP BY 1)"""


def future_factors(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    shifted = i.promo_events(spark, folder).withColumn("ds", F.date_add("ds", 30))
    return {"holidays": ms.shifted_holidays(spark, folder), "events": shifted}


TWO_FACTORS = [
    i.REGION, i.HOLIDAYS, i.EVENTS, *ms.wma("region_panel", 60, "holiday_multiplier", name="hol"),
    EVENT_MULTIPLIER, *ms.wma("region_panel", 60, "event_multiplier", name="evt"),
    """contributions AS (SELECT series_id, 'holidays' AS factor, sum(yhat - baseline) AS total FROM hol_forecast GROUP BY 1
      UNION ALL SELECT series_id, 'events', sum(yhat - baseline) FROM evt_forecast GROUP BY 1)""",
]


def contributions(spark: SparkSession, folder: str) -> DataFrame:
    model = WMA()
    return sn.factor_contributions(model, model.fit(i.regions(spark, folder)), 60, "D", future_factors(spark, folder))


@query("x13_factor_contributions", i.with_sql(*TWO_FACTORS) + """SELECT series_id, factor, round(total, 4) AS total, round(total / 60, 4) AS average,
  CASE WHEN total > 0 THEN 'positive' ELSE 'negative' END AS direction FROM contributions""")
def x13(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(contributions(spark, folder), 4, "total", "average")


@query("x14_sorted_contributions", i.with_sql(*TWO_FACTORS) + """SELECT series_id, factor, round(total, 4) AS total,
  CAST(row_number() OVER (PARTITION BY series_id ORDER BY abs(total) DESC, factor) AS INTEGER) AS rank, round(sum(total) OVER (PARTITION BY series_id), 4) AS all_factors FROM contributions""")
def x14(spark: SparkSession, folder: str) -> DataFrame:
    out = sn.sorted_contributions(contributions(spark, folder))
    return rounded(out.select("series_id", "factor", "total", "rank", "all_factors"), 4, "total", "all_factors")


WHAT_IF = [
    i.REGION, i.HOLIDAYS, *ms.wma("region_panel", 60, "holiday_multiplier", name="org"),
    """scenario_multiplier AS (SELECT CAST(ds + 30 AS DATE) AS ds, product(holiday_impact * 1.5 + 0.1) AS multiplier FROM holidays GROUP BY 1)""",
    *ms.wma("region_panel", 60, "scenario_multiplier", name="scn"),
]


def what_if_rows(spark: SparkSession, folder: str) -> DataFrame:
    model = WMA()
    factors = {"holidays": ms.shifted_holidays(spark, folder)}
    rules = {"holidays": {"holiday_impact_multiplier": 1.5, "holiday_impact_add": 0.1}, "unknown": {"multiplier": 2.0}}
    return sn.what_if(model, model.fit(i.regions(spark, folder)), 60, "D", factors, rules)


@query("x15_what_if", i.with_sql(*WHAT_IF) + """SELECT o.series_id, o.ds, round(o.yhat, 4) AS original, round(s.yhat, 4) AS scenario,
  round(s.yhat - o.yhat, 4) AS difference, round((s.yhat - o.yhat) / abs(o.yhat) * 100, 8) AS change_pct
  FROM org_forecast o JOIN scn_forecast s ON o.series_id = s.series_id AND o.ds = s.ds""")
def x15(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(what_if_rows(spark, folder), 4, "original", "scenario", "difference"), 8, "change_pct")


@query("x16_scenario_totals", i.with_sql(*WHAT_IF) + """SELECT series_id, round(o, 3) AS original, round(s, 3) AS scenario, round(s - o, 3) AS difference,
  round((s - o) / abs(o) * 100, 8) AS change_pct FROM (SELECT o.series_id, sum(o.yhat) AS o, sum(s.yhat) AS s FROM org_forecast o
  JOIN scn_forecast s ON o.series_id = s.series_id AND o.ds = s.ds GROUP BY 1)""")
def x16(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(sn.scenario_totals(what_if_rows(spark, folder)), 3, "original", "scenario", "difference"), 8, "change_pct")


# --- model table and runs -------------------------------------------------------------------


@query("x17_train_and_save")
def x17(spark: SparkSession, folder: str) -> DataFrame:
    root = store.scratch_path(spark, "models")
    stored, metrics = runs.train_and_save(i.regions(spark, folder), root, ["wma", "theta", "naive"], runs.ForecastRequest())
    return with_stored(spark, root, stored, metrics)


def with_stored(spark: SparkSession, root: str, stored: dict[str, str], metrics: DataFrame) -> DataFrame:
    """Metrics of every model and the model that each series has in the store."""
    kept = spark.read.parquet(f"{root}/parameters").filter(F.col("model_id").isin(list(stored.values())))
    models = store.list_models(spark, root).select("model_id", F.col("model_type").alias("stored"))
    return metrics.join(kept.select("series_id", "model_id").join(models, "model_id").drop("model_id"), "series_id", "left")


HOLDOUT_ROWS = [
    i.REGION, """bt_split AS (SELECT series_id, ds, y, CASE WHEN idx >= n - least(greatest(1, CAST(floor(n * 0.19999999999999996::DOUBLE) AS BIGINT)), n - 5)
      THEN 'test' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx,
      count(*) OVER (PARTITION BY series_id) AS n FROM region_panel) WHERE n >= 10)""",
    "bt_train AS (SELECT series_id, ds, y FROM bt_split WHERE split = 'train')", "bt_test AS (SELECT series_id, ds, y FROM bt_split WHERE split = 'test')",
    *BACKTEST_ROWS[1 + len(BACKTEST):],
]


@query("x17_best_per_series", i.with_sql(*HOLDOUT_ROWS) + f"""SELECT series_id, model, {metric_sql()}, rows,
  first_value(model) OVER (PARTITION BY series_id ORDER BY mae, model) AS stored FROM bt_metrics""")
def x17_best(spark: SparkSession, folder: str) -> DataFrame:
    root = store.scratch_path(spark, "models")
    stored, metrics = runs.train_and_save(i.regions(spark, folder), root, ["wma", "naive"], runs.ForecastRequest())
    return round_metrics(with_stored(spark, root, stored, metrics))


@query("x18_save_model", i.with_sql(i.REGION, *ms.wma("region_panel", 1)) + """SELECT f.series_id, 'm1' AS model_id, CAST(64 AS INTEGER) AS hash_length, true AS intact, last_ds, f.n,
  round(mean, 4) AS mean, round(wma, 4) AS wma, round(factor, 8) AS monday FROM wma_fit f JOIN wma_dow d ON d.series_id = f.series_id AND d.dow = 0""")
def x18(spark: SparkSession, folder: str) -> DataFrame:
    """The stored parameters as they are read back from their JSON text, and its hash."""
    root = store.scratch_path(spark, "models")
    store.save_model(WMA().fit(region_panel(spark, folder)), root, "wma", "Regions", model_id="m1", tags=["daily"], notes="all regions")
    rows = spark.read.parquet(f"{root}/parameters")
    stored = {name: F.get_json_object("params", f"$.{path}") for name, path in (("last_ds", "last_ds"), ("n", "n"), ("mean", "mean"), ("wma", "wma"), ("monday", "factors[0]"))}
    return rows.select(
        "series_id", "model_id", F.length("sha256").alias("hash_length"), (F.sha2("params", 256) == F.col("sha256")).alias("intact"),
        stored["last_ds"].cast("date").alias("last_ds"), stored["n"].cast("long").alias("n"),
        F.round(stored["mean"].cast("double"), 4).alias("mean"), F.round(stored["wma"].cast("double"), 4).alias("wma"), F.round(stored["monday"].cast("double"), 8).alias("monday"),
    )


@query("x19_forecast_saved_model", i.with_sql(i.REGION, *ms.wma("region_panel", 7)) + """SELECT series_id, step, ds, round(yhat, 4) AS yhat FROM wma_forecast""")
def x19(spark: SparkSession, folder: str) -> DataFrame:
    root = store.scratch_path(spark, "models")
    model_id = store.save_model(WMA().fit(region_panel(spark, folder)), root, "wma", "Regions")
    out = WMA().forecast(store.load_model(spark, root, model_id), 7)
    return out.select("series_id", "step", "ds", F.round("yhat", 4).alias("yhat"))


@query("x20_update_model", """WITH n AS (SELECT count(DISTINCT r_name) AS count FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT 'a' AS model_id, 'Model a' AS name, '' AS tags, count FROM n UNION ALL SELECT 'b', 'Renamed', 'kept', count FROM n""")
def x20(spark: SparkSession, folder: str) -> DataFrame:
    root = store.scratch_path(spark, "models")
    fitted = Naive(0.2).fit(region_panel(spark, folder))
    for model_id in ("a", "b", "c"):
        store.save_model(fitted, root, "naive", f"Model {model_id}", model_id=model_id)
    store.update_model(spark, root, "b", name="Renamed", tags=["kept"])
    store.delete_model(spark, root, "c")
    models = store.list_models(spark, root).select("model_id", "name", F.array_join("tags", ",").alias("tags"))
    return models.join(spark.read.parquet(f"{root}/parameters").groupBy("model_id").count(), "model_id")


RUN_ROWS = [
    i.REGION, i.HOLIDAYS, *best_windows("holiday_multiplier"),
    "own_panel AS (SELECT p.*, w FROM region_panel p JOIN best_window b ON p.series_id = b.series_id)",
    *[part.replace("AS series_id, ds, y FROM cv_all", "AS series_id, ds, y, w FROM cv_all").replace("c.ds, c.y, f.fold", "c.ds, c.y, c.w, f.fold") for part in ms.cv_rows("own_panel")],
    *ms.wma("cv_train", 7, "holiday_multiplier", window="w")[1:], *ms.naive("cv_train", 7), ms.fold_metrics("wma_forecast", "wma"), ms.fold_metrics("naive_forecast", "naive"),
    WEIGHTS, *ms.wma("own_panel", 7, "holiday_multiplier", name="final_wma", window="w")[1:], *ms.naive("region_panel", 7, name="final_naive"),
    """members AS (SELECT 'wma' AS model, series_id, ds, yhat, baseline FROM final_wma_forecast
      UNION ALL SELECT 'naive', series_id, ds, yhat, yhat FROM final_naive_forecast)""",
    """combined AS (SELECT m.series_id, ds, sum(yhat * weight) / sum(weight) AS yhat, sum(baseline * weight) / sum(weight) AS baseline
      FROM members m JOIN weights w ON m.series_id = w.series_id AND m.model = w.model GROUP BY 1, 2)""",
    """totals AS (SELECT series_id, sum(yhat) AS f, sum(baseline) AS b, count(*) AS horizon FROM combined GROUP BY 1)""",
]


@query("x21_end_to_end", i.with_sql(*RUN_ROWS) + """SELECT m.series_id, model, CAST(row_number() OVER (PARTITION BY m.series_id ORDER BY m.mae, model) AS INTEGER) AS rank, round(m.mae, 4) AS mae,
  round(f, 3) AS total_forecast, round(b, 3) AS total_baseline, round(f - b, 3) AS total_uplift, horizon, w AS "window"
  FROM metrics m JOIN totals t ON m.series_id = t.series_id JOIN best_window x ON x.series_id = m.series_id""")
def x21(spark: SparkSession, folder: str) -> DataFrame:
    """A run with tuning, a factor, backtest and ensemble, in its closed-form models."""
    request = runs.ForecastRequest(models=["wma", "naive"], horizon=7, ensemble=["wma", "naive"], tune=True)
    tables = runs.run_forecast(i.regions(spark, folder), request, {"holidays": ms.shifted_holidays(spark, folder)})
    window = tables["tuning"].select("series_id", F.get_json_object("params", "$.window").cast("int").alias("window"))
    ranked = round_metrics(tables["ranking"].select("series_id", "model", "rank", "mae"))
    totals = rounded(tables["summary"].drop("model", "uplift_pct", "avg_per_step"), 3, "total_forecast", "total_baseline", "total_uplift")
    return ranked.join(totals, "series_id").join(window, "series_id")


@query("x21_learned")
def x21_learned(spark: SparkSession, folder: str) -> DataFrame:
    """A run with factors, tuning, a learned model judged on held-out rows, and an ensemble."""
    request = runs.ForecastRequest(models=["wma", "theta", "lightgbm"], horizon=7, ensemble=["wma", "theta"])
    factors = i.daily_factors(spark, folder, "holidays", "promotions")
    tables = runs.run_forecast(i.regions(spark, folder), request, factors)
    return tables["ranking"].select("series_id", "model", "rank", "mae", "source").join(tables["summary"].drop("model"), "series_id")


@query("x22_gather_factors", i.with_sql(i.REGION, i.HOLIDAYS, i.PROMOTIONS, es.EVENTS_US, WEIGHTED, """rated AS (SELECT e.ds AS event_ds, e.name,
    round(greatest(least(coalesce(w, 1.0), 5.0), 0.1), 4) AS impact FROM us_events e LEFT JOIN weighted w ON w.event_ds = e.ds AND w.name = e.name)""",
  """firsts AS (SELECT * FROM (SELECT 0 AS source, ds, holiday_name, holiday_impact FROM holidays UNION ALL SELECT DISTINCT 1, event_ds, name, impact FROM rated)
    QUALIFY row_number() OVER (PARTITION BY ds ORDER BY source, holiday_name) = 1)""") + """SELECT f.ds, holiday_name, holiday_impact, discount
  FROM firsts f LEFT JOIN (SELECT ds, round(sum(discount), 6) AS discount FROM promotions GROUP BY 1) p ON p.ds = f.ds""")
def x22(spark: SparkSession, folder: str) -> DataFrame:
    request = runs.ForecastRequest(include=["holidays", "promotions"], countries=["US"])
    found = runs.gather_factors(i.regions(spark, folder), i.daily_factors(spark, folder, "holidays", "promotions"), request)
    discounts = found["promotions"].groupBy("ds").agg(F.round(F.sum("discount"), 6).alias("discount"))
    return found["holidays"].join(discounts, "ds", "left")


@query("x23_run_history", i.with_sql(i.REGION) + "SELECT series_id, ds, y FROM region_panel")
def x23(spark: SparkSession, folder: str) -> DataFrame:
    root = store.scratch_path(spark, "runs")
    store.save_run(root, "r1", {"history": region_panel(spark, folder)})
    return store.load_run(spark, root, "r1", "history").select("series_id", "ds", "y")


# --- learned and regression models -----------------------------------------------------------


@query("m5_arima")
def m5(spark: SparkSession, folder: str) -> DataFrame:
    model = ARIMA((2, 0, 1))
    factors = {"holidays": i.holidays(spark, folder), "promotions": i.promotions(spark, folder)}
    panel = i.regions(spark, folder)
    return model.forecast(model.fit(panel, factors), 14, "D", factors)


AR1 = """pairs AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS x FROM region_panel),
coef AS (SELECT series_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, max(ds) AS last_ds, arg_max(y, ds) AS last_y FROM pairs GROUP BY 1),
noise AS (SELECT p.series_id, avg((y - c - phi * x) * (y - c - phi * x)) AS v FROM pairs p JOIN coef k ON p.series_id = k.series_id WHERE x IS NOT NULL GROUP BY 1),
ahead AS (SELECT k.*, v, CAST(unnest(range(1, 11)) AS INTEGER) AS step FROM coef k JOIN noise n ON k.series_id = n.series_id),
points AS (SELECT *, c * (1 - pow(phi, step)) / (1 - phi) + pow(phi, step) * last_y AS m,
  1.96 * sqrt(v * (1 - pow(phi * phi, step)) / (1 - phi * phi)) AS half FROM ahead)"""


@query("m5_ar1", i.with_sql(i.REGION, AR1) + """SELECT series_id, step, CAST(last_ds + step AS DATE) AS ds, round(m, 3) AS yhat,
  round(m - half, 3) AS lower_ci, round(m + half, 3) AS upper_ci FROM points""")
def m5_ar1(spark: SparkSession, folder: str) -> DataFrame:
    model = ARIMA((1, 0, 0))
    return rounded(model.forecast(model.fit(region_panel(spark, folder)), 10), 3, *BAND)


def _two_regressors(a: str, b: str) -> str:
    """CTE ``coef``: y on a constant and two regressors of ``design``, by the closed form of centred sums."""
    return f"""sums AS (SELECT series_id, avg(y) AS my, avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS aa, var_pop({b}) AS bb, covar_pop({a}, {b}) AS ab,
      covar_pop({a}, y) AS ay, covar_pop({b}, y) AS by_, var_pop(y) AS yy FROM design GROUP BY 1),
    coef AS (SELECT *, my - phi * ma - beta * mb AS c, yy - phi * ay - beta * by_ AS v FROM (
      SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS phi, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS beta FROM sums))"""


@query("m5_flag", i.with_sql(i.REGION, i.HOLIDAYS, "flags AS (SELECT DISTINCT CAST(ds + 30 AS DATE) AS ds FROM holidays)",
  """design AS (SELECT * FROM (SELECT p.*, CAST(p.ds IN (SELECT ds FROM flags) AS DOUBLE) AS f, lag(y) OVER (PARTITION BY series_id ORDER BY p.ds) AS x FROM region_panel p) WHERE x IS NOT NULL)""",
  _two_regressors("x", "f"), """path AS (SELECT c.series_id, 0 AS step, max(ds) AS ds, arg_max(y, ds) AS m, 0.0::DOUBLE AS spread FROM coef c JOIN region_panel p ON p.series_id = c.series_id GROUP BY 1
    UNION ALL SELECT p.series_id, step + 1, CAST(ds + 1 AS DATE), c + phi * m + beta * CAST(CAST(ds + 1 AS DATE) IN (SELECT ds FROM flags) AS DOUBLE), spread + pow(phi, 2 * step)
    FROM path p JOIN coef k ON k.series_id = p.series_id WHERE step < 14)""").replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT p.series_id, step, ds, round(m, 1) AS yhat,
  round(m - 1.96 * sqrt(v * spread), 1) AS lower_ci, round(m + 1.96 * sqrt(v * spread), 1) AS upper_ci FROM path p JOIN coef k ON k.series_id = p.series_id WHERE step > 0""")
def m5_flag(spark: SparkSession, folder: str) -> DataFrame:
    model, factors = ARIMA((1, 0, 0)), {"holidays": ms.shifted_holidays(spark, folder)}
    return rounded(model.forecast(model.fit(i.regions(spark, folder), factors), 14, "D", factors), 1, *BAND)


@query("m6_seasonal_lags", i.with_sql(i.REGION, """design AS (SELECT * FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS x, lag(y, 7) OVER (PARTITION BY series_id ORDER BY ds) AS s
    FROM region_panel) WHERE s IS NOT NULL)""", _two_regressors("x", "s"), """path AS (SELECT series_id, 0 AS step, max(ds) AS ds, list(y ORDER BY ds)[-7:] AS ys FROM region_panel GROUP BY 1
    UNION ALL SELECT p.series_id, step + 1, CAST(ds + 1 AS DATE), list_append(ys, c + phi * ys[-1] + beta * ys[-7]) FROM path p JOIN coef k ON k.series_id = p.series_id WHERE step < 10)""").replace("WITH ", "WITH RECURSIVE ", 1)
  + "SELECT series_id, step, ds, round(ys[-1], 3) AS yhat FROM path WHERE step > 0")
def m6_lags(spark: SparkSession, folder: str) -> DataFrame:
    model = SARIMAX((1, 0, 0), (1, 0, 0, 7))
    out = model.forecast(model.fit(region_panel(spark, folder)), 10)
    return out.select("series_id", "step", "ds", F.round("yhat", 3).alias("yhat"))


@query("m6_seasonal_walk", i.with_sql(i.REGION, """aged AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS age,
    max(ds) OVER (PARTITION BY series_id) AS last_ds FROM region_panel)""") + """SELECT series_id, CAST(8 - age AS INTEGER) AS step,
  CAST(last_ds + CAST(8 - age AS INTEGER) AS DATE) AS ds, round(y, 3) AS yhat FROM aged WHERE age <= 7""")
def m6_walk(spark: SparkSession, folder: str) -> DataFrame:
    model = SARIMAX((0, 0, 0), (0, 1, 0, 7))
    out = model.forecast(model.fit(region_panel(spark, folder)), 7)
    return out.select("series_id", "step", "ds", F.round("yhat", 3).alias("yhat"))


@query("m6_sarimax")
def m6(spark: SparkSession, folder: str) -> DataFrame:
    model = SARIMAX((1, 0, 1), (1, 0, 1, 7))
    return model.forecast(model.fit(region_panel(spark, folder)), 14)


def _ridge_line(name: str, penalty: str, source: str) -> str:
    """CTEs: ridge regression of ``v`` on a constant and ``t``, and the spread of its residuals."""
    return f"""{name} AS (SELECT *, (sv * (tt + pen) - tv * st) / ((n + pen) * (tt + pen) - st * st) AS a, ((n + pen) * tv - st * sv) / ((n + pen) * (tt + pen) - st * st) AS b
      FROM (SELECT s.*, {penalty} AS pen FROM {source})),
    {name}_noise AS (SELECT s.series_id, greatest(stddev_pop(v - a - b * t), 1e-4) AS noise FROM scaled s JOIN {name} k ON k.series_id = s.series_id GROUP BY 1)"""


@query("m7_trend_line", i.with_sql(i.REGION, """scaled AS (SELECT *, y / scale AS v, date_diff('day', first, ds) / span AS t FROM (SELECT *, max(abs(y)) OVER s AS scale, min(ds) OVER s AS first,
    max(ds) OVER s AS last_ds, CAST(date_diff('day', min(ds) OVER s, max(ds) OVER s) AS DOUBLE) AS span FROM region_panel WINDOW s AS (PARTITION BY series_id)))""",
  "sums AS (SELECT series_id, max(scale) AS scale, max(last_ds) AS last_ds, max(span) AS span, count(*) AS n, sum(t) AS st, sum(t * t) AS tt, sum(v) AS sv, sum(t * v) AS tv FROM scaled GROUP BY 1)",
  _ridge_line("one", "0.01 / 25 + 1e-9", "sums s"), _ridge_line("two", "noise * noise / 25 + 1e-9", "sums s JOIN one_noise o ON o.series_id = s.series_id"),
  "ahead AS (SELECT k.*, noise, CAST(unnest(range(1, 15)) AS INTEGER) AS step FROM two k JOIN two_noise o ON o.series_id = k.series_id)") + """
  SELECT series_id, step, CAST(last_ds + step AS DATE) AS ds, round(m, 2) AS yhat, round(m - half, 2) AS lower_ci, round(m + half, 2) AS upper_ci FROM (
    SELECT *, scale * (a + b * (span + step) / span) AS m, 1.96 * noise * scale * sqrt(1 + step / n) AS half FROM ahead)""")
def m7_line(spark: SparkSession, folder: str) -> DataFrame:
    """Without cycles and with trend changes priced out, the regression is a line of two ridge passes."""
    model = AdditiveRegression(yearly_seasonality=False, weekly_seasonality=False, changepoint_prior_scale=1e-9)
    return rounded(model.forecast(model.fit(region_panel(spark, folder)), 14), 2, *BAND)


@query("m7_additive_regression")
def m7(spark: SparkSession, folder: str) -> DataFrame:
    model, panel = AdditiveRegression(), i.regions(spark, folder)
    factors = {"promotions": i.promotions(spark, folder), "holidays": i.holidays(spark, folder)}
    return with_baseline(model, model.fit(panel, factors), 14, "D", factors)


@query("m7_multiplicative")
def m7_mul(spark: SparkSession, folder: str) -> DataFrame:
    model = AdditiveRegression(seasonality_mode="multiplicative")
    return model.forecast(model.fit(region_panel(spark, folder)), 14)


@query("m8_boosted")
def m8(spark: SparkSession, folder: str) -> DataFrame:
    model, panel = Boosted(), i.regions(spark, folder)
    return model.forecast(model.fit(panel), 5)


STUMP = """aged AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, avg(y) OVER (PARTITION BY series_id) AS level FROM region_panel),
  stump_rows AS (SELECT isodow(ds) - 1 AS dow, y / level AS v FROM aged WHERE idx >= 14),
  cuts AS (SELECT t, count(*) FILTER (WHERE dow <= t) AS nl, count(*) FILTER (WHERE dow > t) AS nr, sum(v) FILTER (WHERE dow <= t) AS sl, sum(v) FILTER (WHERE dow > t) AS sr
    FROM stump_rows CROSS JOIN range(6) r(t) GROUP BY 1),
  cut AS (SELECT t, sl / nl AS below, sr / nr AS above, (sl + sr) / (nl + nr) AS base FROM cuts ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1),
  ends AS (SELECT series_id, max(ds) AS last_ds, max(level) AS level, CAST(unnest(range(1, 8)) AS INTEGER) AS step FROM aged GROUP BY 1)"""


@query("m8_stump", i.with_sql(i.REGION, STUMP) + """SELECT series_id, step, CAST(last_ds + step AS DATE) AS ds,
  round(level * (base + 0.05 * (CASE WHEN isodow(CAST(last_ds + step AS DATE)) - 1 <= t THEN below ELSE above END - base)), 3) AS yhat FROM ends CROSS JOIN cut""")
def m8_stump(spark: SparkSession, folder: str) -> DataFrame:
    """One split of one feature, which has a closed form."""
    model, panel = Boosted(1, 0.05, 1, only=("dayofweek",)), region_panel(spark, folder)
    return model.forecast(model.fit(panel), 7).select("series_id", "step", "ds", F.round("yhat", 3).alias("yhat"))


@query("m9_boosted_sampled")
def m9(spark: SparkSession, folder: str) -> DataFrame:
    model, panel = boosted_rows(), i.regions(spark, folder)
    return model.forecast(model.fit(panel), 5)


@query("m10_recursive_forecast")
def m10(spark: SparkSession, folder: str) -> DataFrame:
    model, panel = Boosted(), i.regions(spark, folder)
    return model.forecast(model.fit(panel), 10)


_DIFFERENCES = ", ".join(f"corr(d, d_{p}) AS r{p}" for p in (7, 14, 30, 365))
_DIFFERENCE_LAGS = ", ".join(f"lag(d, {p}) OVER w AS d_{p}" for p in (7, 14, 30, 365))
_OWN_LAGS = ", ".join(f"lag(y, {k}) OVER w AS y_{k}" for k in range(1, 31))
_OWN_CORRELATIONS = ", ".join(f"abs(corr(y, y_{k}))" for k in range(1, 31))


@query("m11_route", i.with_sql(i.REGION, f"""moved AS (SELECT * FROM (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS d FROM region_panel) WHERE d IS NOT NULL),
  seasons AS (SELECT series_id, greatest(0, r7, r14, r30, r365) AS season FROM (SELECT series_id, {_DIFFERENCES} FROM (
    SELECT *, {_DIFFERENCE_LAGS} FROM moved WINDOW w AS (PARTITION BY series_id ORDER BY ds)) GROUP BY 1)),
  memory AS (SELECT series_id, n, list_sum(r[1:3]) / 3 > 2 * 1.96 / sqrt(n) AS has_ar, len(list_filter(r, lambda x: x > 1.96 / sqrt(n))) <= 2 AS has_ma FROM (
    SELECT series_id, count(*) AS n, [{_OWN_CORRELATIONS}] AS r FROM (SELECT *, {_OWN_LAGS} FROM region_panel WINDOW w AS (PARTITION BY series_id ORDER BY ds)) GROUP BY 1)),
  sparse AS (SELECT series_id, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS sparsity FROM region_panel GROUP BY 1)""") + """
  SELECT m.series_id, n AS n_points, has_ar, has_ma, CASE WHEN season > 0.3 AND n >= 30 THEN 'additive' WHEN sparsity > 0.3 OR n < 30 THEN 'wma'
    WHEN has_ar OR has_ma THEN 'arima' ELSE 'ets' END AS strategy FROM memory m JOIN seasons s ON m.series_id = s.series_id JOIN sparse p ON p.series_id = m.series_id""")
def m11(spark: SparkSession, folder: str) -> DataFrame:
    return route(i.regions(spark, folder)).select("series_id", "n_points", "has_ar", "has_ma", "strategy")


@query("m12_automl")
def m12(spark: SparkSession, folder: str) -> DataFrame:
    model, panel = AutoML(), i.regions(spark, folder)
    fitted = model.fit(panel)
    return model.forecast(fitted, 7).join(fitted, "series_id")


@query("m13_hybrid")
def m13(spark: SparkSession, folder: str) -> DataFrame:
    model = Hybrid()
    return model.forecast(model.fit(i.regions(spark, folder)), 5)


@query("m19_regression_components")
def m19_regression(spark: SparkSession, folder: str) -> DataFrame:
    model = AdditiveRegression()
    return model.components(model.fit(region_panel(spark, folder)), 14)


@query("m20_feature_importance")
def m20(spark: SparkSession, folder: str) -> DataFrame:
    model = Boosted()
    model.fit(i.regions(spark, folder))
    return model.importance(spark)


@query("m21_contributions")
def m21(spark: SparkSession, folder: str) -> DataFrame:
    model, panel = AdditiveRegression(), i.regions(spark, folder)
    factors = {"promotions": i.promotions(spark, folder)}
    return rank_contributions(model.contributions(model.fit(panel, factors), 14, "D", factors))


@query("m21_tree_contributions")
def m21_trees(spark: SparkSession, folder: str) -> DataFrame:
    model, panel = Boosted(), i.regions(spark, folder)
    return rank_contributions(model.contributions(model.fit(panel), 14))


@query("m22_category_forecasts", i.with_sql(i.PRODUCT, """categories AS (SELECT series_id, category, ds, y FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM (
    SELECT category AS series_id, category, ds, round(sum(y), 2) AS y FROM product_sales GROUP BY 1, 2, 3
    UNION ALL SELECT '(all)', NULL, ds, round(sum(y), 2) FROM product_sales GROUP BY ds)) WHERE n >= 20)""", *ms.wma("categories", 7)) + """
  SELECT series_id, CASE WHEN series_id <> '(all)' THEN series_id END AS category, step, ds, round(yhat, 4) AS yhat FROM wma_forecast""")
def m22(spark: SparkSession, folder: str) -> DataFrame:
    series = category_series(brand_sales(spark, folder), ["category"])
    model = WMA()
    forecast = model.forecast(model.fit(series.select("series_id", "ds", "y")), 7)
    tags = series.select("series_id", "category").distinct()
    return forecast.join(tags, "series_id").select("series_id", "category", "step", "ds", F.round("yhat", 4).alias("yhat"))


# --- own forecasters ----------------------------------------------------------------------------


class SeasonalNaive:
    """Example of a user's forecaster: the value of one week before, by grouped pandas."""

    name = "seasonal_naive"

    def fit(self, panel: DataFrame, factors=None) -> DataFrame:
        def last_week(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("ds")
            return pd.DataFrame({"series_id": [rows["series_id"].iloc[0]], "last_ds": [rows["ds"].iloc[-1]],
                                 "week": [rows["y"].tail(7).tolist()]})

        return panel.groupBy("series_id").applyInPandas(last_week, "series_id string, last_ds date, week array<double>")

    def forecast(self, fitted: DataFrame, horizon: int, freq: str = "D", factors=None) -> DataFrame:
        from ..models.base import banded, steps

        value = F.get("week", (F.col("step") - 1) % F.size("week"))
        return banded(steps(fitted, horizon, freq), value, None)


@query("p1_own_forecaster", i.with_sql(i.EVENT) + """SELECT series_id, step, CAST(last_ds + step AS DATE) AS ds, y AS yhat FROM (
  SELECT series_id, max(ds) OVER (PARTITION BY series_id) AS last_ds, CAST(8 - row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS INTEGER) AS step, y FROM event_panel) WHERE step >= 1""")
def p1(spark: SparkSession, folder: str) -> DataFrame:
    model = SeasonalNaive()
    out = model.forecast(model.fit(event_panel(spark, folder).select("series_id", "ds", "y")), 7)
    return out.select("series_id", "step", "ds", "yhat")
