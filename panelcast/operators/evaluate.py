"""Splits, cross-validation, backtests, metrics and model rankings."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import DAYS_PER_PERIOD
from ..functions.scalars import accuracy_grade, accuracy_pct, clamp
from ..models.base import Factors, Forecaster, TooLittleData, fit_with
from .enrich import within_range
from .grid import along
from .ranking import union_all

log = logging.getLogger(__name__)

Settings = dict[str, DataFrame]  # per model name: ``series_id, params``
FOLDS = 5  # fixed value: folds of a service run
FLOOR = 1e-9  # fixed value: smallest denominator of a percentage error


def _sized(panel: DataFrame) -> DataFrame:
    by_series = Window.partitionBy("series_id")
    return panel.withColumns(
        {"idx": F.row_number().over(along()) - 1, "n": F.count(F.lit(1)).over(by_series)}
    )


def split_panel(panel: DataFrame, train_ratio: float = 0.8, horizon: int = 0) -> DataFrame:
    """Label the newest rows of each series ``test`` and the others ``train``.

    With a horizon: its length, at most a fifth of the series. Otherwise the share
    outside ``train_ratio``. Five training rows always stay. Series with fewer than
    ten rows cannot be split and get null.
    """
    n = F.col("n")
    if horizon > 0:
        wanted = F.least(F.lit(horizon), F.greatest(F.lit(1), F.floor(n / 5)))
    else:
        wanted = F.greatest(F.lit(1), F.floor(n * F.lit(1 - train_ratio)))
    test = F.least(wanted, n - 5)
    label = F.when(n >= 10, F.when(F.col("idx") >= n - test, "test").otherwise("train"))
    return _sized(panel).withColumn("split", label).drop("idx", "n")


def _fold_rows(panel: DataFrame, folds: Column, train_end: Column, test_size: Column,
               first: int, gap: int = 0) -> DataFrame:
    """Each row once per fold it belongs to, as training or test row."""
    fold = F.explode(F.sequence(F.lit(first), F.lit(first - 1) + folds))
    spread = panel.withColumn("fold", fold)
    end = train_end
    test_start = end + gap
    role = (
        F.when(F.col("idx") < end, "train")
        .when((F.col("idx") >= test_start) & (F.col("idx") < test_start + test_size), "test")
    )
    return (
        spread.withColumn("role", role)
        .filter((test_start + test_size <= F.col("n")) & F.col("role").isNotNull())
        .select("series_id", "fold", "role", "ds", "y",
                F.when(F.col("role") == "test", F.col("idx") - test_start + 1).alias("step"))
    )


def cv_folds(panel: DataFrame, horizon: int = 7, folds: int = FOLDS) -> DataFrame:
    """Expanding-window folds 0..folds-1 of the forecast service."""
    least = max(2 * horizon, 14)
    sized = _sized(panel).filter(F.col("n") >= least)
    size = F.least(
        F.lit(horizon), F.greatest(F.lit(1), F.floor((F.col("n") - least) / (folds + 1)))
    ).cast("int")
    return _fold_rows(sized, F.lit(folds), least + F.col("fold") * size, size, 0)


def tuning_folds(panel: DataFrame, folds: int = FOLDS, least: int = 30, gap: int = 0) -> DataFrame:
    """Expanding-window folds 1..folds used in parameter search."""
    n = F.col("n")
    sized = _sized(panel).filter(n >= least + folds)
    size = F.least(
        F.greatest(F.lit(1), F.floor((n - least) / (folds + 1))),
        F.greatest(F.lit(1), F.floor(n / (folds + 2))),
    ).cast("int")
    return _fold_rows(sized, F.lit(folds), least + F.col("fold") * size, size, 1, gap)


def error_metrics(pairs: DataFrame, keys: Sequence[str], ape_limit: float | None = None) -> DataFrame:
    """MAE, RMSE, MAPE and R2 of ``yhat`` against ``y`` per key."""
    diff = F.col("yhat") - F.col("y")
    ape = F.abs(diff) / F.greatest(F.abs("y"), F.lit(FLOOR)) * 100
    if ape_limit is not None:
        ape = clamp(ape, 0.0, ape_limit)
    spread = F.var_pop("y") * F.count(F.lit(1))
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(diff)).alias("mae"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.avg(ape).alias("mape"),
        F.when(spread > FLOOR, 1 - F.sum(diff * diff) / spread).alias("r2"),
        F.count(F.lit(1)).alias("rows"),
    )


FOLD_METRICS = "series_id string, fold int, mae double, rmse double, mape double, r2 double, rows long"
FOLD_MARK = " ||| fold "


def cross_validate(
    panel: DataFrame, model: Forecaster, horizon: int = 7, folds: int = FOLDS, freq: str = "D",
    factors: Factors | None = None, rows: DataFrame | None = None, settings: DataFrame | None = None,
) -> DataFrame:
    """Metrics per series and fold, forecasts and actual values matched by position.

    ``settings`` (``series_id, params``) hold for all folds of a series.

    All folds of all series are fitted in one job, with the fold as part of the series
    key. A model that pools its training rows gets one fit per fold instead, so that no
    fold learns from another one's test rows. A fold with too few rows to train such a
    model stays in the result with ``rows = 0`` and null metrics.
    """
    rows = cv_folds(panel, horizon, folds) if rows is None else rows
    keyed = rows.withColumn("series_id", F.concat("series_id", F.lit(FOLD_MARK), F.col("fold").cast("string")))
    if settings is not None:
        settings = settings.join(rows.select("series_id", "fold").distinct(), "series_id").select(
            F.concat("series_id", F.lit(FOLD_MARK), F.col("fold").cast("string")).alias("series_id"), "params")
    if getattr(model, "pooled", False):
        numbers = sorted(r[0] for r in rows.select("fold").distinct().collect())
        parts = [keyed.filter(F.col("fold") == n) for n in numbers]
    else:
        parts = [keyed]
    done = []
    for part in parts:
        try:
            done.append(_score_folds(part, model, horizon, freq, factors, settings))
        except TooLittleData as error:
            log.warning("fold not scored for %s: %s", model.name, error)
            none = [F.lit(None).cast("double").alias(m) for m in ("mae", "rmse", "mape", "r2")]
            done.append(part.select("series_id", "fold").distinct().select("*", *none, F.lit(0).cast("long").alias("rows")))
    scored = union_all(done) if done else panel.sparkSession.createDataFrame([], FOLD_METRICS)
    series = F.substring_index("series_id", FOLD_MARK, 1)
    return scored.withColumn("series_id", series).withColumn("model", F.lit(model.name))


def _score_folds(
    keyed: DataFrame, model: Forecaster, horizon: int, freq: str, factors: Factors | None, settings: DataFrame | None = None
) -> DataFrame:
    train = keyed.filter(F.col("role") == "train").select("series_id", "ds", "y")
    test = keyed.filter(F.col("role") == "test").select("series_id", "fold", "step", "y")
    forecast = model.forecast(fit_with(model, train, factors, settings), horizon, freq, factors)
    pairs = test.join(forecast.select("series_id", "step", "yhat"), ["series_id", "step"])
    return error_metrics(pairs, ["series_id", "fold"], ape_limit=1000.0)


def fold_summary(fold_metrics: DataFrame, keys: Sequence[str] = ("series_id", "model")) -> DataFrame:
    """Mean and population deviation over folds; null with fewer than two folds."""
    scored = F.count_if(F.col("rows") > 0)
    enough = scored >= 2
    out = [scored.alias("n_folds")]
    for m in ("mae", "rmse", "mape", "r2"):
        out.append(F.when(enough, F.avg(m)).alias(m))
        out.append(F.when(enough, F.stddev_pop(m)).alias(f"{m}_std"))
    return fold_metrics.groupBy(*keys).agg(*out)


def backtest_split(panel: DataFrame, overlap: int = 0, freq: str = "D") -> DataFrame:
    """Label rows ``train`` or ``test`` for a backtest; null where none is possible.

    ``overlap`` is given in days; 0 takes the last fifth of series with more than 50
    dates. The test begins at the first date not earlier than that many periods before
    the last date, but never before the sixth row.
    """
    days = DAYS_PER_PERIOD[freq]
    n = F.col("n")
    if overlap > 0:
        size = F.least(F.lit(max(1, overlap // days)), n - 5)
    else:
        size = F.when(n > 50, F.greatest(F.lit(1), F.floor(n * F.lit(0.2)))).otherwise(0)
    by_series = Window.partitionBy("series_id")
    sized = _sized(panel).withColumn("size", size.cast("int"))
    target = F.date_sub(F.max("ds").over(by_series), F.col("size") * days)
    dated = sized.withColumns({"target": target, "start": F.min("ds").over(by_series)})
    possible = (F.col("size") > 0) & (n > F.col("size") + 5) & (F.col("target") > F.col("start"))
    # rows are in date order, so "index >= 5 and date >= target" is the tail from the split
    is_test = (F.col("ds") >= F.col("target")) & (F.col("idx") >= 5)
    return dated.withColumn(
        "split", F.when(possible, F.when(is_test, "test").otherwise("train"))
    ).select("series_id", "ds", "y", "split")


def match_actuals(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """Forecast rows beside the actual value of the same series and date."""
    return forecast.join(actual.select("series_id", "ds", "y"), ["series_id", "ds"])


def _forecast_test_part(
    split: DataFrame, models: Sequence[Forecaster], freq: str, factors: Factors | None, horizon: int | None, settings: Settings | None
) -> DataFrame:
    """Forecasts of the models trained on ``train`` rows, at the dates of ``test`` rows.

    Every series is forecast as many steps as it has test rows, matched by date.
    """
    train = split.filter(F.col("split") == "train").select("series_id", "ds", "y")
    test = split.filter(F.col("split") == "test")
    sizes = test.groupBy("series_id").agg(F.count(F.lit(1)).alias("test_rows"))
    if horizon is None:
        horizon = sizes.agg(F.max("test_rows")).first()[0] or 1
    known = {k: within_range(f, test) for k, f in factors.items()} if factors else None
    own = sizes.select("series_id", F.col("test_rows").alias("own_steps"))
    parts = []
    for model in models:
        fitted = fit_with(model, train, factors, (settings or {}).get(model.name)).join(own, "series_id")
        parts.append(model.forecast(fitted, horizon, freq, known).withColumn("model", F.lit(model.name)))
    reached = union_all(parts).join(sizes, "series_id").filter(F.col("step") <= F.col("test_rows"))
    return match_actuals(reached.drop("test_rows"), test)


def backtest(
    panel: DataFrame, models: Sequence[Forecaster], overlap: int = 0, freq: str = "D",
    factors: Factors | None = None, horizon: int | None = None, settings: Settings | None = None,
) -> DataFrame:
    """Forecast rows of every model over the backtest window, with the actual values."""
    return _forecast_test_part(backtest_split(panel, overlap, freq), models, freq, factors, horizon, settings)


def holdout(
    panel: DataFrame, models: Sequence[Forecaster], train_ratio: float = 0.8, freq: str = "D",
    factors: Factors | None = None, horizon: int | None = None, settings: Settings | None = None,
) -> DataFrame:
    """Forecast rows of every model over the held-out share, with the actual values."""
    return _forecast_test_part(split_panel(panel, train_ratio), models, freq, factors, horizon, settings)


def graded(metrics: DataFrame) -> DataFrame:
    accuracy = accuracy_pct("mape")
    return metrics.withColumns({"accuracy": accuracy, "grade": accuracy_grade(accuracy)})


def rank_from_test(test: DataFrame, cv: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Rank by held-out test metrics, with the CV ones where a model has no test."""
    names = ("mae", "rmse", "mape", "r2")
    t = test.select(*keys, "model", *[F.col(m).alias(f"t_{m}") for m in names])
    c = cv.select(*keys, "model", *[F.col(m).alias(f"c_{m}") for m in names])
    joined = t.join(c, [*keys, "model"], "full_outer")
    merged = joined.select(
        *keys, "model",
        *[F.coalesce(f"t_{m}", f"c_{m}").alias(m) for m in names],
        F.when(F.col("t_mae").isNotNull(), "test").otherwise("cv").alias("source"),
    )
    from .ranking import rank_models

    return rank_models(merged, keys)


def combine_forecasts(forecast: DataFrame, weights: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Weighted mean of the models' forecasts per date, over the models present there."""
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    joined = forecast.join(weights, [*keys, "model"]).withColumn("w", weight)
    total = F.sum("w")
    value = F.when(total > 0, F.sum(F.col("yhat") * F.col("w")) / total).otherwise(F.sum(F.col("yhat") * 0))
    return joined.groupBy(*keys, "ds").agg(
        value.alias("yhat"), F.min("lower_ci").alias("lower_ci"), F.max("upper_ci").alias("upper_ci")
    ).withColumn("model", F.lit("ensemble"))


def inverse_error_weights(metrics: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """1 / (MAE + 0.001), and 1 for a model without a usable MAE; they sum to one."""
    raw = F.when(F.col("mae") > 0, 1 / (F.col("mae") + 1e-3)).otherwise(1.0)
    share = raw / F.sum(raw).over(Window.partitionBy(*keys))
    return metrics.select(*keys, "model", share.alias("weight"))
