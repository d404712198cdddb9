"""Two-round parameter search with expanding-window folds."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..models.additive import AdditiveRegression
from ..models.arima import ARIMA
from ..models.base import Factors, Forecaster
from ..models.boosted import Boosted, boosted_rows
from ..models.smoothing import ETS, STL, Theta
from ..models.wma import WMA
from ..store import materialize
from .evaluate import cross_validate, tuning_folds
from .ranking import union_all

Params = dict[str, object]

# Candidate values per model and parameter. Only parameters that the
# models here understand are listed.
SPACES: dict[str, dict[str, list]] = {
    "arima": {"p": [0, 1, 2, 3, 4, 5, 6], "d": [0, 1], "q": [0, 1, 2, 3, 4, 5, 6]},
    "sarimax": {
        "p": [1, 2, 3, 4], "d": [0, 1], "q": [1, 2, 3, 4],
        "seasonal_p": [0, 1, 2], "seasonal_d": [0, 1], "seasonal_q": [0, 1, 2], "seasonal_period": [7, 12, 30, 52],
    },
    "prophet": {
        "seasonality_mode": ["additive", "multiplicative"],
        "changepoint_prior_scale": [0.001, 0.005, 0.01, 0.05, 0.1, 0.2, 0.5],
        "seasonality_prior_scale": [0.01, 0.1, 0.5, 1.0, 5.0, 10.0],
        "holidays_prior_scale": [0.01, 0.1, 0.5, 1.0, 5.0, 10.0],
        "weekly_seasonality": [True, False], "yearly_seasonality": [True, False],
    },
    "lightgbm": {
        "n_estimators": [100, 200, 300, 500, 800], "learning_rate": [0.005, 0.01, 0.02, 0.05, 0.1],
        "max_depth": [3, 5, 7, 9, -1], "num_leaves": [15, 31, 63, 127], "min_child_samples": [5, 10, 20, 50, 100],
        "subsample": [0.7, 0.8, 0.9, 1.0], "colsample": [0.7, 0.8, 0.9, 1.0],
    },
    "xgboost": {
        "n_estimators": [100, 200, 300, 500, 800], "learning_rate": [0.005, 0.01, 0.02, 0.05, 0.1],
        "max_depth": [3, 5, 7, 9], "min_child_weight": [1, 3, 5, 7],
        "subsample": [0.6, 0.7, 0.8, 0.9, 1.0], "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0],
    },
    "wma": {"window": [4, 8, 12, 20, 30, 52]},
    "ets": {
        "trend": ["add", "mul", None], "seasonal": ["add", "mul", None], "damped_trend": [True, False],
        "seasonal_periods": [7, 12, 30, 52],
    },
    "theta": {"period": [7, 12, 30, 52], "deseasonalize": [True, False]},
    "stl": {"period": [7, 12, 30, 52], "robust": [True, False]},
}


def _arima(params: Params) -> ARIMA:
    order = tuple(params.get(k, 1) for k in "pdq")
    return ARIMA(order)


def _sarimax(params: Params) -> ARIMA:
    order = tuple(params.get(k, 1) for k in "pdq")
    seasonal = tuple(params.get(f"seasonal_{k}", 1) for k in "pdq")
    return ARIMA(order, (*seasonal, params.get("seasonal_period", 7)), "sarimax")


BUILDERS: dict[str, Callable[[Params], Forecaster]] = {
    "arima": _arima,
    "sarimax": _sarimax,
    "prophet": lambda p: AdditiveRegression(**p),
    "lightgbm": lambda p: Boosted(**p),
    "xgboost": lambda p: boosted_rows(**p),
    "wma": lambda p: WMA(**p),
    "ets": lambda p: ETS(**p),
    "theta": lambda p: Theta(**p),
    "stl": lambda p: STL(**p),
}


def build_model(kind: str, params: Params | None = None) -> Forecaster:
    """Forecaster of a kind; a parameter it does not know is an error."""
    if kind not in BUILDERS:
        raise ValueError(f"unknown model {kind!r}; known: {sorted(BUILDERS)}")
    params = dict(params or {})
    if kind in ("arima", "sarimax") and set(params) - set(SPACES[kind]):
        raise ValueError(f"unknown parameters of {kind}: {sorted(set(params) - set(SPACES[kind]))}")
    try:
        return BUILDERS[kind](params)
    except TypeError as error:
        raise ValueError(f"unknown parameters of {kind}: {error}") from error


def sample_candidates(space: dict[str, list], n: int, seed: int) -> list[Params]:
    """Up to ``n`` combinations, the same ones for the same seed.

    A combination is a number whose digits are places in the lists, so none but the drawn
    ones is built.
    """
    total = math.prod(map(len, space.values()))
    drawn = range(total) if total <= n else random.Random(seed).sample(range(total), n)
    out = []
    for number in drawn:
        params: Params = {}
        for key in reversed(space):
            number, place = divmod(number, len(space[key]))
            params[key] = space[key][place]
        out.append({key: params[key] for key in space})
    return out


def narrow(space: dict[str, list], best: Params) -> dict[str, list]:
    """Numeric parameters limited to the neighbours of their best value."""
    out = {}
    for key, values in space.items():
        numeric = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
        if numeric and len(values) >= 3 and best.get(key) in values:
            at = values.index(best[key])
            out[key] = values[max(0, at - 1) : at + 2]
        else:
            out[key] = values
    return out


CANDIDATE_MARK = " ||| candidate "
SCORES = ("series_id", "candidate", "params", "mae", "rmse", "mape", "n_folds")


def as_text(params: Params) -> dict[str, str]:
    """Parameter values as text, the form in which they travel with a series."""
    return {k: "none" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for k, v in params.items()}


def from_text(kind: str, params: dict[str, str]) -> Params:
    """The values of a model's search space that have these texts."""
    return {k: next(v for v in SPACES[kind][k] if as_text({k: v})[k] == text) for k, text in params.items()}


def candidate_table(spark: SparkSession, candidates: Sequence[Params], offset: int = 0) -> DataFrame:
    rows = [(i + offset, as_text(c)) for i, c in enumerate(candidates)]
    return spark.createDataFrame(rows, "candidate int, params map<string,string>")


def score_candidates(
    rows: DataFrame, model: Forecaster, chosen: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
) -> DataFrame:
    """Mean fold errors of each series with each of its candidates, all in one job.

    ``rows`` are fold rows, ``chosen`` has ``series_id, candidate, params``. The candidate becomes part
    of the series key and its parameters a row of the settings, so the number of candidates
    changes the rows of the job, not the number of jobs. Two folds at least.
    """
    key = F.concat("series_id", F.lit(CANDIDATE_MARK), F.col("candidate").cast("string"))
    each = rows.join(chosen.select("series_id", "candidate"), "series_id").withColumn("series_id", key).drop("candidate")
    settings = chosen.select(key.alias("series_id"), "params")
    scored = cross_validate(rows, model, horizon, freq=freq, factors=factors, rows=each, settings=settings)
    parts = F.split("series_id", re.escape(CANDIDATE_MARK))
    named = scored.withColumns({"candidate": F.get(parts, F.lit(1)).cast("int"), "series_id": F.get(parts, F.lit(0))})
    means = named.groupBy("series_id", "candidate").agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape"), F.count_if(F.col("rows") > 0).alias("n_folds")
    )
    return means.filter(F.col("n_folds") >= 2).join(chosen, ["series_id", "candidate"]).select(*SCORES)


def _leaders(scores: DataFrame) -> DataFrame:
    best = Window.partitionBy("series_id").orderBy("mae", "candidate")
    return scores.withColumn("place", F.row_number().over(best)).filter(F.col("place") == 1).drop("place")


def _halved(scores: DataFrame) -> DataFrame:
    """The better half of each series' candidates."""
    best = Window.partitionBy("series_id").orderBy("mae", "candidate")
    sized = scores.withColumns({"place": F.row_number().over(best), "all": F.count(F.lit(1)).over(Window.partitionBy("series_id"))})
    return sized.filter(F.col("place") * 2 <= F.col("all") + 1).select("series_id", "candidate", "params")


def evaluate_candidates(
    panel: DataFrame, kind: str, candidates: Sequence[Params], horizon: int, folds: int = 5, least: int = 30,
    freq: str = "D", factors: Factors | None = None, offset: int = 0,
) -> DataFrame:
    """Mean fold errors per series and candidate of a model that is fitted once for the whole panel."""
    rows = materialize(tuning_folds(panel, folds, least))
    scored = []
    for i, params in enumerate(candidates):
        folds_i = cross_validate(panel, build_model(kind, params), horizon, folds, freq, factors, rows)
        scored.append(folds_i.withColumn("candidate", F.lit(i + offset)))
    means = union_all(scored).groupBy("series_id", "candidate").agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape"), F.count_if(F.col("rows") > 0).alias("n_folds")
    )
    table = candidate_table(panel.sparkSession, candidates, offset)
    return means.filter(F.col("n_folds") >= 2).join(F.broadcast(table), "candidate").select(*SCORES)


def tune(
    panel: DataFrame, kind: str, n_iter: int = 8, folds: int = 5, least: int = 30, seed: int = 42, freq: str = "D",
    factors: Factors | None = None, horizon: int | None = None, halving: bool = False,
) -> DataFrame:
    """Best parameters of each series: ``series_id, model, params, mae, rmse, mape, n_folds``.

    The first round tries a seeded sample of the whole space on every series, the second one a sample
    around each series' own best. Each round is one job. With ``halving`` the candidates of a round
    are first compared on the first two folds, and only each series' better half on all of them.
    A model that learns from the whole panel has one fit per candidate, and one set for all series.
    """
    space = SPACES[kind]
    if horizon is None:
        longest = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        horizon = max(1, min((longest - least) // (folds + 1), longest // (folds + 2)))
    first = sample_candidates(space, n_iter, seed)
    if getattr(build_model(kind), "pooled", False):
        return _tune_pooled(panel, kind, first, n_iter, folds, least, seed, freq, factors, horizon)
    model, spark = build_model(kind), panel.sparkSession
    rows = materialize(tuning_folds(panel, folds, least))

    def scores_of(chosen: DataFrame) -> DataFrame:
        if halving:
            chosen = materialize(_halved(score_candidates(rows.filter(F.col("fold") <= 2), model, chosen, horizon, freq, factors)))
        return materialize(score_candidates(rows, model, chosen, horizon, freq, factors))

    series = rows.select("series_id").distinct()
    table = F.broadcast(candidate_table(spark, first))  # n_iter rows
    each = F.explode(F.sequence(F.lit(0), F.lit(len(first) - 1))).alias("candidate")
    scores = scores_of(series.select("series_id", each).join(table, "candidate"))
    # the neighbourhood of every first candidate that could lead: at most n_iter squared rows
    second = [(c, o) for c, params in enumerate(first) for o in sample_candidates(narrow(space, params), n_iter, seed + 1) if o not in first]
    if second:
        near = candidate_table(spark, [o for _, o in second], len(first))
        owners = spark.createDataFrame([(len(first) + i, c) for i, (c, _) in enumerate(second)], "candidate int, leader int")
        around = F.broadcast(near.join(F.broadcast(owners), "candidate"))
        chosen = _leaders(scores).select("series_id", F.col("candidate").alias("leader")).join(around, "leader").drop("leader")
        scores = scores.unionByName(scores_of(chosen))
    return _leaders(scores).select("series_id", F.lit(kind).alias("model"), "params", "mae", "rmse", "mape", "n_folds")


def _tune_pooled(
    panel: DataFrame, kind: str, first: list[Params], n_iter: int, folds: int, least: int, seed: int, freq: str,
    factors: Factors | None, horizon: int,
) -> DataFrame:
    """The candidate with the smallest mean error relative to each series' best, for all series."""
    def best_of(scores: DataFrame) -> int | None:
        relative = F.col("mae") / F.greatest(F.min("mae").over(Window.partitionBy("series_id")), F.lit(1e-9))
        row = scores.withColumn("relative", relative).groupBy("candidate").agg(F.avg("relative").alias("r")).orderBy("r", "candidate").first()
        return None if row is None else row["candidate"]

    scores = materialize(evaluate_candidates(panel, kind, first, horizon, folds, least, freq, factors))
    leader = best_of(scores)
    if leader is not None:
        second = [c for c in sample_candidates(narrow(SPACES[kind], first[leader]), n_iter, seed + 1) if c not in first]
        if second:
            scores = materialize(scores.unionByName(evaluate_candidates(panel, kind, second, horizon, folds, least, freq, factors, len(first))))
            leader = best_of(scores)
    return scores.filter(F.col("candidate") == leader).select("series_id", F.lit(kind).alias("model"), "params", "mae", "rmse", "mape", "n_folds")
