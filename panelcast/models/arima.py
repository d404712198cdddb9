"""Autoregressive moving-average forecasters with event-flag regressors.

Coefficients come from two least-squares passes (Hannan and Rissanen): a long
autoregression gives the innovations, which then enter a second regression as moving
average terms. Seasonal lags are added to the plain ones. Differences, innovations and all moments
are expressions over one array row per series; only the small linear systems that the
moments make are solved outside, in Arrow batches that never see a series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import future_date
from ..operators.enrich import FLAG_KINDS, attach_flags, daily_flags
from ..operators.lagstats import dot, filtered, lag_gram, lag_moments, lagged, span, total
from .base import Factors, Z95, appended, as_arrays, configured, per_row, steps

FALLBACK_ORDERS = [(1, 1, 1), (0, 1, 0)]  # fixed values: tried when the wanted order fails


def _stable(lags: list[int], coef: np.ndarray) -> np.ndarray:
    """Shrink autoregressive coefficients whose recursion would explode."""
    if not lags:
        return coef
    size = max(lags)
    companion = np.zeros((size, size))
    companion[0, np.array(lags) - 1] = coef
    companion[1:, :-1] += np.eye(size - 1)
    radius = np.abs(np.linalg.eigvals(companion)).max()
    return coef * (0.98 / radius) ** np.array(lags) if radius >= 0.99 else coef


# --- what is fitted: orders and lags, from the length of a series alone -----------------------------


PLAN = "order: array<int>, delta: array<double>, ar: array<int>, ma: array<int>, long: int, start: int"
#: Too short for any order: a random walk without regressors.
WALK = {"order": [0, 1, 0, 0, 0, 0, 1], "delta": [1.0, -1.0], "ar": [], "ma": [], "long": 0, "start": 0}


def _numbers(values: Sequence) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]).cast("array<int>")


def _lags(near: Column, far: Column, period: Column) -> Column:
    both = F.concat(span(F.lit(1), near), F.transform(span(F.lit(1), far), lambda k: period * k))
    return F.array_sort(F.array_distinct(both))


def _difference_polynomial(d: Column, seasonal_d: Column, period: Column) -> Column:
    """Coefficients of (1-B)^d (1-B^s)^D by power of B."""

    def times(known: Column, stride: Column) -> Column:
        def at(k: Column) -> Column:
            return F.coalesce(F.get(known, k), F.lit(0.0)) - F.coalesce(F.get(known, k - stride), F.lit(0.0))

        return F.transform(F.sequence(F.lit(0), F.size(known) + stride - 1), at)

    strides = F.concat(F.array_repeat(F.lit(1), d), F.array_repeat(period, seasonal_d))
    return F.aggregate(strides, F.array(F.lit(1.0)), times)


def _deepest(ar: Column, ma: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.array_max(ar), F.lit(0)), F.coalesce(F.array_max(ma), F.lit(0)))


def planned(n: Column, flags: int, numbers: Sequence[Column]) -> Column:
    """Lags, differences and first rows of the first order that ``n`` values are enough for.

    ``numbers`` are the wanted p, d, q, P, D, Q and period. Simpler orders follow, the walk is the last.
    """
    own, period = _numbers(numbers), numbers[6]
    flat = _numbers((0, 0, 0, 1))
    orders = F.array(F.slice(own, 1, 3), *[_numbers(o) for o in FALLBACK_ORDERS])
    seasonal = (period >= 2) & F.exists(F.slice(own, 4, 3), lambda v: v != 0)
    seasons = F.when(seasonal, F.array(F.slice(own, 4, 4), _numbers((1, 0, 1, period)), flat)).otherwise(F.array(flat))

    def shaped(c: Column) -> Column:
        at = [F.get(c, F.lit(k)) for k in range(7)]
        return F.struct(
            c.alias("order"), _difference_polynomial(at[1], at[4], at[6]).alias("delta"),
            _lags(at[0], at[3], at[6]).alias("ar"), _lags(at[2], at[5], at[6]).alias("ma"),
        )

    def sized(c: Column) -> Column:
        return F.struct(c.alias("c"), (n - F.size(c["delta"]) + 1).alias("rows"), _deepest(c["ar"], c["ma"]).alias("deepest"))

    def started(s: Column) -> Column:
        wide = F.ceil(F.pow(F.log(F.greatest(s["rows"], F.lit(3))), F.lit(1.5))).cast("int")
        first = F.least(F.greatest(s["deepest"], wide), F.floor(s["rows"] / 3).cast("int"))
        return F.struct(s["c"], s["rows"], s["deepest"], F.when(F.size(s["c"]["ma"]) > 0, first).otherwise(F.lit(0)).alias("long"))

    def enough(s: Column) -> Column:
        unknown = 1 + F.size(s["c"]["ar"]) + F.size(s["c"]["ma"]) + flags
        passes = (F.size(s["c"]["ma"]) == 0) | (s["rows"] - s["long"] >= s["long"] + 2)
        return passes & (s["rows"] - s["long"] - s["deepest"] >= unknown + 2)

    wanted = F.flatten(F.transform(seasons, lambda s: F.transform(orders, lambda o: F.concat(o, s))))
    fitting = F.filter(F.transform(F.transform(wanted, shaped), sized), lambda s: s["rows"] >= 5)
    found = F.transform(F.filter(F.transform(fitting, started), enough), lambda s: F.struct(
        s["c"]["order"], s["c"]["delta"], s["c"]["ar"], s["c"]["ma"], s["long"], s["long"] + s["deepest"],
    ).cast(f"struct<{PLAN}>"))
    walk = F.struct(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in WALK.values()]).cast(f"struct<{PLAN}>")
    known = F.coalesce(F.get(found, F.lit(0)), walk)
    return F.when(F.exists(own, lambda v: v.isNull()), F.raise_error("an order of ARIMA is null")).otherwise(known)


# --- the small systems -----------------------------------------------------------------------------


def _innovation_coefficients(moments, cross, own, x_sums) -> list[float] | None:
    """Constant, long autoregression and flag effects, from their moments; null without a first pass."""
    if moments is None:
        return None
    gram, sums, rows = lag_gram(moments), np.asarray(moments["sums"], float), moments["rows"]
    cross = np.array([list(c) for c in cross], float).reshape(-1, len(gram))  # flags by lags
    own = np.array([list(c) for c in own], float).reshape(len(cross), len(cross))
    x_sums = np.asarray(x_sums, float)
    whole = np.block([
        [np.array([[rows]]), sums[None, 1:], x_sums[None, :]],
        [sums[1:, None], gram[1:, 1:], cross[:, 1:].T],
        [x_sums[:, None], cross[:, 1:], own],
    ])
    target = np.r_[sums[0], gram[1:, 0], cross[:, 0]]
    return np.linalg.lstsq(whole, target, rcond=None)[0].tolist()


def _state(row: pd.Series) -> dict:
    """Coefficients, spread and the values to continue from."""
    ar, ma, delta = [int(k) for k in row["ar"]], [int(k) for k in row["ma"]], np.asarray(row["delta"], float)
    gram = np.array([list(c) for c in row["gram"]], float).reshape(len(row["gram"]), len(row["gram"]))
    moment = np.asarray(row["moment"], float)
    coef = np.linalg.lstsq(gram, moment, rcond=None)[0] if len(gram) else np.zeros(0)
    constant = len(delta) == 1
    k = int(constant)
    ar_coef, ma_coef = coef[k : k + len(ar)], coef[k + len(ar) : k + len(ar) + len(ma)]
    beta = coef[k + len(ar) + len(ma) :]
    shrunk = _stable(ar, ar_coef)
    deepest = max([0, *ar, *ma])
    phi, theta = np.zeros(deepest + 1), np.zeros(max([0, *ma]) + 1)
    phi[0] = theta[0] = 1.0
    for lag, c in zip(ar, shrunk):
        phi[lag] -= c
    for lag, c in zip(ma, ma_coef):
        theta[lag] = c
    # the values were centred; a level that the lags had before they were shrunk is kept
    own = float(coef[0]) if constant and np.allclose(shrunk, ar_coef) else 0.0
    mean = own + row["mean"] * phi.sum() if constant else 0.0
    errors = np.asarray(row["last_targets"], float)
    if len(coef):
        errors = errors - coef @ np.array([list(c) for c in row["last_columns"]], float)
    squares = row["squares"] - 2 * coef @ moment + coef @ gram @ coef
    full = np.convolve(phi, delta)
    return {
        "constant": float(mean), "phi": full.tolist(), "theta": theta.tolist(), "beta": beta.tolist(),
        "sigma": float(np.sqrt(max(squares, 0.0) / max(row["rows"], 1))), "e_tail": errors[-len(theta) :].tolist(),
    }


def continue_one(state: dict, x: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecast and standard error of the next ``horizon`` steps."""
    phi, theta = np.asarray(state["phi"], float), np.asarray(state["theta"], float)
    delta, beta = np.asarray(state["delta"], float), np.asarray(state["beta"], float)
    y, e = list(state["y_tail"]), list(state["e_tail"])
    known = np.asarray(state["x_tail"], float).reshape(-1, len(beta)) if len(beta) else np.zeros((len(delta), 0))
    exog = np.vstack([known, x]) if len(beta) else np.zeros((len(delta) + horizon, 0))
    out = np.zeros(horizon)
    for h in range(horizon):
        value = state["constant"]
        value -= sum(phi[k] * y[-k] for k in range(1, len(phi)) if k <= len(y))
        value += sum(theta[k] * e[-k] for k in range(1, len(theta)) if k <= len(e))
        if len(beta):
            at = len(known) + h
            value += sum(delta[k] * float(exog[at - k] @ beta) for k in range(len(delta)) if at - k >= 0)
        y.append(value)
        e.append(0.0)
        out[h] = value
    psi = np.zeros(horizon)
    for j in range(horizon):
        psi[j] = theta[j] if j < len(theta) else 0.0
        psi[j] -= sum(phi[k] * psi[j - k] for k in range(1, min(j, len(phi) - 1) + 1))
    return out, state["sigma"] * np.sqrt(np.cumsum(psi**2))


STATE = (
    "series_id string, last_ds date, order array<int>, constant double, phi array<double>, theta array<double>, "
    "beta array<double>, delta array<double>, sigma double, y_tail array<double>, e_tail array<double>, "
    "x_tail array<double>, n int, flags array<string>"
)


@dataclass(frozen=True)
class ARIMA:
    order: tuple[int, int, int] = (1, 1, 1)
    seasonal_order: tuple[int, int, int, int] = (0, 0, 0, 0)
    name: str = "arima"
    tunable = ("p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "seasonal_period")

    def fit(self, panel: DataFrame, factors: Factors | None = None, settings: DataFrame | None = None) -> DataFrame:
        kinds = [k for k in FLAG_KINDS if factors and k in factors]
        flags = [f"{k}_flag" for k in kinds]
        source = attach_flags(panel, factors) if kinds else panel
        own = dict(zip(self.tunable, [("int", v) for v in (*self.order, *self.seasonal_order)], strict=True))
        arrays = configured(as_arrays(source, "y", *flags), settings, own).withColumn("n", F.size("ys"))
        plan = planned(F.col("n"), len(flags), [F.col(f"own_{name}") for name in self.tunable])
        fixed = arrays.withColumn("plan", plan).select("*", "plan.*")
        # a walk has no regressors
        usable = F.col("plan")["order"] != F.array(*[F.lit(v) for v in WALK["order"]])
        xs = F.array(*[F.col(f"{f}s") for f in flags]).cast("array<array<double>>")
        zero = F.array().cast("array<array<double>>")
        moved = fixed.withColumn("xs", F.when(usable | (F.size("ma") > 0), xs).otherwise(zero)).withColumns({
            "w": filtered(F.col("ys"), F.col("delta")), "wx": F.transform("xs", lambda x: filtered(x, F.col("delta"))),
        })
        level = F.when(F.size("delta") == 1, total(F.col("w")) / F.size("w")).otherwise(0.0)
        centred = moved.withColumn("mean", level).withColumn("w", F.transform("w", lambda v: v - F.col("mean")))

        long, wx = F.col("long"), F.col("wx")
        lags = F.sequence(F.lit(0), long)
        pairs = {
            "long_moments": F.when(long > 0, lag_moments(F.col("w"), long)),
            "long_cross": F.transform(wx, lambda x: F.transform(lags, lambda k: dot(lagged(x, F.lit(0), long), lagged(F.col("w"), k, long)))),
            "long_own": F.transform(wx, lambda x: F.transform(wx, lambda z: dot(lagged(x, F.lit(0), long), lagged(z, F.lit(0), long)))),
            "long_sums": F.transform(wx, lambda x: total(lagged(x, F.lit(0), long))),
        }
        known = appended(centred.withColumns(pairs), "long_coef", "array<double>", list(pairs), _innovation_coefficients).drop(*pairs)

        def innovation(t: Column) -> Column:
            coef, w = F.col("long_coef"), F.col("w")
            past = total(F.transform(F.sequence(F.lit(1), long), lambda k: F.get(coef, k) * F.get(w, t - k)))
            outside = total(F.transform(wx, lambda x, j: F.get(coef, long + 1 + j) * F.get(x, t)))
            return F.get(w, t) - F.get(coef, F.lit(0)) - past - outside

        none = F.transform(F.slice("w", F.lit(1), long), lambda v: F.lit(0.0))
        errors = F.concat(none, F.transform(span(long, F.size("w") - long), innovation))
        start = F.col("start")
        ones = F.array(F.transform(lagged(F.col("w"), F.lit(0), start), lambda v: F.lit(1.0)))
        designed = known.withColumn("e", F.when(long > 0, errors)).withColumn("z", F.concat(
            F.when(F.size("delta") == 1, ones).otherwise(zero),
            F.transform("ar", lambda k: lagged(F.col("w"), k, start)), F.transform("ma", lambda k: lagged(F.col("e"), k, start)),
            F.transform(wx, lambda x: lagged(x, F.lit(0), start)),
        )).withColumn("target", lagged(F.col("w"), F.lit(0), start))
        kept = F.least(F.size("target"), F.coalesce(F.array_max("ma"), F.lit(0)) + 1)
        deepest = _deepest(F.col("ar"), F.col("ma"))

        def tail(values: Column | str, count: Column) -> Column:
            return F.slice(values, F.greatest(F.size(values) - count, F.lit(0)) + 1, F.greatest(count, F.lit(0)))

        z, lost = F.col("z"), F.size("delta")
        times = F.sequence(F.lit(0), lost - 1)
        moments = designed.select(
            "series_id", "last_ds", "n", "order", "delta", "ar", "ma", "mean", F.size("target").alias("rows"),
            F.transform(z, lambda a: F.transform(z, lambda b: dot(a, b))).alias("gram"), F.transform(z, lambda a: dot(a, F.col("target"))).alias("moment"),
            dot(F.col("target"), F.col("target")).alias("squares"), F.transform(z, lambda a: tail(a, kept)).alias("last_columns"),
            tail("target", kept).alias("last_targets"), tail("ys", deepest + lost).alias("y_tail"),
            F.flatten(F.transform(times, lambda t: F.transform("xs", lambda x: F.get(x, F.size(x) - lost + t)))).alias("x_tail"),
            F.when(F.size("xs") > 0, F.array(*[F.lit(f) for f in flags])).otherwise(F.array()).cast("array<string>").alias("flags"),
        )
        return per_row(moments, STATE, _state, ("series_id", "last_ds", "n", "order", "delta", "y_tail", "x_tail", "flags"))

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame:
        kinds = [k for k in FLAG_KINDS if factors and k in factors]
        names = [f"{k}_flag" for k in kinds]
        if kinds:
            dated = steps(fitted.select("series_id", "last_ds"), horizon, freq)
            dated = dated.join(daily_flags(factors), "ds", "left").fillna(0.0, names)
            future = dated.groupBy("series_id").agg(
                F.array_sort(F.collect_list(F.struct("step", "ds", *names))).alias("future")
            )
            joined = fitted.join(future, "series_id").select(
                *fitted.columns, F.col("future")["ds"].alias("dss"), *[F.col("future")[n].alias(n) for n in names]
            )
        else:
            # shuffled, as each Python step that a task goes through keeps a process of its own
            known = fitted.where(F.col("series_id").isNotNull()).repartition("series_id")
            ahead = F.sequence(F.lit(1), F.lit(max(horizon, 1)))
            joined = known.withColumn("dss", F.transform(ahead, lambda k: future_date("last_ds", k, freq)))

        def work(row: pd.Series) -> dict:
            listed = list(row["flags"])
            x = np.zeros((horizon, len(listed)))
            for i, flag in enumerate(listed):
                if flag in names:
                    x[:, i] = np.asarray(row[flag], float)
            value, error = continue_one(row.to_dict(), x, horizon)
            return {"dss": row["dss"], "value": value, "error": error}

        solved = per_row(joined, "series_id string, dss array<date>, value array<double>, error array<double>", work, ("series_id",))
        rows = solved.select("series_id", F.posexplode(F.arrays_zip("dss", "value", "error")).alias("pos", "r"))
        half = F.col("r.error") * Z95
        value = F.col("r.value")
        return rows.select(
            "series_id", (F.col("pos") + 1).alias("step"), F.col("r.dss").alias("ds"), value.alias("yhat"),
            (value - half).alias("lower_ci"), (value + half).alias("upper_ci"),
        )


def SARIMAX(order: tuple[int, int, int] = (1, 1, 1), seasonal_order: tuple[int, int, int, int] = (1, 1, 1, 7)) -> ARIMA:
    return ARIMA(order, seasonal_order, "sarimax")
