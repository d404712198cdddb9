"""Seasonal periods and trend / seasonal / residual decompositions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, ratio
from ..models.base import ALIASES, as_arrays, per_row
from .grid import along, centred_average

NEAR = 0.2  # fixed value: relative distance within which two periods count as one
TOP_PERIODS = 3  # fixed value


def _distinct_periods(candidates: list[tuple[int, float]], k: int = TOP_PERIODS) -> list[int]:
    """Strongest first, leaving out periods close to a stronger one."""
    kept: list[int] = []
    for period, _ in sorted(candidates, key=lambda c: (-c[1], c[0])):
        if all(abs(period - other) / max(other, 1) >= NEAR for other in kept):
            kept.append(period)
    return kept[:k]


def _spectrum_periods(y: np.ndarray, longest: int = 365) -> list[int]:
    n = len(y)
    if n < longest * 2:
        longest = max(7, n // 4)
    size = np.abs(np.fft.rfft(y - y.mean()))
    frequency = np.fft.rfftfreq(n)
    best: list[tuple[int, float]] = []
    for f, m in zip(frequency[1:], size[1:]):
        period = int(round(1.0 / f))
        if m > 1e-6 and 2 <= period <= longest:
            best.append((period, float(m)))
    return _distinct_periods(best)


def spectral_periods(panel: DataFrame, longest: int = 365) -> DataFrame:
    """Dominant periods of each series by Fourier magnitude, strongest first."""
    found = per_row(
        as_arrays(panel).select("series_id", "ys"), "series_id string, n int, periods array<int>",
        lambda row: {"n": len(row["ys"]),
                     "periods": _spectrum_periods(np.asarray(row["ys"], float), min(longest, max(2, len(row["ys"]) // 2)))},
        ("series_id",),
    )
    return found


def long_autocorrelation(panel: DataFrame, max_lag: int) -> DataFrame:
    """Autocorrelation per series and lag, each lag averaged over its own pairs.

    For hundreds of lags the products come from one transform per series.
    """

    def work(row: pd.Series) -> dict:
        y = np.asarray(row["ys"], float)
        n, c = len(y), y - y.mean()
        most = min(max_lag, n - 1)
        power = np.abs(np.fft.rfft(c, 2 * n)) ** 2
        sums = np.fft.irfft(power, 2 * n)[1 : most + 1]
        spread = float(c @ c)
        if spread <= 1e-18 * n:
            return {"n": n, "acf": []}
        return {"n": n, "acf": sums / spread * n / (n - np.arange(1, most + 1))}

    arrays = per_row(as_arrays(panel).select("series_id", "ys"), "series_id string, n int, acf array<double>", work, ("series_id",))
    return arrays.select("series_id", "n", F.posexplode("acf").alias("lag", "acf")).withColumn("lag", F.col("lag") + 1)


def autocorrelation_periods(panel: DataFrame, max_lag: int = 365, k: int = TOP_PERIODS) -> DataFrame:
    """Local maxima of the autocorrelation above 2/sqrt(n), strongest first.

    Lags go up to ``max_lag`` and a third of the series.
    """
    acf = long_autocorrelation(panel, max_lag)
    last = F.least(F.lit(max_lag), F.floor(F.col("n") / 3))
    order = Window.partitionBy("series_id").orderBy("lag")
    sides = acf.filter(F.col("lag") <= last).withColumns(
        {"before": F.lag("acf").over(order), "after": F.lead("acf").over(order)}
    )
    strong = (F.col("acf") > 2 / F.sqrt("n")) & (F.col("acf") > F.col("before")) & (F.col("acf") > F.col("after"))
    peaks = sides.filter(strong & (F.col("lag") >= 2) & (last >= 7))
    listed = peaks.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.round("acf", 9)).alias("rank"), "lag"))).alias("p")
    )

    def keep(kept: Column, item: Column) -> Column:
        period = item["lag"]
        far = F.forall(kept, lambda other: F.abs(period - other) / other >= NEAR)
        return F.when(far, F.concat(kept, F.array(period))).otherwise(kept)

    merged = F.aggregate("p", F.lit([]).cast("array<int>"), keep)
    return listed.select("series_id", F.slice(merged, 1, k).alias("periods"))


# --- classical decomposition -------------------------------------------------------------


def _own_average(panel: DataFrame) -> DataFrame:
    """Rows with ``idx``, ``n`` and the centred average over the series' ``own_period``.

    Window frames have a fixed width, so the sums are differences of running totals, looked up
    in one array per series.
    """
    running = panel.withColumn("total", F.sum("y").over(along().rowsBetween(Window.unboundedPreceding, 0)))
    arrays = as_arrays(running, "y", "total", "own_period").withColumn("period", F.element_at("own_periods", -1))
    half, n = F.floor(F.col("period") / 2).cast("int"), F.size("ys")

    def average(i: Column) -> Column:
        total = F.get("totals", i + half) - F.get("totals", i - half) + F.get("ys", i - half)
        return F.when((i >= half) & (i + half < n), total / F.col("period"))

    listed = arrays.withColumn("smooth", F.transform(F.sequence(F.lit(0), n - 1), average))
    rows = listed.select("series_id", "period", n.alias("n"), F.posexplode(F.arrays_zip("dss", "ys", "smooth")).alias("idx", "r"))
    return rows.select("series_id", F.col("r.dss").alias("ds"), F.col("r.ys").alias("y"), "period", "n", "idx", F.col("r.smooth").alias("smooth"))


def classical(panel: DataFrame, period: int | None) -> DataFrame:
    """Additive decomposition: centred moving average and mean per phase.

    Without ``period`` every series takes that of its column ``own_period``. Series shorter than
    two periods get nulls. All steps are windows over the series.
    """
    whole = Window.partitionBy("series_id")
    if period is None:
        sized, average = _own_average(panel), F.col("smooth")
    else:
        sized = panel.withColumns({"idx": F.row_number().over(along()) - 1, "n": F.count(F.lit(1)).over(whole), "period": F.lit(period)})
        average = centred_average(period)
    long_enough = F.col("n") >= 2 * F.col("period")
    smooth = sized.withColumn("trend", F.when(long_enough, average))
    detrended = F.when(F.col("trend") != 0, F.col("y") - F.col("trend"))
    phased = smooth.withColumns({"phase": F.col("idx") % F.col("period"), "d": detrended})
    by_phase = Window.partitionBy("series_id", "phase")
    raw = phased.withColumn("raw", F.coalesce(F.avg("d").over(by_phase), F.lit(0.0)))
    # the mean over the phases, each counted once: its first row stands for it
    first_in_phase = F.when(F.col("idx") < F.col("period"), F.col("raw"))
    centred = raw.withColumn("seasonal", F.when(long_enough, F.col("raw") - F.sum(first_in_phase).over(whole) / F.col("period")))
    return centred.select(
        "series_id", "ds", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("residual")
    )


def seasonal_strength(parts: DataFrame) -> DataFrame:
    """``series_id, strength`` from 0 to 1: how much of what isn't trend is seasonal."""
    both = F.col("residual") + F.col("seasonal")
    share = 1 - ratio(F.var_pop("residual"), F.var_pop(both))
    return parts.groupBy("series_id").agg(F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0))).alias("strength"))


def trend_line(panel: DataFrame) -> DataFrame:
    """Least-squares line of each series beside its rows."""
    whole = Window.partitionBy("series_id")
    indexed = panel.withColumn("idx", (F.row_number().over(along()) - 1).cast("double"))
    n = F.count(F.lit(1)).over(whole)
    slope = F.coalesce(ratio(F.covar_pop("y", "idx").over(whole), F.var_pop("idx").over(whole)), F.lit(0.0))
    centre = F.avg("idx").over(whole)
    line = F.avg("y").over(whole) + slope * (F.col("idx") - centre)
    return indexed.select("series_id", "ds", "y", F.when(n >= 2, line).alias("trend"))


def outlier_flags(panel: DataFrame) -> DataFrame:
    """Rows beyond 1.5 times the distance of the quartiles taken by floor index."""
    whole = Window.partitionBy("series_id")
    ranked = panel.withColumns(
        {"pos": F.row_number().over(whole.orderBy("y", "ds")) - 1, "n": F.count(F.lit(1)).over(whole)}
    )

    def at(share: float) -> Column:
        return F.max(F.when(F.col("pos") == F.floor(F.col("n") * share), F.col("y"))).over(whole)

    cut = ranked.withColumns({"q1": at(0.25), "q3": at(0.75)})
    spread = F.col("q3") - F.col("q1")
    outside = (F.col("y") < F.col("q1") - 1.5 * spread) | (F.col("y") > F.col("q3") + 1.5 * spread)
    return cut.select("series_id", "ds", "y", ((F.col("n") >= 4) & outside).alias("is_outlier"))


# --- robust decomposition by local regression ----------------------------------------------


def _local_line(y: np.ndarray, span: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Tricube-weighted local linear smooth at every point, for all points at once."""
    n = len(y)
    span = int(min(span, n))
    start = np.clip(np.arange(n) - span // 2, 0, n - span)
    index = start[:, None] + np.arange(span)
    offset = index - np.arange(n)[:, None]
    reach = np.abs(offset).max(axis=1, keepdims=True) + 1.0
    w = (1 - (np.abs(offset) / reach) ** 3) ** 3
    if weight is not None:
        w = w * weight[index]
    values = y[index]
    total = w.sum(axis=1)
    total[total == 0] = 1.0
    mx, my = (w * offset).sum(axis=1) / total, (w * values).sum(axis=1) / total
    dx = offset - mx[:, None]
    spread = (w * dx * dx).sum(axis=1)
    slope = np.where(spread > 1e-9, (w * dx * (values - my[:, None])).sum(axis=1) / np.where(spread > 1e-9, spread, 1), 0.0)
    return my - slope * mx


def robust_parts(y: np.ndarray, period: int, robust: bool = True, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and residual by alternating local smooths with bisquare weights."""
    n = len(y)
    phase = np.arange(n) % period
    span = max(period + 1, int(1.5 * period)) | 1
    weight = np.ones(n)
    trend, seasonal = np.zeros(n), np.zeros(n)
    for _ in range(rounds if robust else 1):
        for _ in range(2):
            rest = y - trend
            for p in range(period):
                rows = phase == p
                seasonal[rows] = _local_line(rest[rows], 7, weight[rows])
            # what the phases share belongs to the trend
            seasonal = seasonal - _local_line(seasonal, span)
            trend = _local_line(y - seasonal, span, weight)
        residual = y - trend - seasonal
        limit = 6 * np.median(np.abs(residual))
        if limit <= 1e-12:
            break
        weight = np.clip(1 - (residual / limit) ** 2, 0, 1) ** 2
    return trend, seasonal, y - trend - seasonal


def robust_decompose(panel: DataFrame, period: int | None = None) -> DataFrame:
    """One array row per series with period, components and seasonal strength.

    The period is that of the column ``own_period`` if there is one, else ``period``, else the
    dominant one; series below 14 rows are left out.
    """
    own = "own_period" in panel.columns

    def work(row: pd.Series) -> dict:
        y = np.asarray(row["ys"], float)
        n = len(y)
        chosen = int(row["own_periods"][-1]) if own else period
        if chosen is None or chosen < 2:
            found = _spectrum_periods(y, min(365, n // 2))
            chosen = found[0] if found else max(2, n // 10)
        chosen = max(2, min(chosen, n // 2))
        trend, seasonal, residual = robust_parts(y, chosen)
        spread = float(np.var(residual + seasonal))
        strength = min(1.0, max(0.0, 1 - float(np.var(residual)) / spread)) if spread > 1e-9 else 0.0
        return {"period": chosen, "strength": round(strength, 4), "trend": trend, "seasonal": seasonal, "residual": residual}

    arrays = as_arrays(panel, "y", *(["own_period"] if own else [])).filter(F.size("ys") >= 14)
    schema = ("series_id string, last_ds date, ys array<double>, dss array<date>, period int, strength double, "
              "trend array<double>, seasonal array<double>, residual array<double>")
    return per_row(arrays, schema, work, ("series_id", "last_ds", "ys", "dss"))


def decomposition_rows(decomposed: DataFrame) -> DataFrame:
    rows = F.explode(F.arrays_zip("dss", "ys", "trend", "seasonal", "residual"))
    return decomposed.select("series_id", "period", "strength", rows.alias("r")).select(
        "series_id", "period", "strength", F.col("r.dss").alias("ds"), F.col("r.ys").alias("y"),
        "r.trend", "r.seasonal", "r.residual",
    )


def seasonal_params(periods: DataFrame, models: list[str]) -> DataFrame:
    """Parameters implied by the detected periods, one row per series and model.

    ``periods`` has an array column ``periods``, strongest first.
    """
    first, second = F.get("periods", F.lit(0)), F.get("periods", F.lit(1))
    rows = periods.withColumns({"first": first, "second": second}).filter(F.col("first").isNotNull())
    named = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    p, s, m = F.col("first"), F.col("second"), F.col("model")
    additive = m == "prophet"
    yearly = F.when(additive & (s == 30) & (p != 30), False).when(additive & p.isin(52, 53, 12, 30), True)
    weekly = (
        F.when(additive & ((p == 7) | ((s == 7) & (p != 7))), True).when(additive & p.isin(52, 53), False)
    )
    return named.select(
        "series_id", "model",
        F.when(m.isin("ets", "theta", "stl", "wma"), p).alias("seasonal_periods"),
        F.when(m == "sarimax", p).alias("seasonal_period"),
        yearly.alias("yearly_seasonality"), weekly.alias("weekly_seasonality"),
    )


def merged_params(auto: DataFrame, strength: DataFrame, user: dict[str, dict[str, str]], least: float = 0.15,
                  tuned: DataFrame | None = None) -> DataFrame:
    """Parameter map per series and model: automatic ones of strongly seasonal series
    under the user's, and both under those of ``tuned`` (``series_id, model, params``)."""
    text = auto.join(strength.select("series_id", "strength"), "series_id")
    names = ["seasonal_periods", "seasonal_period", "yearly_seasonality", "weekly_seasonality"]
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])
    found = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    empty = F.map_from_entries(F.filter(entries, lambda e: F.lit(False)))
    chosen = F.when(F.col("strength") > least, found).otherwise(empty)
    given = empty
    for model, params in user.items():
        pairs = F.create_map(*[F.lit(x) for kv in params.items() for x in (kv[0], str(kv[1]))])
        given = F.when(F.col("model") == model, pairs).otherwise(given)
    merged = text.select("series_id", "model", _over(given, chosen).alias("params"))
    if tuned is None:
        return merged
    both = merged.join(tuned.select("series_id", "model", F.col("params").alias("best")), ["series_id", "model"], "full_outer")
    filled = both.withColumns({c: F.coalesce(c, F.create_map().cast("map<string,string>")) for c in ("params", "best")})
    return filled.select("series_id", "model", _over(F.col("best"), F.col("params")).alias("params"))


def _over(winner: Column, other: Column) -> Column:
    """Both maps in one; a key of ``winner`` hides all names of the same parameter in ``other``."""
    hidden = F.map_keys(winner)
    for names in ALIASES.values():
        both = F.array(*[F.lit(n) for n in names])
        hidden = F.when(F.arrays_overlap(hidden, both), F.array_union(hidden, both)).otherwise(hidden)
    return F.map_concat(F.map_filter(other, lambda k, v: ~F.array_contains(hidden, k)), winner)
