"""Exponential smoothing, theta and decomposition forecasters.

A recursion sees one array row per series. The single-state one of theta is a fold over
the array inside Spark; the one with seasonal states runs in Arrow batches, all weight
combinations side by side. No row is copied per candidate.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ratio
from ..operators.decompose import classical, robust_decompose
from ..operators.grid import along
from .base import Factors, Z95, as_arrays, banded, configured, per_row, steps


@dataclass(frozen=True)
class Theta:
    """Deseasonalised exponential smoothing plus half the linear drift."""

    period: int = 7
    deseasonalize: bool = True
    alpha: float | None = None  # None: the best of ``alphas`` by one-step errors
    alphas: tuple[float, ...] = tuple(round(0.05 * i, 2) for i in range(1, 20))
    name: str = "theta"
    tunable = ("period", "deseasonalize", "alpha")

    def fit(self, panel: DataFrame, factors: Factors | None = None, settings: DataFrame | None = None) -> DataFrame:
        own = {"period": ("int", self.period), "deseasonalize": ("boolean", self.deseasonalize), "alpha": ("double", self.alpha)}
        panel = configured(panel, settings, own)
        whole = Window.partitionBy("series_id")
        n = F.count(F.lit(1)).over(whole)
        indexed = panel.withColumns({"idx": F.row_number().over(along()) - 1, "n": n})
        cycle = F.least(F.greatest(F.lit(2), F.col("own_period")), F.greatest(F.lit(2), F.floor(F.col("n") / 2))).cast("int")
        phased = indexed.withColumn("cycle", cycle).withColumn("phase", F.col("idx") % F.col("cycle"))
        level, low = F.avg("y").over(whole), F.min("y").over(whole)
        mean = F.avg("y").over(Window.partitionBy("series_id", "phase"))
        # ratios need positive data; otherwise the phases stay as they are
        season = phased.withColumn("season", F.when((low > 0) & F.col("own_deseasonalize"), ratio(mean, level, 1.0)).otherwise(1.0))
        plain = season.withColumn("x", F.when(F.col("season") > 0, F.col("y") / F.col("season")).otherwise(F.col("y")))
        arrays = as_arrays(plain, "x", "season", "cycle", "own_alpha")
        rows = arrays.withColumns({"n": F.size("xs"), "cycle": F.element_at("cycles", -1), "fixed": F.element_at("own_alphas", -1)})
        # least squares on 0..n-1: the index has variance (n^2 - 1) / 12
        size = F.col("n").cast("double")
        moment = F.aggregate(F.transform("xs", lambda x, i: x * (i - (size - 1) / 2)), F.lit(0.0), lambda s, v: s + v)
        rows = rows.withColumn("slope", ratio(moment * 12, size * (size * size - 1), 0.0))
        grid = F.array(*[F.lit(a) for a in self.alphas])
        fits = F.transform(F.when(F.col("fixed").isNotNull(), F.array("fixed")).otherwise(grid), self._smooth)
        best = F.array_min(fits)
        return rows.withColumn("best", best).select(
            "series_id", "last_ds", "n", "cycle", "slope",
            F.col("best.alpha").alias("alpha"), F.col("best.level").alias("level"),
            F.sqrt(F.col("best.sse") / F.greatest(F.col("n") - 1, F.lit(1))).alias("sigma"),
            F.slice("seasons", -F.col("cycle"), F.col("cycle")).alias("seasons"),
        )

    @staticmethod
    def _smooth(alpha: Column) -> Column:
        """Level after the last value and the sum of squared one-step errors."""

        def step(state: Column, x: Column) -> Column:
            error = x - state["level"]
            return F.struct((state["sse"] + error * error).alias("sse"), (state["level"] + alpha * error).alias("level"))

        start = F.struct(F.lit(0.0).alias("sse"), F.get("xs", F.lit(0)).alias("level"))
        end = F.aggregate("xs", start, step)
        return F.struct(end["sse"].alias("sse"), alpha.alias("alpha"), end["level"].alias("level"))

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame:
        grid = steps(fitted, horizon, freq)
        a, h = F.col("alpha"), F.col("step")
        drift = 0.5 * F.col("slope") * (h - 1 + (1 - F.pow(1 - a, F.col("n"))) / a)
        season = F.get("seasons", (h - 1) % F.col("cycle"))
        return banded(grid, (F.col("level") + drift) * season, Z95 * F.col("sigma") * F.sqrt(h.cast("double")))


@dataclass(frozen=True)
class ETS:
    """Level, damped trend and season, each additive or multiplicative or absent.

    Candidates are all combinations of the smoothing weights; the smallest sum of squared
    one-step errors wins. Series too short for a season fall back to the trend form, and
    below five rows to the mean.
    """

    trend: str | None = "add"
    seasonal: str | None = "add"
    seasonal_periods: int = 7
    damped_trend: bool = True
    alphas: tuple[float, ...] = (0.05, 0.2, 0.5, 0.8)
    betas: tuple[float, ...] = (0.01, 0.1, 0.3)
    gammas: tuple[float, ...] = (0.05, 0.2)
    phi: float = 0.98
    name: str = "ets"
    tunable = ("trend", "seasonal", "seasonal_periods", "damped_trend")

    def fit(self, panel: DataFrame, factors: Factors | None = None, settings: DataFrame | None = None) -> DataFrame:
        arrays = configured(as_arrays(panel), settings, {
            "trend": ("string", self.trend), "seasonal": ("string", self.seasonal),
            "seasonal_periods": ("int", self.seasonal_periods), "damped_trend": ("boolean", self.damped_trend),
        })
        n = F.size("ys")
        m = F.least(F.greatest(F.lit(2), F.col("own_seasonal_periods")), F.greatest(F.lit(2), F.floor(n / 2))).cast("int")
        kinds = {"trend_kind": F.coalesce("own_trend", F.lit("none")), "season_kind": F.coalesce("own_seasonal", F.lit("none"))}
        sized = arrays.withColumns({"n": n, "m": m, **kinds, "phi": F.when(F.col("own_damped_trend"), self.phi).otherwise(1.0)})
        lowest = F.array_min("ys")
        # multiplicative parts need positive data
        multiplicative_ok = lowest > 0
        trend, seasonal = F.col("trend_kind"), F.col("season_kind")
        seasonal_on = (seasonal != "none") & (n >= 2 * m) & ((seasonal != "mul") | multiplicative_ok)
        head = F.slice("ys", 1, F.col("m"))
        head_mean = F.aggregate(head, F.lit(0.0), lambda s, y: s + y) / F.col("m")
        second = F.slice("ys", F.col("m") + 1, F.col("m"))
        second_mean = F.aggregate(second, F.lit(0.0), lambda s, y: s + y) / F.col("m")
        factor = F.transform(head, lambda y: F.when(head_mean > 0, y / head_mean).otherwise(1.0))
        season = F.when(seasonal == "mul", factor).otherwise(F.transform(head, lambda y: y - head_mean))
        flat = F.transform(head, lambda y: F.when(seasonal == "mul", 1.0).otherwise(0.0))
        grown = F.when(multiplicative_ok & (n >= 2 * m) & (head_mean > 0), F.pow(second_mean / head_mean, 1 / F.col("m"))).otherwise(1.0)
        moved = F.when(n >= 2 * m, (second_mean - head_mean) / F.col("m")).otherwise(0.0)
        started = sized.withColumns({
            "level0": head_mean, "trend0": F.when(trend == "mul", grown).when(trend == "add", moved).otherwise(0.0),
            "season0": F.when(seasonal_on, season).otherwise(flat), "seasonal_on": seasonal_on,
        })

        def work(row: pd.Series) -> dict:
            own = replace(self, trend=row["trend_kind"], seasonal=row["season_kind"])
            if row["n"] < 5:
                return {"level": float(np.mean(row["ys"])), "trend": 1.0 if own.trend == "mul" else 0.0,
                        "season": [1.0 if own.seasonal == "mul" else 0.0] * row["m"], "sigma": 0.0, "alpha": None, "beta": None, "gamma": None}
            return own._search(row)

        schema = ("series_id string, last_ds date, n int, m int, trend_kind string, season_kind string, phi double, level double, trend double, "
                  "season array<double>, sigma double, alpha double, beta double, gamma double")
        return per_row(started, schema, work, ("series_id", "last_ds", "n", "m", "trend_kind", "season_kind", "phi"))

    def _options(self) -> np.ndarray:
        """Weight combinations that matter for the parts in use."""
        betas = self.betas if self.trend != "none" else (0.0,)
        return np.array(list(product(self.alphas, betas, self.gammas if self.seasonal != "none" else (0.0,)))).T

    def _search(self, row: pd.Series) -> dict:
        """Run the recursion once with all weight combinations side by side; keep the best."""
        a, b, g = self._options()
        phi, mul_season, mul_trend = row["phi"], self.seasonal == "mul", self.trend == "mul"
        m, seasonal_on = int(row["m"]), bool(row["seasonal_on"])
        level, trend, sse = np.full(len(a), row["level0"]), np.full(len(a), row["trend0"]), np.zeros(len(a))
        season = np.repeat(np.asarray(row["season0"], float)[:, None], len(a), axis=1)
        with np.errstate(all="ignore"):
            for t, y in enumerate(row["ys"]):
                s = season[t % m]
                moved = level * trend**phi if mul_trend else level + phi * trend
                sse += (y - (moved * s if mul_season else moved + s)) ** 2
                plain = np.where(s != 0, y / s, y) if mul_season else y - s
                fresh = (np.where(moved != 0, y / moved, 1.0) if mul_season else y - moved) if seasonal_on else s
                before, level = level, a * plain + (1 - a) * moved
                if mul_trend:
                    change = np.where(before > 0, level / before, 1.0)
                    trend = np.maximum(b * change + (1 - b) * trend**phi, 0.01)
                elif self.trend == "add":
                    trend = b * (level - before) + (1 - b) * phi * trend
                if seasonal_on:
                    season[t % m] = g * fresh + (1 - g) * s
        best = int(np.argmin(np.where(np.isfinite(sse), sse, np.inf)))
        n = len(row["ys"])
        return {
            "level": level[best], "trend": trend[best], "season": np.roll(season[:, best], -(n % m)),
            "sigma": float(np.sqrt(sse[best] / n)), "alpha": a[best], "beta": b[best], "gamma": g[best],
        }

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame:
        grid = steps(fitted, horizon, freq)
        phi, h = F.col("phi"), F.col("step")
        # phi + phi^2 + ... + phi^h
        total = F.when(phi == 1.0, h.cast("double")).otherwise((1 - F.pow(phi, h)) * phi / (1 - phi))
        grown = F.col("level") * F.pow("trend", total)
        base = F.when(F.col("trend_kind") == "mul", grown).otherwise(F.col("level") + total * F.col("trend"))
        season = F.get("season", (h - 1) % F.col("m"))
        value = F.when(F.col("season_kind") == "mul", base * season).otherwise(base + season)
        return banded(grid, value, Z95 * F.col("sigma") * F.sqrt(h.cast("double")))


@dataclass(frozen=True)
class STL:
    """Decomposition, straight line through the trend, last seasonal cycle repeated."""

    period: int = 7
    robust: bool = False  # False: classical parts in SQL; True: robust local regression
    non_negative: bool = True
    name: str = "stl"
    tunable = ("period", "robust")

    def fit(self, panel: DataFrame, factors: Factors | None = None, settings: DataFrame | None = None) -> DataFrame:
        own = configured(panel, settings, {"period": ("int", self.period), "robust": ("boolean", self.robust)})
        own = own.withColumn("own_period", F.greatest(F.lit(2), "own_period"))
        period = None if settings is not None else max(2, self.period)
        if self.robust or settings is not None:
            # series too short for the local regressions keep the classical route
            n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
            smooth = F.col("own_robust") & (n >= F.greatest(F.lit(14), 2 * F.col("own_period")))
            sized = own.withColumn("smooth_it", smooth)
            done = robust_decompose(sized.filter("smooth_it"))
            rows = done.select("series_id", F.explode(F.arrays_zip("dss", "ys", "trend", "seasonal", "residual")).alias("r"))
            parts = rows.select("series_id", F.col("r.dss").alias("ds"), F.col("r.ys").alias("y"), "r.trend", "r.seasonal", "r.residual")
            parts = parts.unionByName(classical(sized.filter("not smooth_it"), period))
        else:
            parts = classical(panel, period)
        if settings is None:
            parts = parts.withColumn("period", F.lit(period))
        else:
            parts = configured(parts, settings, {"period": ("int", self.period)}).withColumn("period", F.greatest(F.lit(2), "own_period"))
        indexed = parts.withColumns({
            "idx": F.row_number().over(along()) - 1,
            "age": F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ds"))),
        })
        both = F.col("residual") + F.col("seasonal")
        cycle = F.collect_list(F.when(F.col("age") <= F.col("period"), F.struct("idx", "seasonal")))
        stats = indexed.groupBy("series_id").agg(
            F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"), F.max("period").alias("period"),
            F.regr_slope("trend", "idx").alias("slope"), F.regr_intercept("trend", "idx").alias("intercept"),
            F.regr_slope("y", "idx").alias("y_slope"), F.regr_intercept("y", "idx").alias("y_intercept"),
            F.stddev_pop("residual").alias("sigma"), F.stddev_pop("y").alias("y_sigma"),
            F.greatest(F.lit(0.0), 1 - ratio(F.var_pop("residual"), F.var_pop(both))).alias("strength"),
            F.transform(F.array_sort(cycle), lambda c: F.coalesce(c["seasonal"], F.lit(0.0))).alias("cycle"),
        )
        # too short for a decomposition: a line through the values and no season
        usable = F.col("slope").isNotNull() & (F.col("n") >= 2 * F.col("period"))
        return stats.select(
            "series_id", "last_ds", "n", F.coalesce(F.when(usable, F.col("slope")), "y_slope", F.lit(0.0)).alias("slope"),
            F.coalesce(F.when(usable, F.col("intercept")), "y_intercept", F.lit(0.0)).alias("intercept"),
            F.coalesce(F.when(usable, F.col("sigma")), "y_sigma").alias("sigma"),
            F.coalesce(F.when(usable, F.col("strength")), F.lit(0.0)).alias("strength"), "cycle",
        )

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame:
        grid = steps(fitted, horizon, freq)
        i = F.col("step") - 1
        season = F.coalesce(F.get("cycle", i % F.greatest(F.size("cycle"), F.lit(1))), F.lit(0.0))
        value = F.col("intercept") + F.col("slope") * (F.col("n") + i) + season
        return banded(grid, value, Z95 * F.col("sigma") * F.sqrt(F.col("step").cast("double")), non_negative=self.non_negative)

    def components(self, fitted: DataFrame) -> DataFrame:
        return fitted.select("series_id", F.col("slope").alias("trend_slope"), F.col("strength").alias("seasonal_strength"),
                             F.col("sigma").alias("residual_std"))
