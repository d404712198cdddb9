"""Additive regression: changing trend, yearly and weekly cycles and regressors.

One ridge regression per series; penalties stand for the prior scales. Each series is
one array row, so series are spread over the tasks by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import align_regressors, daily_regressors
from .base import Factors, Z95, as_arrays, configured, per_row, steps

CHANGEPOINTS, CHANGE_RANGE = 25, 0.8  # fixed values: number and share of history of trend changes
YEARLY_TERMS, WEEKLY_TERMS = 10, 3  # fixed values: Fourier pairs
REGRESSORS = ["promo_discount", "media_spend", "holiday_impact", "event_impact"]

STATE = (
    "series_id string, last_ds date, first_day double, span double, scale double, sigma double, n int, log_scale boolean, "
    "coef array<double>, means array<double>, regressors array<string>, names array<string>"
)


def _days(dates) -> np.ndarray:
    return pd.to_datetime(pd.Series(list(dates))).to_numpy().astype("datetime64[D]").astype(float)


@dataclass(frozen=True)
class AdditiveRegression:
    seasonality_mode: str = "additive"
    yearly_seasonality: bool = True
    weekly_seasonality: bool = True
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    holidays_prior_scale: float = 10.0
    name: str = "prophet"
    tunable = (
        "seasonality_mode", "yearly_seasonality", "weekly_seasonality", "changepoint_prior_scale", "seasonality_prior_scale",
        "holidays_prior_scale",
    )

    def _names(self, regressors: list[str]) -> list[str]:
        names = ["intercept", "slope", *[f"change_{i}" for i in range(CHANGEPOINTS)]]
        if self.yearly_seasonality:
            names += [f"yearly_{f}{k}" for k in range(1, YEARLY_TERMS + 1) for f in ("sin", "cos")]
        if self.weekly_seasonality:
            names += [f"weekly_{f}{k}" for k in range(1, WEEKLY_TERMS + 1) for f in ("sin", "cos")]
        return names + regressors

    def _design(self, days: np.ndarray, first: float, span: float, x: np.ndarray) -> np.ndarray:
        t = (days - first) / span
        knots = np.linspace(0, CHANGE_RANGE, CHANGEPOINTS + 1)[1:]
        columns = [np.ones_like(t), t, *[np.maximum(t - k, 0) for k in knots]]
        cycles = [(365.25, YEARLY_TERMS)] * self.yearly_seasonality + [(7.0, WEEKLY_TERMS)] * self.weekly_seasonality
        for period, terms in cycles:
            for k in range(1, terms + 1):
                angle = 2 * np.pi * k * days / period
                columns += [np.sin(angle), np.cos(angle)]
        return np.column_stack([*columns, x])

    def _penalties(self, names: list[str], noise: float) -> np.ndarray:
        def prior(name: str) -> float:
            if name in ("intercept", "slope"):
                return 5.0
            if name.startswith("change_"):
                return self.changepoint_prior_scale
            if name.startswith(("yearly_", "weekly_")):
                return self.seasonality_prior_scale
            return self.holidays_prior_scale

        return noise**2 / np.array([prior(n) for n in names]) ** 2

    def fit(self, panel: DataFrame, factors: Factors | None = None, settings: DataFrame | None = None) -> DataFrame:
        aligned = align_regressors(panel, factors) if factors else panel
        regressors = [r for r in REGRESSORS if r in aligned.columns]
        kinds = {str: "string", bool: "boolean", float: "double"}
        own = {name: (kinds[type(getattr(self, name))], getattr(self, name)) for name in self.tunable}
        arrays = configured(as_arrays(aligned, "y", *regressors), settings, own)

        def work(row: pd.Series) -> dict:
            model = replace(self, **{name: row[f"own_{name}"] for name in self.tunable})
            names = model._names(regressors)
            y, days = np.asarray(row["ys"], float), _days(row["dss"])
            columns = [np.asarray(row[f"{r}s"], float) for r in regressors]
            x = np.column_stack(columns) if columns else np.zeros((len(y), 0))
            width = np.abs(x).max(axis=0) if x.shape[1] else np.zeros(0)
            width[width == 0] = 1.0
            log_scale = model.seasonality_mode == "multiplicative" and y.min() > 0
            target = np.log(y) if log_scale else y
            scale = float(np.abs(target).max()) or 1.0
            target = target / scale
            first, span = float(days[0]), max(1.0, float(days[-1] - days[0]))
            design = model._design(days, first, span, x / width)
            gram, moment = design.T @ design, design.T @ target
            noise = 0.1
            for _ in range(2):  # the second pass uses the noise seen in the first
                coef = np.linalg.solve(gram + np.diag(model._penalties(names, noise) + 1e-9), moment)
                noise = max(float(np.std(target - design @ coef)), 1e-4)
            if len(regressors):
                coef[-len(regressors) :] /= width
                design[:, -len(regressors) :] *= width
            return {
                "first_day": first, "span": span, "scale": scale, "sigma": noise, "n": len(y), "log_scale": bool(log_scale),
                "coef": coef, "means": design.mean(axis=0), "regressors": regressors, "names": names,
            }

        return per_row(arrays, STATE, work, ("series_id", "last_ds"))

    def _evaluate(self, dated: DataFrame, fitted: DataFrame, factors: Factors | None) -> DataFrame:
        """Array rows of fitted parameters with dates, steps and design products."""
        names = []
        if factors:
            daily = daily_regressors(factors)
            names = [c for c in daily.columns if c != "ds"]
            dated = dated.join(daily, "ds", "left").fillna(0.0, names)
        rows = dated.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("step", "ds", *names))).alias("rows"))
        joined = fitted.join(rows, "series_id").select(
            *fitted.columns, F.col("rows")["step"].alias("steps"), F.col("rows")["ds"].alias("dss"),
            *[F.col("rows")[n].alias(n) for n in names],
        )

        def work(row: pd.Series) -> dict:
            days = _days(row["dss"])
            listed = list(row["regressors"])
            x = np.zeros((len(days), len(listed)))
            for i, r in enumerate(listed):
                if r in names:
                    x[:, i] = np.asarray(row[r], float)
            cycles = {f"{c}_seasonality": any(n.startswith(f"{c}_") for n in row["names"]) for c in ("yearly", "weekly")}
            design = replace(self, **cycles)._design(days, row["first_day"], row["span"], x)
            coef = np.asarray(row["coef"], float)
            parts = design * coef * row["scale"]
            kinds = np.array([n.split("_")[0] if n.startswith(("yearly_", "weekly_")) else
                              "trend" if n in ("intercept", "slope") or n.startswith("change_") else "regressors" for n in row["names"]])
            total = parts.sum(axis=1)
            spread = Z95 * row["sigma"] * row["scale"] * np.sqrt(1 + np.asarray(row["steps"], float).clip(0) / row["n"])
            low, high = total - spread, total + spread
            if row["log_scale"]:
                total, low, high = np.exp(total), np.exp(low), np.exp(high)
            centred = coef * (design - np.asarray(row["means"], float)) * row["scale"]
            return {
                "steps": row["steps"], "dss": row["dss"], "yhat": total, "lower_ci": low, "upper_ci": high,
                "trend": parts[:, kinds == "trend"].sum(axis=1), "yearly": parts[:, kinds == "yearly"].sum(axis=1),
                "weekly": parts[:, kinds == "weekly"].sum(axis=1), "names": row["names"], "contributions": centred.ravel(),
            }

        schema = ("series_id string, steps array<int>, dss array<date>, yhat array<double>, lower_ci array<double>, upper_ci array<double>, "
                  "trend array<double>, yearly array<double>, weekly array<double>, names array<string>, contributions array<double>")
        return per_row(joined, schema, work, ("series_id",))

    def _rows(self, evaluated: DataFrame, *extra: str) -> DataFrame:
        zipped = F.explode(F.arrays_zip("steps", "dss", "yhat", "lower_ci", "upper_ci", *extra))
        return evaluated.select("series_id", zipped.alias("r")).select(
            "series_id", F.col("r.steps").alias("step"), F.col("r.dss").alias("ds"), "r.yhat", "r.lower_ci", "r.upper_ci",
            *[f"r.{e}" for e in extra],
        )

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame:
        dated = steps(fitted.select("series_id", "last_ds"), horizon, freq)
        return self._rows(self._evaluate(dated, fitted, factors))

    def in_sample(self, panel: DataFrame, fitted: DataFrame, factors: Factors | None = None) -> DataFrame:
        """Fitted value beside each row of the panel."""
        dated = panel.select("series_id", "ds").withColumn("step", F.lit(0))
        fits = self._rows(self._evaluate(dated, fitted, factors)).select("series_id", "ds", "yhat")
        return panel.join(fits, ["series_id", "ds"])

    def components(self, fitted: DataFrame, horizon: int, freq: str = "D") -> DataFrame:
        dated = steps(fitted.select("series_id", "last_ds"), horizon, freq)
        rows = self._rows(self._evaluate(dated, fitted, None), "trend", "yearly", "weekly")
        return rows.select("series_id", "step", "ds", "trend", "yearly", "weekly")

    def contributions(self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None) -> DataFrame:
        """Exact part of each feature in each forecast, against its mean in training."""
        dated = steps(fitted.select("series_id", "last_ds"), horizon, freq)
        done = self._evaluate(dated, fitted, factors)
        step = F.posexplode("steps")
        rows = done.select("series_id", "names", "contributions", step.alias("pos", "step"))
        width = F.size("names")
        mine = F.slice("contributions", F.col("pos") * width + 1, width)
        named = F.explode(F.arrays_zip("names", mine.alias("value")))
        return rows.select("series_id", "step", named.alias("c")).select(
            "series_id", "step", F.col("c.names").alias("feature"), F.col("c.value").alias("contribution")
        )


def rank_contributions(contributions: DataFrame, k: int = 15) -> DataFrame:
    """Features by mean absolute contribution per series."""
    from ..operators.ranking import top_k

    means = contributions.groupBy("series_id", "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return top_k(means, ["series_id"], [F.desc("mean_abs"), "feature"], k)
