"""Model choice by series profile, and the hybrid of regression and boosted residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.profile import pattern_profile
from ..operators.ranking import union_all
from ..functions.scalars import safe_float
from ..store import materialize
from .additive import AdditiveRegression
from .arima import ARIMA, SARIMAX
from .base import FORECAST, Factors, Forecaster
from .boosted import Boosted, boosted_rows
from .smoothing import ETS, STL, Theta
from .wma import WMA, Naive

STRATEGIES = ["boosted", "hybrid", "additive", "sarimax", "theta", "wma", "arima", "ets"]
RESIDUAL_SHARE, BAND_GROWTH = 0.3, 1.2  # fixed values of the hybrid


def strategy(has_factors: bool, factor_correlation: Column | None = None) -> Column:
    """First rule that fits a profile row."""
    n, season = F.col("n_points"), F.col("seasonal_strength")
    factors = F.lit(has_factors)
    strong = F.coalesce(F.abs(factor_correlation) > 0.3, F.lit(False)) if factor_correlation is not None else F.lit(False)
    return (
        F.when((n >= 100) & factors & strong & F.col("frequency").isin("D", "2D"), "boosted")
        .when((season > 0.3) & (n >= 50) & factors, "hybrid")
        .when((season > 0.3) & (n >= 30), "additive")
        .when(F.col("has_ar") & factors & (n >= 30), "sarimax")
        .when(F.col("frequency").isin("MS", "QS") & (F.col("trend_strength") > 0.2), "theta")
        .when((F.col("sparsity") > 0.3) | (n < 30), "wma")
        .when(F.col("has_ar") | F.col("has_ma"), "arima")
        .otherwise("ets")
    )


def route(panel: DataFrame, factors: Factors | None = None) -> DataFrame:
    """Profile of each series with its strategy."""
    profile = pattern_profile(panel)
    if not factors:
        return profile.withColumn("strategy", strategy(False))
    from ..operators.events import factor_lags

    strongest = factor_lags(panel, factors).groupBy("series_id").agg(F.max(F.abs("correlation")).alias("factor_correlation"))
    joined = profile.join(strongest, "series_id", "left")
    return joined.withColumn("strategy", strategy(True, F.col("factor_correlation")))


class Hybrid:
    """Additive regression plus a share of boosted residuals, with a wider band."""

    pooled = True
    name = "hybrid"

    def __init__(self, base: AdditiveRegression | None = None, residual: Boosted | None = None) -> None:
        self.base = base or AdditiveRegression()
        self.residual = residual or boosted_rows(100, 0.05, 3, 3, non_negative=False, scale="sd", name="residual")
        self._residual_state: DataFrame | None = None

    def fit(self, panel: DataFrame, factors: Factors | None = None) -> DataFrame:
        fitted = self.base.fit(panel, factors)
        inside = self.base.in_sample(panel, fitted, factors)
        rest = inside.select("series_id", "ds", (F.col("y") - F.col("yhat")).alias("y"))
        self._residual_state = self.residual.fit(rest, factors)
        return fitted

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame:
        if self._residual_state is None:
            raise ValueError("the model is not fitted")
        first = self.base.forecast(fitted, horizon, freq, factors)
        rest = self.residual.forecast(self._residual_state, horizon, freq, factors).select(
            "series_id", "step", F.col("yhat").alias("rest"))
        value = safe_float("yhat") + RESIDUAL_SHARE * safe_float("rest")
        above = F.greatest(F.col("upper_ci") - F.col("yhat"), F.lit(0.0))
        half = F.when(above > 0, above).otherwise(F.abs("yhat") * 0.1) * BAND_GROWTH
        joined = first.join(rest, ["series_id", "step"], "left")
        return joined.select(
            "series_id", "step", "ds", value.alias("yhat"), (value - half).alias("lower_ci"), (value + half).alias("upper_ci")
        )


def strategy_model(name: str) -> Forecaster:
    """The forecaster behind a strategy."""
    if name == "boosted":
        return Boosted(500, 0.03, 7, 63, 10, 0.8, 0.8)
    if name == "hybrid":
        return Hybrid()
    return {
        "additive": AdditiveRegression(), "sarimax": SARIMAX((2, 1, 2), (1, 0, 1, 7)), "theta": Theta(12),
        "wma": WMA(30), "arima": ARIMA((2, 0, 2)), "ets": ETS(),
    }[name]


class AutoML:
    """Routes each series to a strategy and runs every strategy on its own subset."""

    pooled = True
    name = "automl"

    def __init__(self, strategies: list[str] | None = None) -> None:
        self.strategies = strategies or STRATEGIES
        self.routes: DataFrame | None = None
        self._fits: dict[str, tuple[Forecaster, DataFrame]] = {}

    def fit(self, panel: DataFrame, factors: Factors | None = None) -> DataFrame:
        self.routes = materialize(route(panel, factors).select("series_id", "strategy"))
        used = {r[0] for r in self.routes.select("strategy").distinct().collect()}
        self._fits = {}
        for name in [s for s in self.strategies if s in used]:
            part = panel.join(self.routes.filter(F.col("strategy") == name), "series_id", "left_semi")
            model = strategy_model(name)
            self._fits[name] = (model, model.fit(part, factors))
        return self.routes

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame:
        parts = [model.forecast(state, horizon, freq, factors).select(*FORECAST) for model, state in self._fits.values()]
        if not parts:
            raise ValueError("the model is not fitted")
        return union_all(parts)


def default_models() -> dict[str, Forecaster]:
    """Every forecaster under its name."""
    found = [WMA(), Naive(), ETS(), Theta(), STL(), ARIMA(), SARIMAX(), AdditiveRegression(), Boosted(), boosted_rows(), AutoML()]
    return {m.name: m for m in found}
