"""End-to-end forecast run over a panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .models.auto import AutoML, Hybrid
from .models.base import Factors, Forecaster, fit_with, with_baseline
from .models.wma import Naive
from .operators import evaluate as ev
from .operators.decompose import merged_params, robust_decompose, seasonal_params, spectral_periods
from .operators.enrich import within_range
from .operators.events import detect_events, lag_analysis
from .operators.grid import downsample, downsample_factor
from .operators.profile import analyze
from .operators.ranking import rank_models, union_all, union_by_priority
from .operators.rollup import factor_totals, forecast_summary
from .operators.scenario import factor_contributions
from .operators.tuning import BUILDERS, as_text, build_model, from_text, tune
from .store import materialize, save_model

LEARNED = {"lightgbm", "xgboost", "automl", "hybrid"}  # models judged on a held-out share


@dataclass
class ForecastRequest:
    models: Sequence[str] = ("wma",)
    horizon: int = 30
    freq: str = "D"
    params: dict[str, dict] = field(default_factory=dict)
    tune: bool = False
    ensemble: Sequence[str] = ()
    ensemble_weights: dict[str, float] | None = None
    backtest_overlap: int = 0
    train_ratio: float = 0.8
    max_points: int | None = None  # shorten longer series; by default nothing is shortened
    include: Sequence[str] = ()  # factor kinds to use; empty: all given
    countries: Sequence[str] = ()  # detect calendar events for these


def build(name: str, request: ForecastRequest) -> Forecaster:
    params = dict(request.params.get(name, {}))
    if name == "naive":
        return Naive()
    if name == "automl":
        return AutoML()
    if name == "hybrid":
        return Hybrid()
    return build_model(name, params)


def gather_factors(panel: DataFrame, factors: Factors, request: ForecastRequest) -> Factors:
    """The wanted factor kinds; detected events complete the supplied holidays."""
    chosen = {k: v for k, v in factors.items() if not request.include or k in request.include}
    if request.countries:
        found = detect_events(panel, request.countries).select(
            F.col("event_ds").alias("ds"), F.col("name").alias("holiday_name"), F.col("impact").alias("holiday_impact")
        )
        parts = [found]
        if "holidays" in chosen:
            given = chosen["holidays"]
            name = F.col("holiday_name") if "holiday_name" in given.columns else F.lit("holiday")
            parts = [given.select("ds", name.alias("holiday_name"), "holiday_impact"), found]
        chosen["holidays"] = union_by_priority(parts, ["ds"], ["holiday_name"]).drop("source")
    return chosen


def run_forecast(panel: DataFrame, request: ForecastRequest, factors: Factors | None = None) -> dict[str, DataFrame]:
    """Tables of a run: history, cv, forecast, backtest, metrics, ranking, ensemble, summary ...

    The panel holds one row per series and period; categories, regions or products are
    series, so a per-category run is the same call on a finer panel. Panel, factors, fold
    metrics, backtests and forecasts are used many times, so they are written to the shared checkpoint folder
    once: a lost executor never sends the run back to the source.
    """
    panel = materialize(panel.select("series_id", "ds", "y"))
    factors = {k: materialize(f) for k, f in gather_factors(panel, factors or {}, request).items()}
    out: dict[str, DataFrame] = {"history": panel}
    if factors:
        out["factor_totals"] = factor_totals(factors)
    request = replace(request, params={m: dict(p) for m, p in request.params.items()})  # the caller's stays as it is
    freq, horizon = request.freq, request.horizon
    if request.max_points is not None:
        shorter = materialize(downsample(panel, request.max_points))
        out["downsampling"] = shorter.select("series_id", "level").distinct()
        levels = {r[0] for r in out["downsampling"].select("level").distinct().collect()}
        if "weekly" in levels and len(levels) > 1:
            raise ValueError("max_points makes some series weekly and leaves others daily; run them apart")
        if levels == {"weekly"}:
            # all series became weekly, so the frequency and the factors follow
            freq = "W"
            factors = {k: downsample_factor(f, shorter) for k, f in factors.items()}
        panel = shorter.select("series_id", "ds", "y")

    best = None
    if request.tune:
        tuned = [tune(panel, m, freq=freq, factors=factors or None) for m in request.models if m in BUILDERS]
        best = materialize(union_all(tuned))
        out["tuning"] = best.withColumn("params", F.to_json("params"))
        for name in [m for m in request.models if m in LEARNED & set(BUILDERS)]:
            row = best.filter(F.col("model") == name).select("params").first()  # one set for all series
            request.params[name] = {**request.params.get(name, {}), **({} if row is None else from_text(name, row["params"]))}

    parts = robust_decompose(panel)
    out["decomposition"] = parts.select("series_id", "period", "strength")
    auto = seasonal_params(spectral_periods(panel), list(request.models))
    user = {m: as_text(p) for m, p in request.params.items()}
    out["parameters"] = materialize(merged_params(auto, parts, user, tuned=best))
    settings = {m: out["parameters"].filter(F.col("model") == m).select("series_id", "params") for m in request.models}

    models = {name: build(name, request) for name in request.models}
    folds = union_all([ev.cross_validate(panel, m, min(7, horizon), ev.FOLDS, freq, factors or None, settings=settings[n]) for n, m in models.items()])
    folds = materialize(folds)
    out["cv_folds"] = folds
    out["cv"] = ev.fold_summary(folds)

    tests = None
    learned = [m for n, m in models.items() if n in LEARNED]
    if learned:
        tests = ev.error_metrics(ev.holdout(panel, learned, request.train_ratio, freq, factors or None, settings=settings), ["series_id", "model"])
        out["test"] = ev.graded(tests)
    backtests = materialize(ev.backtest(panel, list(models.values()), request.backtest_overlap, freq, factors or None, settings=settings))
    out["backtest"] = backtests
    out["backtest_metrics"] = ev.graded(ev.error_metrics(backtests, ["series_id", "model"]))

    fitted = {name: fit_with(model, panel, factors or None, settings[name]) for name, model in models.items()}
    forecast = materialize(union_all([
        with_baseline(model, fitted[name], horizon, freq, factors or None).withColumn("model", F.lit(name)) for name, model in models.items()
    ]))
    out["forecast"] = forecast
    out["ranking"] = rank_models(out["cv"].select("series_id", "model", "mae", "rmse", "mape"))
    if tests is not None:
        out["ranking"] = ev.rank_from_test(tests, out["cv"])
    if factors:
        leaders = materialize(out["ranking"].filter(F.col("rank") == 1).select("series_id", "model"))
        parts = []
        for name in sorted(r[0] for r in leaders.select("model").distinct().collect()):
            rows = factor_contributions(models[name], fitted[name], horizon, freq, factors)
            parts.append(rows.join(leaders.filter(F.col("model") == name), "series_id", "left_semi"))
        out["contributions"] = union_all(parts)  # of each series by its best model
        out["lags"] = union_all([lag_analysis(panel, f).withColumn("kind", F.lit(k)) for k, f in factors.items()])

    chosen = [m for m in request.ensemble if m in models]
    summary_source = forecast
    if len(chosen) >= 2:
        metrics = out["cv"].filter(F.col("model").isin(chosen)).select("series_id", "model", "mae")
        weights = ev.inverse_error_weights(metrics) if request.ensemble_weights is None else given_weights(panel, request.ensemble_weights)
        members = forecast.filter(F.col("model").isin(chosen))
        combined = ev.combine_forecasts(members, weights)
        base = ev.combine_forecasts(members.withColumn("yhat", F.col("baseline")), weights).select("series_id", "ds", F.col("yhat").alias("baseline"))
        out["ensemble"] = combined.join(base, ["series_id", "ds"])
        out["ensemble_backtest"] = ev.combine_forecasts(backtests.filter(F.col("model").isin(chosen)), weights)
        summary_source = out["ensemble"]
    out["summary"] = forecast_summary(summary_source)
    return out


def given_weights(panel: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The same fixed weights for every series."""
    listed = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(w)).alias("weight")) for m, w in weights.items()]))
    return panel.select("series_id").distinct().select("series_id", listed.alias("w")).select("series_id", "w.*")


def train_and_save(
    panel: DataFrame, root: str, models: Sequence[str], request: ForecastRequest, name: str = "model", factors: Factors | None = None
) -> tuple[dict[str, str], DataFrame]:
    """Compare models on a held-out part, refit on all rows and store each series' best one.

    Every series takes the model with its smallest test MAE; one too short for a test takes
    the first model. A stored model holds the series that chose it. A pooled model still learns
    from the whole panel. Returns the stored model of each chosen name, and all metrics.
    """
    panel = materialize(panel.select("series_id", "ds", "y"))
    built = {m: build(m, request) for m in models}
    rows = ev.holdout(panel, list(built.values()), request.train_ratio, request.freq, factors)
    metrics = materialize(ev.error_metrics(rows, ["series_id", "model"]))
    ranked = Window.partitionBy("series_id").orderBy(F.col("mae").asc_nulls_last(), "model")
    tested = metrics.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") == 1).select("series_id", "model")
    spans = panel.groupBy("series_id").agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    by_name = {m.name: m for m in built.values()}
    chosen = materialize(spans.join(tested, "series_id", "left").fillna(next(iter(by_name)), ["model"]))
    stored: dict[str, str] = {}
    used = chosen.groupBy("model").agg(F.min("first").cast("string"), F.max("last").cast("string")).orderBy("model").collect()
    for best, first, last in used:
        own = chosen.filter(F.col("model") == best).select("series_id")
        model = by_name[best]
        learned = panel if getattr(model, "pooled", False) else panel.join(own, "series_id", "left_semi")
        fitted = model.fit(learned, factors).join(own, "series_id", "left_semi")
        stored[best] = save_model(fitted, root, best, name, metrics.filter(F.col("model") == best), train_range=(first, last))
    return stored, metrics
