"""What-if scenarios and factor contributions on an already fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import uplift_pct
from ..models.base import Factors, Forecaster
from .enrich import FACTOR_SPECS, compare_scenarios
from .ranking import union_all

Adjustments = dict[str, dict[str, float]]


def adjust_factors(factors: Factors, adjustments: Adjustments) -> Factors:
    """Factor tables with changed numbers.

    Per kind: ``multiplier`` scales every number; ``<column>_multiplier``,
    ``<column>_add`` and ``<column>_set`` then act on one column, in that order.
    Unknown kinds are ignored.
    """
    out = dict(factors)
    for kind, rules in adjustments.items():
        if kind not in out:
            continue
        df = out[kind]
        changed = {}
        for f in df.schema.fields:
            if not isinstance(f.dataType, T.NumericType):
                continue
            value = F.col(f.name).cast("double")
            if "multiplier" in rules:
                value = value * float(rules["multiplier"])
            if f"{f.name}_multiplier" in rules:
                value = value * float(rules[f"{f.name}_multiplier"])
            if f"{f.name}_add" in rules:
                value = value + float(rules[f"{f.name}_add"])
            if f"{f.name}_set" in rules:
                value = F.lit(float(rules[f"{f.name}_set"]))
            changed[f.name] = value
        out[kind] = df.withColumns(changed)
    return out


def what_if(model: Forecaster, fitted: DataFrame, horizon: int, freq: str, factors: Factors,
            adjustments: Adjustments) -> DataFrame:
    """Original and adjusted forecast of the same fitted model, side by side."""
    original = model.forecast(fitted, horizon, freq, factors)
    scenario = model.forecast(fitted, horizon, freq, adjust_factors(factors, adjustments))
    return compare_scenarios(original, scenario)


def scenario_totals(comparison: DataFrame) -> DataFrame:
    totals = comparison.groupBy("series_id").agg(
        F.sum("original").alias("original"), F.sum("scenario").alias("scenario")
    )
    return totals.withColumns(
        {"difference": F.col("scenario") - F.col("original"), "change_pct": uplift_pct("scenario", "original")}
    )


def factor_contributions(model: Forecaster, fitted: DataFrame, horizon: int, freq: str, factors: Factors) -> DataFrame:
    """Forecast with one factor kind alone minus the baseline, per series and kind."""
    base = model.forecast(fitted, horizon, freq, None).select("series_id", "step", F.col("yhat").alias("baseline"))
    parts = [
        model.forecast(fitted, horizon, freq, {kind: df}).select("series_id", F.lit(kind).alias("factor"), "step", "yhat")
        for kind, df in factors.items() if kind in FACTOR_SPECS
    ]
    joined = union_all(parts).join(base, ["series_id", "step"])
    total = F.sum(F.col("yhat") - F.col("baseline"))
    return joined.groupBy("series_id", "factor").agg(
        total.alias("total"), (total / horizon).alias("average"),
        F.when(total > 0, "positive").otherwise("negative").alias("direction"),
    )


def sorted_contributions(contributions: DataFrame) -> DataFrame:
    """Factors by size per series, with the sum over all of them."""
    by_series = Window.partitionBy("series_id")
    return contributions.withColumns({
        "rank": F.row_number().over(by_series.orderBy(F.desc(F.abs("total")), "factor")),
        "all_factors": F.sum("total").over(by_series),
    })
