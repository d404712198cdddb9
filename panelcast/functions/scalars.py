"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_SEPARATOR = " ||| "  # fixed value: joins the parts of a composite series key


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clamp(value: Column | str, low: float, high: float) -> Column:
    """Limit to [low, high]; a null stays null."""
    value = col(value)
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def safe_float(value: Column | str, default: float = 0.0) -> Column:
    """Null, NaN and the infinities become ``default``."""
    value = col(value).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, value).otherwise(F.lit(default))


def to_number(value: Column | str) -> Column:
    """Text to double; what does not parse, or parses to NaN, is null."""
    number = col(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def ratio(numerator: Column | str, denominator: Column | str, fallback: float | None = None) -> Column:
    """Division that gives null, or ``fallback``, where it is undefined."""
    value = F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))
    return value if fallback is None else F.coalesce(value, F.lit(fallback))


def pct_change(current: Column | str, previous: Column | str) -> Column:
    return ratio(col(current) - col(previous), previous)


def uplift_pct(forecast: Column | str, baseline: Column | str) -> Column:
    gain = ratio(col(forecast) - col(baseline), F.abs(col(baseline)))
    return F.coalesce(gain * 100, F.lit(0.0))


def impact_pct(impact: Column | str) -> Column:
    return F.round((col(impact) - 1) * 100, 1)


def accuracy_pct(mape: Column | str) -> Column:
    return clamp(100 - col(mape), 0.0, 100.0)


def accuracy_grade(accuracy: Column | str) -> Column:
    accuracy = col(accuracy)
    return (
        F.when(accuracy >= 90, "Excellent")
        .when(accuracy >= 80, "Good")
        .when(accuracy >= 70, "Fair")
        .when(accuracy >= 60, "Marginal")
        .when(accuracy.isNotNull(), "Poor")
    )


def strength_label(correlation: Column | str) -> Column:
    size = F.abs(col(correlation))
    return (
        F.when(size > 0.5, "strong").when(size > 0.3, "moderate").when(size.isNotNull(), "weak")
    )


def rank_weight(position: Column | str, count: Column | str) -> Column:
    """Linear weight of ``position`` in 1..count; the weights sum to one."""
    count = col(count)
    return 2.0 * col(position) / (count * (count + 1))


def composite_key(*columns: str) -> Column:
    return F.concat_ws(KEY_SEPARATOR, *[F.col(c).cast("string") for c in columns])


def split_key(key: Column | str, names: list[str]) -> list[Column]:
    parts = F.split(col(key), r" \|\|\| ")
    return [parts.getItem(i).alias(name) for i, name in enumerate(names)]


def date_text(value: Column | str) -> Column:
    return F.date_format(col(value), "yyyy-MM-dd")


def residual(actual: Column | str, forecast: Column | str) -> Column:
    return col(actual) - col(forecast)


def correlation(y: Column | str, x: Column | str) -> Column:
    """Aggregate: Pearson correlation of the complete pairs; null where a side is constant."""
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), F.when(spread > 0, spread))
