"""Aggregations over dates, categories and hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.dates import period_label
from ..functions.scalars import composite_key, ratio, rank_weight
from ..sources.tables import cents
from ..store import materialize

ALL = "(all)"
AGGREGATES = {"sum": F.sum, "mean": F.avg}


def daily_totals(df: DataFrame, keys: Sequence[str] = (), value: str = "y") -> DataFrame:
    return df.groupBy(*keys, "ds").agg(cents(F.sum(value)).alias(value))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def daily_numeric_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("ds").agg(*[cents(F.sum(c)).alias(c) for c in numeric_columns(df)])


def category_series(df: DataFrame, columns: Sequence[str], min_rows: int = 20) -> DataFrame:
    """One series per combination of ``columns`` plus the total of all, in one pass.

    Combinations with fewer than ``min_rows`` dates are left out.
    """
    sets = [[*columns, "ds"], ["ds"]]
    totals = df.groupingSets(sets, *columns, "ds").agg(
        cents(F.sum("y")).alias("y"), F.grouping_id().alias("level")
    )
    keyed = totals.select(
        F.when(F.col("level") == 0, composite_key(*columns)).otherwise(ALL).alias("series_id"),
        *[F.when(F.col("level") == 0, F.col(c).cast("string")).alias(c) for c in columns],
        "ds",
        "y",
    )
    length = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    return keyed.withColumn("rows", length).filter(F.col("rows") >= min_rows).drop("rows")


def time_rollup(panel: DataFrame, freq: str, how: str = "sum") -> DataFrame:
    """Coarser periods of each series by sum, mean or median.

    The panel has one row per series and day, so the median of a period is small.
    """
    aggregate = {**AGGREGATES, "median": F.median}[how]
    by_series = Window.partitionBy("series_id")
    origin = F.min("ds").over(by_series) if freq == "F" else None
    period = panel.select("series_id", period_label("ds", freq, origin).alias("ds"), "y")
    return period.groupBy("series_id", "ds").agg(aggregate("y").alias("y"))


def hierarchy_rollup(
    df: DataFrame, levels: Sequence[str], period: Column, values: Sequence[str] = ("y",)
) -> DataFrame:
    """Totals at every level of a hierarchy, coarsest first in ``levels``.

    ``depth`` is the number of levels in force (0: everything).
    """
    narrow = df.withColumn("period", period)
    sets = [[*levels[:k], "period"] for k in range(len(levels) + 1)]
    out = narrow.groupingSets(sets, *levels, "period").agg(
        *[cents(F.sum(v)).alias(v) for v in values],
        *[F.grouping(c).alias(f"__{c}") for c in levels],
    )
    depth = sum((1 - F.col(f"__{c}").cast("int") for c in levels), F.lit(0))
    return out.withColumn("depth", depth).drop(*[f"__{c}" for c in levels])


# Rank slack of the bracket around a percentile. The sketch below is off by at most
# 1/ACCURACY of the rows, so a bracket of +-SLACK is sure to hold the exact value.
ACCURACY = 10_000
SLACK = 0.001
HOT = 1000


def exact_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median per key that never gathers all values of a key in one task.

    A mergeable sketch brackets the median; everything below and above the bracket
    is counted on the map side, and only the values inside are put in order. Rows meet the brackets
    of keys with more than one in ``HOT`` of all rows, fewer than ``HOT`` of them, by a broadcast; no other
    key is large enough to burden a task of a shuffled join.
    """
    if not keys:
        return exact_median(df.withColumn("__all", F.lit(0)), ["__all"], value).drop("__all")
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    bracket = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", [0.5 - SLACK, 0.5 + SLACK], ACCURACY).alias("edge"),
    )
    renamed = materialize(bracket.select(*[F.col(k).alias(f"__{k}") for k in keys], "n", "edge"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    total = renamed.agg(F.sum("n")).first()[0] or 0
    hot, rest = (renamed.filter(c) for c in (F.col("n") * HOT > total, F.col("n") * HOT <= total))
    large = F.broadcast(hot)
    bracketed = known.join(large, on).unionByName(known.join(large, on, "left_anti").join(rest, on))
    low, high = F.col("edge")[0], F.col("edge")[1]
    side = F.when(F.col("v") < low, -1).when(F.col("v") > high, 1).otherwise(0)
    counts = (
        bracketed
        .withColumn("side", side)
        .groupBy(*keys, "n", "side", F.when(F.col("side") == 0, F.col("v")).alias("v"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    order = Window.partitionBy(*keys).orderBy("side", "v")
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("last", upto).withColumn("first", F.col("last") - F.col("copies") + 1)
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (F.col("last") >= rank), F.col("v")))

    return placed.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias("median"))


def rollup_values(df: DataFrame, keys: Sequence[str], value: str, how: str) -> DataFrame:
    """Sum, mean or median of raw rows per key."""
    if how == "median":
        return exact_median(df, keys, value).withColumnRenamed("median", value)
    return df.groupBy(*keys).agg(AGGREGATES[how](value).alias(value))


def weekday_factors(panel: DataFrame, min_rows: int = 14) -> DataFrame:
    """Mean of each weekday over the mean of the series; 1 for short series."""
    sums = panel.groupBy("series_id", F.weekday("ds").alias("dow")).agg(
        F.sum("y").alias("total"), F.count(F.lit(1)).alias("n")
    )
    whole = Window.partitionBy("series_id")
    overall = F.sum("total").over(whole) / F.sum("n").over(whole)
    factor = F.when(F.sum("n").over(whole) < min_rows, 1.0).otherwise(
        ratio(F.col("total") / F.col("n"), overall, 1.0)
    )
    return sums.select("series_id", "dow", factor.alias("factor"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row, null and distinct counts per column as rows; none for an empty table.

    Every row is spread over its columns and equal values are counted before the shuffle,
    so one scan and one shuffle serve all columns.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    counted = df.select(F.explode(cells).alias("cell")).groupBy("cell.column_name", "cell.v").agg(F.count(F.lit(1)).alias("copies"))
    out = counted.groupBy("column_name").agg(
        F.sum("copies").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("copies"))), F.lit(0)).alias("nulls"),
        F.count("v").alias("distinct_values"),
    )
    return out.withColumn("null_share", ratio("nulls", "rows", 0.0))


# The total reported for each factor kind (the others report rows only).
FACTOR_TOTALS = {"media_plan": "media_spend", "promotions": "discount", "holidays": "holiday_impact"}


def factor_totals(factors: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            (
                F.round(F.sum(FACTOR_TOTALS[kind]), 2) if kind in FACTOR_TOTALS
                else F.lit(None).cast("double")
            ).alias("total"),
        ).select(F.lit(kind).alias("factor"), "rows", "total")
        for kind, df in factors.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def histogram(panel: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins per series, empty ones included."""
    whole = Window.partitionBy("series_id")
    ranged = panel.select("series_id", "y", F.min("y").over(whole).alias("low"), F.max("y").over(whole).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    flat = F.col("high") == F.col("low")
    index = F.when(flat, 0).otherwise(F.least(F.floor((F.col("y") - F.col("low")) / width), F.lit(bins - 1))).cast("int")
    counts = ranged.groupBy("series_id", "low", "high", index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    by_series = counts.groupBy("series_id", "low", "high").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("counts")
    )
    last_bin = F.when(flat, 0).otherwise(bins - 1)
    frame = by_series.select("series_id", "low", "high", "counts", F.explode(F.sequence(F.lit(0), last_bin)).alias("bin"))
    middle = F.when(flat, F.col("low")).otherwise(F.col("low") + width * (F.col("bin") + 0.5))
    return frame.select(
        "series_id", "bin", middle.alias("midpoint"), F.coalesce(F.try_element_at("counts", "bin"), F.lit(0)).alias("count")
    )


def forecast_summary(forecast: DataFrame, keys: Sequence[str] = ("series_id", "model")) -> DataFrame:
    """Totals of forecast, baseline and uplift; without a baseline the uplift is 0."""
    total, base = F.sum("yhat"), F.sum(F.coalesce("baseline", "yhat"))
    return forecast.groupBy(*keys).agg(
        total.alias("total_forecast"),
        base.alias("total_baseline"),
        (total - base).alias("total_uplift"),
        F.coalesce(ratio(total - base, F.abs(base)) * 100, F.lit(0.0)).alias("uplift_pct"),
        (total / F.count(F.lit(1))).alias("avg_per_step"),
        F.count(F.lit(1)).alias("horizon"),
    )


def bottom_up(forecast: DataFrame, parent: str) -> DataFrame:
    """Forecast of each parent as the total of its children, beside its own one."""
    is_child = F.col("series_id") != F.col(parent)
    return forecast.groupBy(F.col(parent).alias("parent"), "ds").agg(
        F.sum(F.when(is_child, F.col("yhat"))).alias("bottom_up"),
        F.max(F.when(~is_child, F.col("yhat"))).alias("direct"),
    )


def weighted_average(keys: Sequence[str] = ("series_id",), value: str = "y", order: str = "ds") -> Column:
    """Linearly weighted mean over rows that carry ``rank`` 1..n and ``n``."""
    return F.sum(F.col(value) * rank_weight("rank", "n"))


def recent_averages(panel: DataFrame, n: int) -> DataFrame:
    """Linearly weighted mean and median of the last ``n`` values of each series."""
    newest = Window.partitionBy("series_id").orderBy(F.desc("ds"))
    tail = panel.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n)
    size = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    ranked = tail.withColumn("n", size).withColumn("rank", F.col("n") - F.col("age") + 1)
    return ranked.groupBy("series_id").agg(
        weighted_average().alias("wma"), F.median("y").alias("median")
    )


def decayed_averages(panel: DataFrame, n: int, decay: float, trim: float) -> DataFrame:
    """Exponentially weighted mean, and mean between the trim percentiles, of the last n."""
    newest = Window.partitionBy("series_id").orderBy(F.desc("ds"))
    tail = panel.withColumn("age", F.row_number().over(newest) - 1).filter(F.col("age") < n)
    whole = Window.partitionBy("series_id")
    cut = F.percentile("y", [trim, 1 - trim]).over(whole)
    weight = F.pow(F.lit(decay), F.col("age"))
    inside = (F.col("y") >= F.col("cut")[0]) & (F.col("y") <= F.col("cut")[1])
    return tail.withColumn("cut", cut).groupBy("series_id").agg(
        (F.sum(F.col("y") * weight) / F.sum(weight)).alias("decayed"),
        F.avg(F.when(inside, F.col("y"))).alias("trimmed"),
    )
