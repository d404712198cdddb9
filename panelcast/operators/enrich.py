"""Joins of a panel with factor, event and plan tables.

Factor tables hold one or a few rows per day. They are first brought to one wide row
per day, so the panel is joined once and not once per kind. The joins carry no hint:
adaptive execution broadcasts the daily side when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import uplift_pct
from .grid import one_hot
from .ranking import union_all, union_flags

# Columns and aggregate of each factor kind.
FACTOR_SPECS: dict[str, tuple[list[str] | None, str]] = {
    "promotions": (["discount"], "sum"),
    "media_plan": (["media_spend", "reach", "impressions"], "sum"),
    "holidays": (["holiday_impact"], "max"),
    "events": (["event_impact"], "max"),
    "weather": (["temperature", "humidity", "rainfall", "snowfall"], "avg"),
    "competitor": (["competitor_price", "market_share", "promotion_flag"], "avg"),
    "economic": (None, "avg"),
}
FLAG_KINDS = ("promotions", "media_plan", "holidays", "events")


def within_range(factor: DataFrame, panel: DataFrame) -> DataFrame:
    """Rows of a factor table between the first and last date of the panel."""
    first = panel.agg(F.min("ds")).scalar()
    last = panel.agg(F.max("ds")).scalar()
    return factor.filter(F.col("ds").between(first, last))


def join_factor(panel: DataFrame, factor: DataFrame) -> DataFrame:
    """Panel rows on the dates of a factor table."""
    return panel.join(factor, "ds")


def daily_regressors(factors: dict[str, DataFrame]) -> DataFrame:
    """One row per day: largest discount, total spend, largest holiday and event impact.

    Impacts are centred, so that 0 means no effect.
    """
    specs = {
        "promotions": ("discount", "promo_discount", F.max, 0.0),
        "media_plan": ("media_spend", "media_spend", F.sum, 0.0),
        "holidays": ("holiday_impact", "holiday_impact", F.max, 1.0),
        "events": ("event_impact", "event_impact", F.max, 1.0),
    }
    parts, totals = [], []
    for kind, (source, name, how, neutral) in specs.items():
        if kind not in factors:
            continue
        value = F.coalesce(F.col(source), F.lit(neutral)) - neutral
        parts.append(factors[kind].select("ds", value.alias(name)))
        totals.append(F.coalesce(how(name), F.lit(0.0)).alias(name))
    return union_all(parts).groupBy("ds").agg(*totals)


def align_regressors(panel: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    daily = daily_regressors(factors)
    return panel.join(daily, "ds", "left").fillna(0.0, [c for c in daily.columns if c != "ds"])


def wide_factors(factors: dict[str, DataFrame]) -> DataFrame:
    """One row per day with every factor column, named ``<kind>_<column>``.

    Text columns become 0/1 columns first.
    """
    parts = []
    for kind, df in factors.items():
        wanted, how = FACTOR_SPECS[kind]
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        df = one_hot(df, text)
        numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        dummies = [n for n in numbers if any(n.startswith(f"{t}_") for t in text)]
        used = [n for n in numbers if wanted is None or n in wanted or n in dummies]
        parts.append(
            df.groupBy("ds").agg(*[getattr(F, how)(n).cast("double").alias(f"{kind}_{n}") for n in used])
        )
    wide = union_all(parts)
    names = [n for n in wide.columns if n != "ds"]
    # every column comes from one part only, so the maximum is its value
    return wide.groupBy("ds").agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])


def attach_factors(panel: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    wide = wide_factors(factors)
    return panel.join(wide, "ds", "left").fillna(0.0, [c for c in wide.columns if c != "ds"])


def daily_flags(factors: dict[str, DataFrame]) -> DataFrame:
    """0/1 per day and kind: whether the kind has a row on that day."""
    counts = union_flags({k: factors[k] for k in FLAG_KINDS if k in factors})
    return counts.select("ds", *[(F.col(c) > 0).cast("double").alias(c) for c in counts.columns if c != "ds"])


def attach_flags(panel: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    flags = daily_flags(factors)
    return panel.join(flags, "ds", "left").fillna(0.0, [c for c in flags.columns if c != "ds"])


def attach_flags_asof(panel: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """Flags of the latest earlier day that has any (0 before the first one).

    The flag table has one row per calendar day at most. Each of its rows is spread
    over the days until the next one, which turns the as-of join into an equi-join.
    """
    counts = union_flags({k: factors[k] for k in FLAG_KINDS if k in factors})
    names = [c for c in counts.columns if c != "ds"]
    last_day = panel.agg(F.max("ds")).scalar()
    calendar = Window.partitionBy(F.lit(0)).orderBy("ds")
    until = F.greatest(F.col("ds"), F.coalesce(F.date_sub(F.lead("ds").over(calendar), 1), last_day))
    spread = counts.withColumn("until", until).select(
        F.explode(F.sequence("ds", "until")).alias("ds"), *names
    )
    return panel.join(spread, "ds", "left").fillna(0, names)


def attach_events(sales: DataFrame, daily_events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Event of each sales row by date and shared keys; of several the lowest id."""
    shared = ["ds", *[k for k in keys if k in daily_events.columns]]
    one = daily_events.groupBy(*shared).agg(
        F.min("event_id").alias("event_id"), F.min_by("event_name", F.struct("event_id", "event_name")).alias("event_name")
    )
    return sales.join(one, shared, "left")


def first_match(plan: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First plan row per key and date."""
    rest = [c for c in plan.columns if c not in keys]
    first = plan.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])


def lookup(targets: DataFrame, plan: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return targets.join(first_match(plan, keys, order), list(keys), "left")


def window_means(events: DataFrame, panel: DataFrame, before: int = 21, event_before: int = 0,
                 event_after: int = 1) -> DataFrame:
    """Sales around each event and series: mean and row count of baseline and event window.

    Every event is spread over the days of its windows, so the range join becomes an
    equi-join on the day and no pair outside a window is ever formed.
    """
    offsets = F.sequence(F.lit(-before), F.lit(event_after))
    spread = events.select("event_ds", "name", F.explode(offsets).alias("offset")).withColumn(
        "ds", F.date_add("event_ds", F.col("offset"))
    )
    in_baseline = F.col("offset") < -event_before
    joined = spread.join(panel.filter(F.col("y").isNotNull()), "ds")
    return joined.groupBy("series_id", "event_ds", "name").agg(
        F.avg(F.when(in_baseline, F.col("y"))).alias("baseline"),
        F.count(F.when(in_baseline, F.col("y"))).alias("baseline_rows"),
        F.avg(F.when(~in_baseline, F.col("y"))).alias("during"),
        F.count(F.when(~in_baseline, F.col("y"))).alias("event_rows"),
    )


def chart_rows(actual: DataFrame, forecast: DataFrame, baseline: DataFrame | None = None,
               backtest: DataFrame | None = None) -> DataFrame:
    """Actual, forecast, baseline and backtest side by side, one row per series and date.

    Forecast rows up to the last actual date are left out; a backtest value wins over
    a forecast. A union and one group-by replace a chain of outer joins.
    """
    ends = actual.groupBy("series_id").agg(F.max("ds").alias("last_actual"))
    later = forecast.join(ends, "series_id", "left").filter(
        F.col("last_actual").isNull() | (F.col("ds") > F.col("last_actual"))
    )
    band = ["yhat", "lower_ci", "upper_ci"]
    parts = [
        actual.select("series_id", "ds", F.col("y").alias("actual")),
        later.select("series_id", "ds", F.struct(*band).alias("f")),
    ]
    if baseline is not None:
        parts.append(baseline.select("series_id", "ds", F.col("yhat").alias("baseline")))
    if backtest is not None:
        parts.append(backtest.select("series_id", "ds", F.struct(*band).alias("b")))
    merged = union_all(parts)
    for name, kind in (("baseline", "double"), ("b", merged.schema["f"].dataType)):
        if name not in merged.columns:
            merged = merged.withColumn(name, F.lit(None).cast(kind))
    out = merged.groupBy("series_id", "ds").agg(
        F.sum("actual").alias("actual"), F.max("baseline").alias("baseline"),
        F.coalesce(F.max("b"), F.max("f")).alias("f"),
    )
    return out.select("series_id", "ds", "actual", *[F.col(f"f.{c}").alias(c) for c in band], "baseline")


def compare_scenarios(original: DataFrame, scenario: DataFrame) -> DataFrame:
    """Original and scenario forecast per series and date, with the difference."""
    a = original.select("series_id", "ds", F.col("yhat").alias("original"))
    b = scenario.select("series_id", "ds", F.col("yhat").alias("scenario"))
    joined = a.join(b, ["series_id", "ds"], "full_outer")
    return joined.withColumns(
        {"difference": F.col("scenario") - F.col("original"), "change_pct": uplift_pct("scenario", "original")}
    )


def with_candidates(panel: DataFrame, grid: Sequence[dict], name: str = "params") -> DataFrame:
    """Each row once per parameter set of a fixed grid, as a generator and not a join."""
    fields = sorted({k for params in grid for k in params})
    sets = F.array(*[
        F.struct(F.lit(i).alias("candidate"), *[F.lit(params.get(k)).alias(k) for k in fields])
        for i, params in enumerate(grid)
    ])
    return panel.withColumn(name, F.explode(sets))


def with_hierarchy(sales: DataFrame, hierarchy: DataFrame, key: str) -> DataFrame:
    """Dimension columns of each row; rows without a dimension entry stay."""
    return sales.join(hierarchy, key, "left")
