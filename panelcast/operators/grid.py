"""Time grid, calendar, lag and rolling features of a panel.

A panel has one row per series and period, so a window over a series is bounded by
the calendar, whatever the number of source rows behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from ..functions.dates import future_date, period_label, week_end
from ..functions.scalars import col

LAGS = (1, 2, 3, 7, 14)  # fixed values: default lag columns
ROLLING = (7, 14, 28)  # fixed values: default rolling windows


def along(*keys: str) -> WindowSpec:
    """Rows of a series in date order."""
    return Window.partitionBy(*(keys or ("series_id",))).orderBy("ds")


def calendar_features(df: DataFrame, ds: str = "ds") -> DataFrame:
    d = F.col(ds)
    return df.withColumns(
        {
            "dayofweek": F.weekday(d),
            "dayofmonth": F.dayofmonth(d),
            "dayofyear": F.dayofyear(d),
            "weekofyear": F.weekofyear(d),
            "month": F.month(d),
            "quarter": F.quarter(d),
            "year": F.year(d),
            "is_weekend": (F.weekday(d) >= 5).cast("int"),
            "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
            "is_month_end": (d == F.last_day(d)).cast("int"),
        }
    )


def _periods_between(start: Column, end: Column, freq: str) -> Column:
    days = F.datediff(end, start)
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    count = {"D": days, "W": days / 7, "F": days / 14, "M": months, "Q": months / 3, "Y": months / 12}
    return count[freq].cast("int")


def resample_sum(panel: DataFrame, freq: str, value: str = "y") -> DataFrame:
    """Totals per period and series; periods without rows are 0.

    Each period emits itself and the empty periods up to the next one, so the grid
    needs no calendar join.
    """
    by_series = Window.partitionBy("series_id")
    origin = F.min("ds").over(by_series) if freq == "F" else None
    labelled = panel.withColumn("period", period_label("ds", freq, origin))
    totals = labelled.groupBy("series_id", F.col("period").alias("ds")).agg(F.sum(value).alias(value))
    gap = _periods_between(F.col("ds"), F.lead("ds").over(along()), freq)
    steps = totals.withColumn("empty", F.coalesce(gap - 1, F.lit(0))).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.col("empty")))
    )
    return steps.select(
        "series_id",
        F.when(F.col("step") == 0, F.col("ds")).otherwise(future_date("ds", "step", freq)).alias("ds"),
        F.when(F.col("step") == 0, F.col(value)).otherwise(0.0).alias(value),
    )


def downsample(panel: DataFrame, max_points: int = 5000) -> DataFrame:
    """Shorten long series; ``level`` tells how: none, weekly or tail.

    More than five times ``max_points`` over five years or more: weekly totals.
    Otherwise more than ``max_points``: the most recent ones.
    """
    by_series = Window.partitionBy("series_id")
    n = F.count(F.lit(1)).over(by_series)
    span = F.datediff(F.max("ds").over(by_series), F.min("ds").over(by_series))
    level = (
        F.when(n <= max_points, "none")
        .when((n > max_points * 5) & (span >= 365 * 5), "weekly")
        .otherwise("tail")
    )
    latest = by_series.orderBy(F.desc("ds"))
    rated = panel.select(
        "series_id", "ds", "y", level.alias("level"), F.row_number().over(latest).alias("age")
    )
    weekly = resample_sum(rated.filter(F.col("level") == "weekly"), "W").withColumn(
        "level", F.lit("weekly")
    )
    recent = rated.filter(
        (F.col("level") == "none") | ((F.col("level") == "tail") & (F.col("age") <= max_points))
    ).drop("age")
    return recent.unionByName(weekly)


def downsample_factor(factor: DataFrame, weekly: DataFrame) -> DataFrame:
    """Weekly totals of a factor table on the weeks of a downsampled panel, else 0."""
    numbers = [f.name for f in factor.schema.fields if isinstance(f.dataType, T.NumericType)]
    totals = factor.groupBy(week_end("ds").alias("ds")).agg(*[F.sum(c).alias(c) for c in numbers])
    weeks = weekly.filter(F.col("level") == "weekly").select("ds").distinct()
    return weeks.join(totals, "ds", "left").fillna(0, numbers)


def lag_features(panel: DataFrame, lags: Sequence[int] = LAGS, value: str = "y") -> DataFrame:
    return panel.withColumns({f"lag_{k}": F.lag(value, k).over(along()) for k in lags})


def rolling_features(
    panel: DataFrame, windows: Sequence[int] = ROLLING, value: str = "y"
) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of the rows before the current one."""
    out: dict[str, Column] = {}
    for size in windows:
        before = along().rowsBetween(-size, -1)
        out[f"rolling_mean_{size}"] = F.avg(value).over(before)
        deviation = F.coalesce(F.stddev_samp(value).over(before), F.lit(0.0))
        # a flat window has deviation 0; the running form can leave rounding noise
        flat = F.min(value).over(before) == F.max(value).over(before)
        out[f"rolling_std_{size}"] = F.when(flat, 0.0).otherwise(deviation)
        out[f"rolling_min_{size}"] = F.min(value).over(before)
        out[f"rolling_max_{size}"] = F.max(value).over(before)
    return panel.withColumns(out)


def difference(panel: DataFrame, value: str = "y", lag: int = 1) -> DataFrame:
    return panel.withColumn("dy", F.col(value) - F.lag(value, lag).over(along()))


def fill_along(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Forward, then backward fill along each series, then 0."""
    back = along().rowsBetween(Window.unboundedPreceding, 0)
    ahead = along().rowsBetween(0, Window.unboundedFollowing)
    return panel.withColumns(
        {
            c: F.coalesce(
                F.last(c, ignorenulls=True).over(back),
                F.first(c, ignorenulls=True).over(ahead),
                F.lit(0.0),
            )
            for c in columns
        }
    )


def future_grid(
    panel: DataFrame, horizon: int, freq: str = "D", keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """``horizon`` dates after the last one of each series, numbered by ``step``."""
    last = panel.groupBy(*keys).agg(F.max("ds").alias("last_ds"))
    return last.select(
        *keys, "last_ds", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ).withColumn("ds", future_date("last_ds", "step", freq))


def centred_average(window: int, value: str | Column = "y", keys: Sequence[str] = ()) -> Column:
    """Mean over the neighbours on both sides; null where a side is incomplete.

    The frame holds ``2 * (window // 2) + 1`` rows and the total is divided by ``window``.
    """
    half = window // 2
    frame = along(*keys).rowsBetween(-half, half)
    whole = F.count(F.lit(1)).over(frame) == 2 * half + 1
    return F.when(whole, F.sum(col(value)).over(frame) / window)


def position(keys: Sequence[str] = ()) -> Column:
    """0-based position of a row in its series."""
    return F.row_number().over(along(*keys)) - 1


def latest_rows(panel: DataFrame, n: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    return panel.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n)


def fit_scaler(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Mean and population deviation of each column per key."""
    stats = [F.avg(c).alias(f"{c}__mean") for c in columns]
    stats += [F.stddev_pop(c).alias(f"{c}__sd") for c in columns]
    return df.groupBy(*keys).agg(*stats)


def apply_scaler(
    df: DataFrame, scaler: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Standardise with a fitted scaler; a constant column becomes 0."""
    joined = df.join(scaler, list(keys))
    scaled = {}
    for c in columns:
        spread = F.when(F.col(f"{c}__sd") > 0, F.col(f"{c}__sd")).otherwise(1.0)
        scaled[c] = (F.col(c) - F.col(f"{c}__mean")) / spread
    return joined.withColumns(scaled).select(*df.columns)


MAX_CATEGORIES = 1000
OTHER = "(other)"


def category_values(df: DataFrame, columns: Sequence[str], most: int = MAX_CATEGORIES) -> dict[str, list[str | None]]:
    """The ``most`` most frequent values of each column, sorted, and one more where there are others.

    All columns are counted in one pass; what comes to the driver is bounded by ``most`` per column.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    counted = df.select(F.explode(cells).alias("cell")).groupBy("cell.name", "cell.v").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("name").orderBy(F.desc("copies"), F.asc_nulls_last("v"))
    found: dict[str, list[tuple[int, str | None]]] = {c: [] for c in columns}
    for row in counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most + 1).collect():
        found[row["name"]].append((row["place"], row["v"]))
    return {c: sorted((v for place, v in rows if place <= most), key=lambda v: (v is None, v)) + [OTHER] * (len(rows) > most) for c, rows in found.items()}


def one_hot(df: DataFrame, column: str | Sequence[str], prefix: str | None = None) -> DataFrame:
    """0/1 columns ``<column>_<value>`` of one or several columns; a column with one value adds nothing.

    Values become column names. Beyond the ``MAX_CATEGORIES`` most frequent ones, the others of a
    column share ``<column>_(other)``.
    """
    columns = [column] if isinstance(column, str) else list(column)
    added = {}
    for name, values in category_values(df, columns, MAX_CATEGORIES).items() if columns else ():
        text, start = F.col(f"`{name}`").cast("string"), prefix or name
        more = values[-1:] == [OTHER] and len(values) > MAX_CATEGORIES
        listed = values[:-1] if more else values
        if len(values) < 2:
            continue
        added |= {f"{start}_{v}": text.eqNullSafe(F.lit(v)).cast("double") for v in listed}
        if more:
            known = text.isin([v for v in listed if v is not None])
            rest = ~F.coalesce(known, F.lit(None in listed))
            added[f"{start}_{OTHER}"] = rest.cast("double")
    return df.withColumns(added) if added else df


def complete_rows(df: DataFrame, keep: Sequence[str] = ("series_id", "ds", "y")) -> DataFrame:
    """Numeric columns only, rows with all of them present."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    features = [n for n in numbers if n not in keep]
    return df.select(*[k for k in keep if k in df.columns], *features).dropna(subset=features)
