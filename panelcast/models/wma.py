"""Weighted moving average with weekday factors and factor multipliers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import clamp, ratio
from ..operators.ranking import union_all
from .base import Factors, banded, configured, steps

# The column that acts as multiplier; other kinds use their first number.
MULTIPLIER_COLUMN = {
    "promotions": "discount",
    "events": "event_impact",
    "holidays": "holiday_impact",
    "media_plan": "media_spend",
}


def multipliers(factors: Factors, use_media: bool = False) -> DataFrame | None:
    """Product of all factor multipliers per date.

    Media spend is an amount, not a multiplier, so it takes part only on request.
    """
    parts = []
    for kind, df in factors.items():
        if kind == "media_plan" and not use_media:
            continue
        numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        name = MULTIPLIER_COLUMN.get(kind)
        name = name if name in df.columns else next(iter(numbers), None)
        if name is None:
            continue
        value = F.col(name).cast("double")
        if kind == "promotions":
            value = 1 + clamp(value, 0.0, 100.0) / 100
        parts.append(df.filter(value.isNotNull()).select("ds", value.alias("multiplier")))
    if not parts:
        return None
    return union_all(parts).groupBy("ds").agg(F.product("multiplier").alias("multiplier"))


@dataclass(frozen=True)
class WMA:
    window: int = 8
    use_media: bool = False
    name: str = "wma"
    tunable = ("window",)

    def fit(self, panel: DataFrame, factors: Factors | None = None, settings: DataFrame | None = None) -> DataFrame:
        panel = configured(panel, settings, {"window": ("int", int(self.window))})
        window = F.greatest(F.lit(2), F.col("own_window"))
        newest = Window.partitionBy("series_id").orderBy(F.desc("ds"))
        aged = panel.withColumn("age", F.row_number().over(newest)).withColumn("dow", F.weekday("ds"))
        size = F.least(F.count(F.lit(1)), F.max(window))
        # ranks run 1..size towards the newest row: size + 1 - age
        in_tail = F.col("age") <= window
        weighted = F.sum(F.when(in_tail, F.col("y"))) * (size + 1) - F.sum(
            F.when(in_tail, F.col("y") * F.col("age"))
        )
        mean = F.avg("y")
        long_enough = F.count(F.lit(1)) >= 14
        factor = [
            F.when(long_enough, ratio(F.avg(F.when(F.col("dow") == d, F.col("y"))), mean, 1.0)).otherwise(1.0)
            for d in range(7)
        ]
        return aged.groupBy("series_id").agg(
            F.max("ds").alias("last_ds"),
            F.count(F.lit(1)).alias("n"),
            mean.alias("mean"),
            (weighted * 2 / (size * (size + 1))).alias("wma"),
            F.array(*factor).alias("factors"),
        )

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame:
        grid = steps(fitted, horizon, freq)
        value = F.col("wma") * F.get("factors", F.weekday("ds"))
        table = multipliers(factors, self.use_media) if factors else None
        if table is not None:
            grid = grid.join(table, "ds", "left")
            value = value * F.coalesce("multiplier", F.lit(1.0))
        return banded(grid, value, None, 0.15, non_negative=True)

    def components(self, fitted: DataFrame) -> DataFrame:
        return fitted.select("series_id", "wma", "mean", F.posexplode("factors").alias("dow", "factor"))


@dataclass(frozen=True)
class Naive:
    """Repeats the last value; the band is a share of it."""

    share: float = 0.2
    name: str = "naive"

    def fit(self, panel: DataFrame, factors: Factors | None = None) -> DataFrame:
        return panel.groupBy("series_id").agg(
            F.max("ds").alias("last_ds"), F.max_by("y", "ds").alias("last_y")
        )

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame:
        return banded(steps(fitted, horizon, freq), F.col("last_y"), None, self.share)
