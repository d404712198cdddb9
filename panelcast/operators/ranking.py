"""Sorting, paging, top-k, rankings and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import accuracy_grade, accuracy_pct


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """One page of a sorted table; Spark keeps offset+limit rows per task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """Best ``k`` rows per key. The rank filter is applied on the map side too."""
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rank_models(metrics: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Models by MAE; those without one come last, by name."""
    best = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("mae"), "model")
    accuracy = accuracy_pct("mape")
    return metrics.withColumns(
        {
            "rank": F.row_number().over(best),
            "score": 1 / (F.col("mae") + 1),
            "accuracy": accuracy,
            "grade": accuracy_grade(accuracy),
        }
    )


def search(df: DataFrame, model_type: str | None, text: str | None, offset: int, limit: int) -> DataFrame:
    """Saved models of a type whose name, notes or tags hold ``text``; newest first."""
    if model_type:
        df = df.filter(F.col("model_type") == model_type)
    if text:
        needle = text.lower()
        in_tags = F.exists("tags", lambda tag: F.lower(tag).contains(needle))
        df = df.filter(
            F.lower("name").contains(needle) | F.lower("notes").contains(needle) | in_tags
        )
    return page(df, [F.desc("created_at"), "model_id"], offset, limit)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out, *rest = parts
    for part in rest:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def union_distinct(parts: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    return union_all(parts).dropDuplicates(list(on))


def union_by_priority(
    parts: Sequence[DataFrame], keys: Sequence[str], ties: Sequence[str] = ()
) -> DataFrame:
    """Union in which the earliest part wins for each key.

    An aggregate rather than a window: each task keeps one row per key.
    """
    tagged = union_all([p.withColumn("source", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in tagged.columns if c not in (*keys, "source")]
    order = F.struct("source", *ties, *[c for c in rest if c not in ties])
    first = tagged.groupBy(*keys).agg(F.min(order).alias("first"))
    return first.select(*keys, *[F.col(f"first.{c}").alias(c) for c in ("source", *rest)])


def union_flags(parts: dict[str, DataFrame]) -> DataFrame:
    """One 0/1-count column ``<kind>_flag`` per table, summed by date."""
    flags = union_all([df.select("ds", F.lit(1).alias(f"{kind}_flag")) for kind, df in parts.items()])
    return flags.groupBy("ds").agg(
        *[F.coalesce(F.sum(f"{k}_flag"), F.lit(0)).alias(f"{k}_flag") for k in parts]
    )
