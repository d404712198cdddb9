"""Checks of raw tables: missing values, dates, value column, column classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import FREQUENCY_RANK
from ..functions.scalars import ratio
from .normalize import find_date_column, find_value_column, normalize_name, parse_date
from .rollup import null_profile

LARGE_TABLE = 10_000_000  # fixed value: rows from which a table is called very large
SHORT_SERIES = 14  # fixed value: fewer dates make a forecast unreliable

# Name parts that mark a text column as identifier or as place.
ID_WORDS = [
    "id", "sku", "upc", "code", "key", "product", "item", "article",
    "part", "catalog", "identifier", "account", "order", "invoice",
]
REGION_WORDS = [
    "region", "state", "city", "country", "store", "location", "area",
    "zone", "branch", "warehouse", "site", "territory", "district",
    "province", "county", "office", "department", "division",
]


def upload_checks(df: DataFrame) -> DataFrame:
    """One row per column with its null share and verdict, plus one for the table.

    All counts come from a single pass.
    """
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)],
    )
    repeated = {n for n in names if sum(m.lower() == n.lower() for m in names) > 1}
    columns = F.array(
        *[F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("filled"),
                   F.lit(n in repeated).alias("repeated")) for i, n in enumerate(names)],
        F.struct(F.lit("(table)").alias("column_name"), F.col("rows").alias("filled"),
                 F.lit(False).alias("repeated")),
    )
    rows = counted.select("rows", F.explode(columns).alias("c")).select("rows", "c.*")
    null_share = 1 - ratio("filled", "rows", 0.0)
    whole = F.col("column_name") == "(table)"
    severity = (
        F.when(whole & (F.col("rows") == 0), "error")
        .when(whole & (F.col("rows") > LARGE_TABLE), "warning")
        .when(whole, "ok")
        .when(F.col("repeated") | (F.col("filled") == 0), "error")
        .when(null_share > 0.5, "warning")
        .otherwise("ok")
    )
    return rows.select("column_name", "rows", null_share.alias("null_share"), severity.alias("severity"))


def sales_checks(df: DataFrame) -> DataFrame:
    """One row: what was recognised, how many rows, dates and missing values there are."""
    date_name = find_date_column(df.schema)
    value_name = find_value_column(df.schema, skip=[date_name] if date_name else [])
    ds = parse_date(df, date_name) if date_name else F.lit(None).cast("date")
    value = F.col(f"`{value_name}`") if value_name else F.lit(None).cast("double")
    by_date = df.groupBy(ds.alias("ds")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(value.isNull()).alias("missing")
    )
    total = by_date.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
        F.count("ds").alias("unique_dates"),
    )
    return total.select(
        F.lit(date_name).cast("string").alias("date_column"),
        F.lit(value_name).cast("string").alias("value_column"),
        "row_count", "unique_dates", "missing",
        ((F.col("row_count") > 0) & F.lit(bool(date_name)) & F.lit(bool(value_name))).alias("valid"),
        (F.col("unique_dates") < SHORT_SERIES).alias("is_short"),
    )


def column_classes(df: DataFrame) -> DataFrame:
    """Semantic class per column. Only unclassified text columns are counted, all in one pass.

    Distinct values come from a group-by, not from a set held in one task.
    """
    date_name = find_date_column(df.schema)
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    known: dict[str, str | None] = {}
    for f in df.schema.fields:
        name = normalize_name(f.name)
        known[f.name] = None
        if f.name == date_name or isinstance(f.dataType, temporal):
            known[f.name] = "date"
        elif isinstance(f.dataType, T.BooleanType):
            known[f.name] = "boolean"
        elif isinstance(f.dataType, T.NumericType):
            known[f.name] = "numeric"
        elif any(word in name for word in ID_WORDS):
            known[f.name] = "id"
        elif any(word in name for word in REGION_WORDS):
            known[f.name] = "region"
    columns = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(c).cast("string").alias("class")) for n, c in known.items()])
    named = df.sparkSession.range(1).select(F.explode(columns).alias("c")).select("c.*")
    open_columns = [n for n, c in known.items() if c is None]
    if not open_columns:
        return named
    few = F.col("distinct_values") < F.greatest(F.lit(2), F.col("rows") * 0.2)
    counted = null_profile(df, open_columns).select("column_name", F.when(few, "categorical").otherwise("text").alias("found"))
    joined = named.join(F.broadcast(counted), "column_name", "left")  # a row per column
    return joined.select("column_name", F.coalesce("class", "found", F.lit("categorical")).alias("class"))


def frequency_mismatch(frequencies: DataFrame, requested: str) -> DataFrame:
    """Series whose data is coarser than the requested frequency."""
    rank = F.create_map(*[F.lit(x) for pair in FREQUENCY_RANK.items() for x in pair])
    return frequencies.filter(F.get(F.array(rank[F.col("frequency")]), F.lit(0)) > FREQUENCY_RANK[requested])
