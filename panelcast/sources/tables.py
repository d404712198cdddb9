"""Parquet scans and the panels derived from the sales tables.

Every panel joins the fact table to a dimension and sums by (attribute, day). A dimension
whose estimated size is below ``spark.sql.autoBroadcastJoinThreshold`` is broadcast, so
the fact rows are joined and summed on the map side and a hot key costs nothing. A larger
dimension is shuffled; then the facts are first summed by (foreign key, day), which cuts
a hot key to one row per day before the join gathers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def cents(column: Column) -> Column:
    """A currency total to the cent, so that it does not depend on summation order."""
    return F.round(column, 2)


def fits_broadcast(df: DataFrame, widening: float = 1.0) -> bool:
    """Whether the optimizer's size estimate, times ``widening``, is below the broadcast limit."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size * widening <= limit


def join_dimension(
    facts: DataFrame, dimension: DataFrame, key: str, dimension_key: str, days: Column, sums: dict[str, Column],
    maxima: dict[str, Column], attributes: list[Column], small: bool,
) -> DataFrame:
    """Sums and maxima per (attributes, ds); ``small`` says that the dimension may be broadcast."""

    def totals(rows: dict[str, Column], peaks: dict[str, Column]) -> list[Column]:
        return [F.sum(c).alias(n) for n, c in rows.items()] + [F.max(c).alias(n) for n, c in peaks.items()]

    if small:
        joined = facts.join(F.broadcast(dimension), facts[key] == dimension[dimension_key])
        return joined.groupBy(*attributes, days.alias("ds")).agg(*totals(sums, maxima))
    daily = facts.groupBy(key, days.alias("ds")).agg(*totals(sums, maxima))
    joined = daily.join(dimension, daily[key] == dimension[dimension_key])
    again = totals({n: F.col(n) for n in sums}, {n: F.col(n) for n in maxima})
    return joined.groupBy(*attributes, "ds").agg(*again)


def customer_regions(spark: SparkSession, folder: str) -> DataFrame:
    customer = scan(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = scan(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = scan(spark, folder, "region").select("r_regionkey", "r_name")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("c_custkey", "n_name", "r_name")
    )


def _regional(spark: SparkSession, folder: str, attributes: list[Column]) -> DataFrame:
    # each customer has one nation and region: the joined rows are as many, and wider
    small = fits_broadcast(scan(spark, folder, "customer").select("c_custkey", "c_nationkey"), widening=4.0)
    totals = join_dimension(
        scan(spark, folder, "orders"), customer_regions(spark, folder), "o_custkey", "c_custkey",
        F.to_date("o_orderdate"), {"y": F.col("o_totalprice")}, {}, attributes, small,
    )
    return totals.withColumn("y", cents(F.col("y")))


def region_sales(spark: SparkSession, folder: str) -> DataFrame:
    """region, store (nation), ds, y: daily order totals."""
    return _regional(spark, folder, [F.col("r_name").alias("region"), F.col("n_name").alias("store")])


def region_panel(spark: SparkSession, folder: str) -> DataFrame:
    """series_id (region), ds, y: daily order totals."""
    return _regional(spark, folder, [F.col("r_name").alias("series_id")])


def _shipped(spark: SparkSession, folder: str, attributes: list[Column]) -> DataFrame:
    part = scan(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    sums = {
        "y": F.col("l_extendedprice"), "units": F.col("l_quantity"), "discount_sum": F.col("l_discount"), "lines": F.lit(1),
    }
    totals = join_dimension(
        scan(spark, folder, "lineitem"), part, "l_partkey", "p_partkey", F.to_date("l_shipdate"), sums,
        {"promo_flag": (F.col("l_discount") >= 0.08).cast("int")}, attributes, fits_broadcast(part),
    )
    return totals.withColumns({"y": cents(F.col("y")), "discount_sum": cents(F.col("discount_sum"))})


def brand_sales(spark: SparkSession, folder: str) -> DataFrame:
    """product type, brand, ds with y, units, discount total, lines and promotion flag."""
    return _shipped(spark, folder, [F.col("p_type").alias("category"), F.col("p_brand").alias("brand")])


def brand_panel(spark: SparkSession, folder: str) -> DataFrame:
    """series_id (brand), ds, y, discount, promo_flag: daily shipped value."""
    rows = _shipped(spark, folder, [F.col("p_brand").alias("series_id")])
    return rows.select("series_id", "ds", "y", (F.col("discount_sum") / F.col("lines")).alias("discount"), "promo_flag")


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    """series_id (event type), ds, y (rows), v (value total)."""
    return (
        scan(spark, folder, "events")
        .groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("ds"))
        .agg(F.count(F.lit(1)).cast("double").alias("y"), cents(F.sum("value")).alias("v"))
    )
