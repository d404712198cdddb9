"""Inputs of the queries: raw tables and factor tables derived from the given ones.

Each has a Spark form and, for the comparison engine, an SQL form with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import brand_panel, cents, region_panel, scan
from ..store import materialize

REGION = """region_panel AS (
  SELECT r_name AS series_id, CAST(o_orderdate AS DATE) AS ds, round(sum(o_totalprice), 2) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""

STORE = """store_sales AS (
  SELECT r_name AS region, n_name AS store, CAST(o_orderdate AS DATE) AS ds,
         round(sum(o_totalprice), 2) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""

BRAND = """brand_panel AS (
  SELECT p_brand AS series_id, CAST(l_shipdate AS DATE) AS ds, round(sum(l_extendedprice), 2) AS y,
         round(sum(l_discount), 2) / count(*) AS discount,
         max(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END) AS promo_flag
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

PRODUCT = """product_sales AS (
  SELECT p_type AS category, p_brand AS brand, CAST(l_shipdate AS DATE) AS ds,
         round(sum(l_extendedprice), 2) AS y, sum(l_quantity) AS units
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""

EVENT = """event_panel AS (
  SELECT event_type AS series_id, CAST(ts AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y,
         round(sum(value), 2) AS v
  FROM events GROUP BY 1, 2)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- raw tables with the faults the normaliser has to deal with ---------------------

RAW_SALES = """raw_sales AS (
  SELECT CASE o_orderkey % 5
           WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
           WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN strftime(o_orderdate, '%d-%b-%Y')
           ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y%m%d') END
         END AS date_text,
         CASE WHEN o_orderkey % 7 = 0 THEN 'foo' ELSE CAST(o_totalprice AS VARCHAR) END AS value_text,
         o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS true_date, o_totalprice AS true_value,
         o_orderkey AS order_key
  FROM orders)"""

PARSED_DATE = """CAST(coalesce(try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%Y/%m/%d'),
  try_strptime(date_text, '%m/%d/%Y'), try_strptime(date_text, '%d-%b-%Y'),
  try_strptime(date_text, '%Y%m%d')) AS DATE)"""


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders")
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    date_text = (
        F.when(key % 5 == 0, F.date_format(when, "yyyy-MM-dd"))
        .when(key % 5 == 1, F.date_format(when, "MM/dd/yyyy"))
        .when(key % 5 == 2, F.date_format(when, "yyyy/MM/dd"))
        .when(key % 5 == 3, F.date_format(when, "dd-MMM-yyyy"))
        .when(key % 3 == 0, F.lit("not a date"))
        .otherwise(F.date_format(when, "yyyyMMdd"))
    )
    return orders.select(
        date_text.alias("Order Date"),
        F.when(key % 7 == 0, F.lit("foo")).otherwise(F.col("o_totalprice").cast("string")).alias("Sales"),
        F.col("o_orderpriority").alias("Priority"),
        F.lit(None).cast("string").alias("Unused"),
    )


def raw_media(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        F.col("o_orderdate").alias("Date"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("Platform"),
        F.when(key % 13 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("Cost"),
        F.col("o_custkey").cast("string").alias("Imps"),
    )


def raw_promotions(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("Report Date"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("Discount Pct"),
        F.col("l_returnflag").alias("Campaign ID"),
        F.col("l_linestatus").alias("Type"),
    )


def raw_impacts(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        F.col("o_orderdate").alias("day"),
        F.when(key % 9 != 0, F.col("o_orderstatus")).alias("name"),
        F.col("o_orderpriority").alias("kind"),
        F.when(key % 4 != 0, F.col("o_totalprice") / 100000).alias("lift"),
    )


def raw_weather(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("date"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("temp"),
        (F.col("l_tax") * 100).alias("humidity"),
        F.when(F.col("l_linenumber") != 5, F.col("l_partkey")).cast("double").alias("precip"),
        F.col("l_returnflag").alias("station"),
    )


def raw_competitor(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("date"),
        F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("brand"),
        F.col("l_linenumber").cast("string").alias("share"),
        F.when(F.col("l_discount") >= 0.05, "1").otherwise("no").alias("is_promo"),
    )


def raw_economic(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly order value (as text with holes) and order count."""
    month = F.trunc("o_orderdate", "MONTH")
    return (
        scan(spark, folder, "orders")
        .groupBy(month.alias("date"))
        .agg(cents(F.sum("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("orders"))
        .select(
            "date",
            F.when(F.month("date") % 4 != 1, F.col("total").cast("string")).alias("gdp"),
            F.when(F.month("date") > 2, F.col("orders")).cast("double").alias("cpi"),
        )
    )


RAW_ECONOMIC = """raw_economic AS (
  SELECT date, CASE WHEN month(date) % 4 <> 1 THEN total END AS gdp,
         CASE WHEN month(date) > 2 THEN CAST(orders AS DOUBLE) END AS cpi
  FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               round(sum(o_totalprice), 2) AS total, count(*) AS orders
        FROM orders GROUP BY 1))"""


# --- factor tables in canonical form, one or a few rows per day ------------------------

PROMOTIONS = """promotions AS (
  SELECT CAST(l_shipdate AS DATE) AS ds, l_returnflag AS promo_type, round(sum(l_discount), 2) AS discount
  FROM lineitem WHERE l_discount >= 0.08 GROUP BY 1, 2)"""
MEDIA = """media_plan AS (
  SELECT CAST(o_orderdate AS DATE) AS ds, o_orderpriority AS media_channel,
         round(sum(o_totalprice), 2) AS media_spend, CAST(count(*) AS DOUBLE) AS reach
  FROM orders GROUP BY 1, 2)"""
HOLIDAYS = """holidays AS (
  SELECT CAST(o_orderdate AS DATE) AS ds, o_orderstatus AS holiday_name,
         max(o_totalprice) / 400000 AS holiday_impact
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 GROUP BY 1, 2)"""
EVENTS = """promo_events AS (
  SELECT CAST(l_shipdate AS DATE) AS ds, l_linestatus AS event_name,
         max(l_extendedprice) / 100000 AS event_impact
  FROM lineitem WHERE l_quantity >= 49 GROUP BY 1, 2)"""
WEATHER = """weather AS (
  SELECT CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) / count(*) AS temperature,
         CAST(max(l_linenumber) AS DOUBLE) AS rainfall
  FROM lineitem GROUP BY 1)"""
COMPETITOR = """competitor AS (
  SELECT CAST(l_shipdate AS DATE) AS ds, l_returnflag AS competitor_name,
         round(sum(l_extendedprice), 2) / count(*) AS competitor_price,
         max(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS promotion_flag
  FROM lineitem GROUP BY 1, 2)"""
ECONOMIC = """economic AS (
  SELECT CAST(o_orderdate AS DATE) AS ds, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS confidence
  FROM orders GROUP BY 1)"""


def promotions(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scan(spark, folder, "lineitem")
        .filter(F.col("l_discount") >= 0.08)
        .groupBy(F.to_date("l_shipdate").alias("ds"), F.col("l_returnflag").alias("promo_type"))
        .agg(cents(F.sum("l_discount")).alias("discount"))
    )


def media_plan(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scan(spark, folder, "orders")
        .groupBy(F.to_date("o_orderdate").alias("ds"), F.col("o_orderpriority").alias("media_channel"))
        .agg(
            cents(F.sum("o_totalprice")).alias("media_spend"),
            F.count(F.lit(1)).cast("double").alias("reach"),
        )
    )


def holidays(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scan(spark, folder, "orders")
        .filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000))
        .groupBy(F.to_date("o_orderdate").alias("ds"), F.col("o_orderstatus").alias("holiday_name"))
        .agg((F.max("o_totalprice") / 400000).alias("holiday_impact"))
    )


def promo_events(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scan(spark, folder, "lineitem")
        .filter(F.col("l_quantity") >= 49)
        .groupBy(F.to_date("l_shipdate").alias("ds"), F.col("l_linestatus").alias("event_name"))
        .agg((F.max("l_extendedprice") / 100000).alias("event_impact"))
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scan(spark, folder, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("ds"))
        .agg(
            (F.sum("l_quantity") / F.count(F.lit(1))).alias("temperature"),
            F.max("l_linenumber").cast("double").alias("rainfall"),
        )
    )


def competitor(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scan(spark, folder, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("ds"), F.col("l_returnflag").alias("competitor_name"))
        .agg(
            (cents(F.sum("l_extendedprice")) / F.count(F.lit(1))).alias("competitor_price"),
            F.max((F.col("l_discount") >= 0.05).cast("int")).alias("promotion_flag"),
        )
    )


def economic(spark: SparkSession, folder: str) -> DataFrame:
    # distinct (day, customer) pairs first, so a hot day is counted by many tasks
    return (
        scan(spark, folder, "orders")
        .select(F.to_date("o_orderdate").alias("ds"), "o_custkey")
        .distinct()
        .groupBy("ds")
        .agg(F.count(F.lit(1)).cast("double").alias("confidence"))
    )


FACTOR_SQL = [PROMOTIONS, MEDIA, HOLIDAYS, EVENTS, WEATHER, COMPETITOR, ECONOMIC]


def factors(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "promotions": promotions(spark, folder),
        "media_plan": media_plan(spark, folder),
        "holidays": holidays(spark, folder),
        "events": promo_events(spark, folder),
        "weather": weather(spark, folder),
        "competitor": competitor(spark, folder),
        "economic": economic(spark, folder),
    }


# --- panels for queries that use them more than once: the source is scanned one time ------


def regions(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(region_panel(spark, folder))


def brands(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(brand_panel(spark, folder))


def daily_factors(spark: SparkSession, folder: str, *kinds: str) -> dict[str, DataFrame]:
    return {k: materialize(f) for k, f in factors(spark, folder).items() if not kinds or k in kinds}
