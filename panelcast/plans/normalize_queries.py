"""Queries for the normalisation operators (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import safe_float, to_number
from ..operators import enrich, normalize as nz
from ..sources.tables import cents, region_panel, scan
from . import inputs as i
from .registry import query


@query("n1_column_names", """SELECT o_orderkey AS order_key, o_totalprice AS total_price_usd_,
  o_orderstatus AS status FROM orders""")
def n1(spark: SparkSession, folder: str) -> DataFrame:
    messy = scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("o_totalprice").alias(" Total--Price (USD) "),
        F.col("o_orderstatus").alias("STATUS"),
    )
    named = nz.normalize_names(messy)
    status = nz.find_column(named.columns, ["state", "Status"])
    return named.select("order_key", "total_price_usd_", F.col(status).alias("status"))


@query("n2_date_column", """SELECT CAST(l_shipdate AS DATE) AS ds, count(*) AS lines,
  'l_shipdate' AS date_column FROM lineitem GROUP BY 1""")
def n2(spark: SparkSession, folder: str) -> DataFrame:
    lines = scan(spark, folder, "lineitem")
    name = nz.find_date_column(lines.schema)
    return (
        lines.groupBy(nz.parse_date(lines, name).alias("ds"))
        .agg(F.count(F.lit(1)).alias("lines"))
        .withColumn("date_column", F.lit(name))
    )


@query("n3_parse_dates", i.with_sql(i.RAW_SALES) + f"""SELECT {i.PARSED_DATE} AS ds, count(*) AS n
  FROM raw_sales GROUP BY 1""")
def n3(spark: SparkSession, folder: str) -> DataFrame:
    raw = i.raw_sales(spark, folder)
    return raw.groupBy(nz.parse_date(raw, "Order Date").alias("ds")).agg(F.count(F.lit(1)).alias("n"))


@query("n4_coerce_numbers", i.with_sql(i.RAW_SALES) + """SELECT priority,
  round(sum(CASE WHEN value_text <> 'foo' THEN true_value END), 2) AS total,
  count(*) FILTER (WHERE value_text = 'foo') AS rejected FROM raw_sales GROUP BY 1""")
def n4(spark: SparkSession, folder: str) -> DataFrame:
    number = to_number("Sales")
    return (
        i.raw_sales(spark, folder)
        .groupBy(F.col("Priority").alias("priority"))
        .agg(cents(F.sum(number)).alias("total"), F.count_if(number.isNull()).alias("rejected"))
    )


@query("n5_drop_empty", """SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 3 = 0 THEN o_totalprice END AS price
  FROM orders WHERE o_orderkey % 10 <> 0""")
def n5(spark: SparkSession, folder: str) -> DataFrame:
    kept = F.col("o_orderkey") % 10 != 0
    holed = scan(spark, folder, "orders").select(
        F.when(kept, F.col("o_orderstatus")).alias("status"),
        F.when(kept & (F.col("o_orderkey") % 3 == 0), F.col("o_totalprice")).alias("price"),
        F.lit(None).cast("double").alias("nothing"),
    )
    return nz.drop_empty(holed)


@query("n6_require_dates", i.with_sql(i.RAW_SALES) + f"""SELECT {i.PARSED_DATE} AS ds, value_text
  FROM raw_sales WHERE {i.PARSED_DATE} IS NOT NULL AND value_text = 'foo'""")
def n6(spark: SparkSession, folder: str) -> DataFrame:
    raw = i.raw_sales(spark, folder)
    dated = nz.require_dates(raw.select(nz.parse_date(raw, "Order Date").alias("ds"), "Sales"))
    return dated.filter(F.col("Sales") == "foo").withColumnRenamed("Sales", "value_text")


FILLED_SALES = f"""dated AS (
  SELECT {i.PARSED_DATE} AS ds, CASE WHEN value_text <> 'foo' THEN true_value END AS y, priority
  FROM raw_sales),
known AS (SELECT priority, ds, max(y) AS y FROM dated WHERE ds IS NOT NULL GROUP BY 1, 2),
filled AS (
  SELECT priority, ds, coalesce(
    last_value(y IGNORE NULLS) OVER (PARTITION BY priority ORDER BY ds
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(y IGNORE NULLS) OVER (PARTITION BY priority ORDER BY ds
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS fill FROM known),
normal AS (SELECT d.ds, d.priority, coalesce(d.y, f.fill) AS y
  FROM dated d JOIN filled f ON d.ds = f.ds AND d.priority = f.priority)"""


@query("n7_sales_fill", i.with_sql(i.RAW_SALES, FILLED_SALES) + "SELECT ds, priority, y FROM normal")
def n7(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = nz.normalize(i.raw_sales(spark, folder), "sales", deduplicate=False)
    return nz.normalize_names(out)


@query("n8_media", """SELECT CAST(o_orderdate AS DATE) AS ds,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority ELSE 'default' END AS media_channel,
  round(sum(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_totalprice END), 2) AS media_spend,
  CAST(sum(o_custkey) AS DOUBLE) AS impressions FROM orders GROUP BY 1, 2""")
def n8(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = nz.normalize(i.raw_media(spark, folder), "media_plan")
    return out.withColumn("media_spend", cents(F.col("media_spend")))


@query("n9_promotions", """SELECT CAST(l_shipdate AS DATE) AS ds, l_returnflag AS promo_id,
  l_linestatus AS promo_type, round(sum(CASE WHEN l_linenumber <> 3 THEN l_discount ELSE 0 END), 2)
  AS discount FROM lineitem GROUP BY 1, 2, 3""")
def n9(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = nz.normalize(i.raw_promotions(spark, folder), "promotions")
    return out.withColumn("discount", cents(F.col("discount")))


_IMPACT_SQL = """SELECT CAST(o_orderdate AS DATE) AS ds,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus ELSE 'Unknown' END AS {p}_name,
  o_orderpriority AS {p}_type,
  round(sum(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 100000 ELSE 1.0 END), 7)
  AS {p}_impact FROM orders GROUP BY 1, 2, 3"""


@query("n10_holiday_impacts", _IMPACT_SQL.format(p="holiday"))
def n10(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = nz.normalize(i.raw_impacts(spark, folder), "holidays")
    return out.withColumn("holiday_impact", F.round("holiday_impact", 7))


@query("n10_event_impacts", _IMPACT_SQL.format(p="event"))
def n10b(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = nz.normalize(i.raw_impacts(spark, folder), "events")
    return out.withColumn("event_impact", F.round("event_impact", 7))


@query("n11_weather", """SELECT CAST(l_shipdate AS DATE) AS ds, l_returnflag AS station,
  round(sum(coalesce(CASE WHEN l_linenumber <> 2 THEN l_quantity END,
    (SELECT avg(l_quantity) FROM lineitem WHERE l_linenumber <> 2))), 4) AS temperature,
  round(sum(l_tax * 100), 2) AS humidity,
  sum(CASE WHEN l_linenumber <> 5 THEN CAST(l_partkey AS DOUBLE) ELSE 0 END) AS rainfall,
  CAST(0 AS DOUBLE) AS snowfall FROM lineitem GROUP BY 1, 2""")
def n11(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = nz.normalize(i.raw_weather(spark, folder), "weather")
    return out.withColumns(
        {"temperature": F.round("temperature", 4), "humidity": F.round("humidity", 2)}
    )


@query("n12_competitor", """SELECT CAST(l_shipdate AS DATE) AS ds,
  CASE WHEN l_returnflag <> 'R' THEN l_returnflag ELSE 'Unknown' END AS competitor_name,
  round(sum(CASE WHEN l_linenumber <> 4 THEN l_extendedprice ELSE 0 END), 2) AS competitor_price,
  CAST(sum(l_linenumber) AS DOUBLE) AS market_share,
  CAST(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS promotion_flag
  FROM lineitem GROUP BY 1, 2""")
def n12(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = nz.normalize(i.raw_competitor(spark, folder), "competitor")
    return out.withColumn("competitor_price", cents(F.col("competitor_price")))


@query("n13_economic", i.with_sql(i.RAW_ECONOMIC) + """SELECT date AS ds,
  coalesce(last_value(gdp IGNORE NULLS) OVER back, first_value(gdp IGNORE NULLS) OVER ahead, 0) AS gdp,
  coalesce(last_value(cpi IGNORE NULLS) OVER back, first_value(cpi IGNORE NULLS) OVER ahead, 0) AS cpi
  FROM raw_economic WINDOW back AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  ahead AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def n13(spark: SparkSession, folder: str) -> DataFrame:
    return nz.normalize(i.raw_economic(spark, folder), "economic")[0]


@query("n14_column_order", """SELECT CAST(o_orderdate AS DATE) AS ds, o_orderpriority AS media_channel,
  round(sum(o_totalprice), 2) AS media_spend, o_orderstatus AS status FROM orders GROUP BY 1, 2, 4""")
def n14(spark: SparkSession, folder: str) -> DataFrame:
    raw = scan(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("channel"), F.col("o_orderdate").alias("order_date"),
    )
    out, _ = nz.normalize(raw, "media_plan")
    return out.withColumn("media_spend", cents(F.col("media_spend")))


@query("n15_collapse", """SELECT CAST(l_shipdate AS DATE) AS ds,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag,
  round(sum(l_extendedprice), 2) AS price, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2""")
def n15(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("ds"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"),
    )
    return nz.collapse(rows).withColumn("price", cents(F.col("price")))


@query("n16_normalize_kind", i.with_sql(i.RAW_SALES, FILLED_SALES) + """SELECT ds, priority,
  round(sum(y), 2) AS y FROM normal GROUP BY 1, 2""")
def n16(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = nz.normalize(i.raw_sales(spark, folder), "sales")
    return nz.normalize_names(out).withColumn("y", cents(F.col("y")))


@query("n17_factor_range", i.with_sql(i.REGION, i.PROMOTIONS) + """SELECT p.ds, promo_type, discount
  FROM promotions p, (SELECT min(ds) AS a, max(ds) AS b FROM region_panel) WHERE p.ds BETWEEN a AND b""")
def n17(spark: SparkSession, folder: str) -> DataFrame:
    panel = region_panel(spark, folder)
    return enrich.within_range(i.promotions(spark, folder), panel).select("ds", "promo_type", "discount")


@query("n18_finite_guard", """SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n,
  round(sum(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END), 4) AS ratio
  FROM lineitem GROUP BY 1""")
def n18(spark: SparkSession, folder: str) -> DataFrame:
    # a zero discount gives inf or NaN, which the guard turns into 0
    infinite = F.when(F.col("l_discount") == 0, F.lit(float("inf")) * F.when(F.col("l_tax") == 0, 0).otherwise(1))
    value = safe_float(F.coalesce(infinite, F.try_divide("l_tax", "l_discount")))
    return (
        scan(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("ratio"))
    )
