"""Queries for sources and sinks (S) and the batch job (M30)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import job, store
from ..models.wma import WMA
from ..operators import evaluate as ev
from ..operators.normalize import normalize
from ..sources.tables import brand_panel, region_panel, scan
from . import inputs as i
from . import model_sql as ms
from .evaluate_queries import BACKTEST_ROWS
from .model_queries import START_DAY, TREND, group_sql
from .registry import query


@query("s1_csv_scan", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, o_orderpriority FROM orders""")
def s1(spark: SparkSession, folder: str) -> DataFrame:
    path = store.scratch_path(spark, "orders_csv")
    scan(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice", "o_orderpriority").write.csv(path, header=True)
    return store.read_csv(spark, path, "o_orderkey bigint, o_orderdate date, o_totalprice double, o_orderpriority string")


@query("s2_parquet_scan", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'""")
def s2(spark: SparkSession, folder: str) -> DataFrame:
    rows = store.read_parquet(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"])
    return rows.filter(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).drop("l_shipdate")


@query("s4_save_dataset", """SELECT CAST(o_orderdate AS DATE) AS ds, o_orderpriority AS media_channel, round(sum(o_totalprice), 2) AS media_spend FROM orders GROUP BY 1, 2""")
def s4(spark: SparkSession, folder: str) -> DataFrame:
    root = store.scratch_path(spark, "datasets")
    raw = scan(spark, folder, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("channel"), F.col("o_totalprice").alias("spend"))
    clean, _ = normalize(raw, "media_plan")
    dataset_id = store.save_dataset(clean, root, "media_plan", "orders")
    return store.load_dataset(spark, root, "media_plan", dataset_id).select("ds", "media_channel", F.round("media_spend", 2).alias("media_spend"))


@query("s5_run_results", """WITH n AS (SELECT count(DISTINCT r_name) AS series FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT 'r2' AS run_id, 9 * series AS rows, 'Run r2' AS name FROM n UNION ALL SELECT 'r3', 7 * series, 'Run r3' FROM n""")
def s5(spark: SparkSession, folder: str) -> DataFrame:
    root = store.scratch_path(spark, "runs")
    model, panel = WMA(), region_panel(spark, folder)
    fitted = model.fit(panel)
    for run_id, horizon in (("r1", 3), ("r2", 5), ("r3", 7)):
        store.save_run(root, run_id, {"forecast": model.forecast(fitted, horizon)}, f"Run {run_id}")
    store.update_run(root, "r2", "forecast", model.forecast(fitted, 9))
    store.delete_run(spark, root, "r1")
    listed = store.list_runs(spark, root).select("run_id", "name")
    return spark.read.parquet(f"{root}/forecast").groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).join(listed, "run_id")


@query("s6_newest_dataset", """SELECT kind, uploaded_at, dataset_id, rows FROM (SELECT l_returnflag AS kind, CAST(l_shipdate AS DATE) AS uploaded_at,
  l_orderkey * 10 + l_linenumber AS dataset_id, l_quantity AS rows, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""")
def s6(spark: SparkSession, folder: str) -> DataFrame:
    catalog = scan(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("kind"), F.to_date("l_shipdate").alias("uploaded_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("dataset_id"), F.col("l_quantity").alias("rows"),
    )
    return store.newest_datasets(catalog)


EXPORT = i.with_sql(*BACKTEST_ROWS, *ms.wma("region_panel", 7)) + """SELECT series_id, ds, 'backtest' AS type, round(yhat, 4) AS forecast,
  y AS actual, round(y - yhat, 4) AS error, round(lower_ci, 4) AS lower_ci, round(upper_ci, 4) AS upper_ci FROM bt_rows WHERE model = 'wma'
  UNION ALL SELECT series_id, ds, 'forecast', round(yhat, 4), NULL, NULL, round(lower_ci, 4), round(upper_ci, 4) FROM wma_forecast"""


def exported(spark: SparkSession, folder: str) -> DataFrame:
    model, panel = WMA(), i.regions(spark, folder)
    return store.export_rows(model.forecast(model.fit(panel), 7), ev.backtest(panel, [model]).drop("y", "model"), panel)


def shape(rows: DataFrame) -> DataFrame:
    numbers = ["forecast", "lower_ci", "upper_ci"]
    return rows.select("series_id", "ds", "type", "actual", "error", *[F.round(c, 4).alias(c) for c in numbers])


@query("s7_export_csv", EXPORT)
def s7(spark: SparkSession, folder: str) -> DataFrame:
    path = store.scratch_path(spark, "export_csv")
    rows = exported(spark, folder)
    store.export_csv(rows, path)
    return shape(store.read_csv(spark, path, rows.schema))


@query("s8_export_json", EXPORT)
def s8(spark: SparkSession, folder: str) -> DataFrame:
    path = store.scratch_path(spark, "export_json")
    rows = exported(spark, folder)
    store.export_json(rows, path)
    return shape(spark.read.schema(rows.schema).json(path))


JOB_LOOKBACK = "CASE WHEN series_id = 'Brand#1' THEN 3 ELSE 6 END"


@query("m30_batch_job", i.with_sql(i.BRAND, *group_sql("W", 8, JOB_LOOKBACK), TREND) + """SELECT g.series_id AS brand, g.ds,
  round(greatest(0, coalesce(CASE WHEN g.series_id = 'Brand#1' THEN median ELSE wma END, fallback) * trend_factor), 4) AS yhat
  FROM "goal_W" g LEFT JOIN "base_W" b ON g.series_id = b.series_id AND g.ds = b.ds JOIN "fallback_W" f ON f.series_id = g.series_id
  JOIN trend t ON t.series_id = g.series_id""")
def m30(spark: SparkSession, folder: str) -> DataFrame:
    root = store.scratch_path(spark, "job")
    sales = brand_panel(spark, folder).select(F.col("series_id").alias("brand"), F.col("ds").alias("date"), F.col("y").alias("sales"), "promo_flag", "discount")
    sales.write.csv(f"{root}/sales", header=True)
    args = job.parser().parse_args([
        "--sales", f"{root}/sales", "--attributes", "brand", "--freq", "W", "--start", START_DAY, "--periods", "8", "--output", f"{root}/out",
        "--lookback", '[{"brand": "Brand#1", "D": 4, "W": 3, "M": 2, "method": "median"}]',
    ])
    return job.forecast(spark, args).select("brand", "ds", F.round("yhat", 4).alias("yhat"))
