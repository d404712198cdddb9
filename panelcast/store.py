"""Datasets, forecast runs and fitted models as Parquet tables.

Every table is partitioned by the identifier it is looked up and replaced by, so a
lookup reads one partition and a replacement rewrites one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions.scalars import safe_float
from .session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelcast-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and continue from the files.

    For a table that is derived from a large scan and used more than once: the scan runs
    once, the copy is columnar and has a known size, and it outlives lost executors.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _delete(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with header. The schema is given, as inferring it would read the data twice."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


# --- datasets ----------------------------------------------------------------------------


def save_dataset(df: DataFrame, root: str, kind: str, name: str, dataset_id: str | None = None) -> str:
    """Write a normalised table and its catalogue row; the identifier is returned."""
    spark = df.sparkSession
    dataset_id = dataset_id or uuid.uuid4().hex
    path = f"{root}/data/kind={kind}/dataset_id={dataset_id}"
    df.write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    entry = written.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), "rows",
        F.lit(",".join(df.columns)).alias("columns"), F.current_timestamp().alias("uploaded_at"),
    )
    entry.write.mode("append").parquet(f"{root}/catalog")
    return dataset_id


def load_dataset(spark: SparkSession, root: str, kind: str, dataset_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data/kind={kind}/dataset_id={dataset_id}")


def list_datasets(catalog: DataFrame, kind: str | None = None) -> DataFrame:
    """Catalogue rows, newest first."""
    rows = catalog.filter(F.col("kind") == kind) if kind else catalog
    return rows.orderBy(F.desc("uploaded_at"), "dataset_id")


def newest_datasets(catalog: DataFrame) -> DataFrame:
    """The newest dataset of each kind, as an aggregate: no kind is gathered in one task."""
    rest = [c for c in catalog.columns if c not in ("kind", "uploaded_at", "dataset_id")]
    order = F.struct("uploaded_at", "dataset_id")
    newest = catalog.groupBy("kind").agg(F.max_by(F.struct("uploaded_at", "dataset_id", *rest), order).alias("d"))
    return newest.select("kind", "d.*")


# --- forecast runs ------------------------------------------------------------------------


def save_run(root: str, run_id: str, tables: dict[str, DataFrame], name: str = "") -> None:
    """Write, or replace, the tables of a run. The forecast comes first."""
    order = sorted(tables, key=lambda t: (t != "forecast", t))
    for table in order:
        tables[table].withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{table}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(
        F.lit(name).alias("name"), F.current_timestamp().alias("created_at"), F.lit(",".join(order)).alias("tables"),
        F.lit(run_id).alias("run_id"),
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/runs")


def update_run(root: str, run_id: str, table: str, rows: DataFrame) -> None:
    """Replace one table of a run; other runs stay as they are."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{table}")


def load_run(spark: SparkSession, root: str, run_id: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}").filter(F.col("run_id") == run_id)


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/runs").orderBy(F.desc("created_at"), "run_id")


def delete_run(spark: SparkSession, root: str, run_id: str) -> bool:
    """Drop the run's partition from every table; False when there is no such run."""
    if not _exists(spark, f"{root}/runs/run_id={run_id}"):
        return False
    row = spark.read.parquet(f"{root}/runs").filter(F.col("run_id") == run_id).select("tables").first()
    for table in [*row[0].split(","), "runs"]:
        _delete(spark, f"{root}/{table}/run_id={run_id}")
    return True


# --- export --------------------------------------------------------------------------------


def export_rows(forecast: DataFrame, backtest: DataFrame | None = None, actual: DataFrame | None = None) -> DataFrame:
    """Backtest rows with actual and error, then forecast rows, in one flat table."""
    blank = F.lit(None).cast("double")

    def shaped(df: DataFrame, kind: str, y: Column) -> DataFrame:
        extra = [F.col(c) if c in df.columns else blank.alias(c) for c in ("baseline", "uplift")]
        return df.select(
            "series_id", "ds", F.lit(kind).alias("type"), F.col("yhat").alias("forecast"), y.alias("actual"),
            F.round(y - F.col("yhat"), 4).alias("error"), "lower_ci", "upper_ci", *extra,
        )

    out = shaped(forecast, "forecast", blank)
    if backtest is not None:
        joined = backtest.drop("y").join(actual.select("series_id", "ds", "y"), ["series_id", "ds"], "left")
        out = shaped(joined, "backtest", F.col("y")).unionByName(out)
    return out


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null, as JSON has no spelling for them."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = {c: F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) for c in doubles}
    return df.withColumns({c: F.when(~bad[c], F.col(c)) for c in doubles})


def export_json(rows: DataFrame, path: str) -> None:
    finite_or_null(rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# --- models ----------------------------------------------------------------------------------


def _fingerprint(params: Column) -> Column:
    return F.sha2(params, 256)


def save_model(
    fitted: DataFrame, root: str, model_type: str, name: str, metrics: DataFrame | None = None, model_id: str | None = None,
    tags: Sequence[str] = (), notes: str = "", train_range: tuple[str, str] | None = None, test_range: tuple[str, str] | None = None,
) -> str:
    """Append a fitted parameter table: one JSON row and its content hash per series.

    Type, name, tags and ranges go to a small metadata table beside it.
    """
    spark = fitted.sparkSession
    model_id = model_id or uuid.uuid4().hex
    params = F.to_json(F.struct(*[c for c in fitted.columns]), {"ignoreNullFields": "false"})
    rows = fitted.select(F.col("series_id"), params.alias("params")).withColumn("sha256", _fingerprint(F.col("params")))
    if metrics is not None:
        rows = rows.join(metrics.select("series_id", "mae", "rmse", "mape"), "series_id", "left")
    else:
        rows = rows.withColumns({m: F.lit(None).cast("double") for m in ("mae", "rmse", "mape")})
    rows.withColumn("model_id", F.lit(model_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(f"{root}/parameters")
    tag_list = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    first, last = train_range or (None, None)
    t_first, t_last = test_range or (None, None)
    spark.range(1).select(
        F.lit(model_type).alias("model_type"), F.lit(name).alias("name"), F.lit(notes).alias("notes"), tag_list.alias("tags"),
        F.lit(fitted.schema.json()).alias("schema"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
        *[F.lit(v).cast("string").alias(n) for n, v in [("train_start", first), ("train_end", last), ("test_start", t_first), ("test_end", t_last)]],
        F.lit(model_id).alias("model_id"),
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(f"{root}/models")
    return model_id


def load_model(spark: SparkSession, root: str, model_id: str) -> DataFrame:
    """Fitted parameter table; a row whose content does not match its hash is an error."""
    meta = spark.read.parquet(f"{root}/models").filter(F.col("model_id") == model_id).select("schema").first()
    if meta is None:
        raise ValueError(f"no model {model_id!r}")
    rows = spark.read.parquet(f"{root}/parameters").filter(F.col("model_id") == model_id)
    intact = _fingerprint(F.col("params")) == F.col("sha256")
    checked = F.when(intact, F.col("params")).otherwise(F.raise_error(F.lit(f"stored parameters of {model_id} were changed")))
    import json

    schema = T.StructType.fromJson(json.loads(meta[0]))
    return rows.select(F.from_json(checked.cast("string"), schema).alias("p")).select("p.*")


def list_models(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/models").drop("schema")


def update_model(spark: SparkSession, root: str, model_id: str, name: str | None = None, notes: str | None = None,
                 tags: Sequence[str] | None = None) -> None:
    """Change name, notes or tags of one model. The row is read before its partition is replaced."""
    found = spark.read.parquet(f"{root}/models").filter(F.col("model_id") == model_id)
    row = found.first()
    if row is None:
        raise ValueError(f"no model {model_id!r}")
    kept = spark.createDataFrame([row], found.schema)
    changes: dict[str, Column] = {"updated_at": F.current_timestamp()}
    if name is not None:
        changes["name"] = F.lit(name)
    if notes is not None:
        changes["notes"] = F.lit(notes)
    if tags is not None:
        changes["tags"] = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    kept.withColumns(changes).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(f"{root}/models")


def delete_model(spark: SparkSession, root: str, model_id: str) -> bool:
    if not _exists(spark, f"{root}/models/model_id={model_id}"):
        return False
    _delete(spark, f"{root}/parameters/model_id={model_id}")
    return _delete(spark, f"{root}/models/model_id={model_id}")
