"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import posixpath
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, ship_package

#: Bytes of text that one Arrow batch hands to a Python worker, so that long texts don't pile up.
BATCH_BYTES = 8 << 20


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Return freed memory to the system.

    Python workers are used again by the tasks of later stages, so what their allocators hold
    back adds up over a pipeline. Called once per batch of texts.
    """
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches by bytes; a limit set by the user stays."""
    ship_package(spark)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(limit).lower().rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, which outlive lost executors."""
    path = shared_folder(df.sparkSession, "table")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(path: str) -> str:
    """``path`` as a URI, so that every worker opens the same place."""
    return path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}"


def open_folder(uri: str):
    """File system and path of a URI; any that Arrow knows (local, HDFS, S3, ...)."""
    from pyarrow import fs

    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 20_000, weigh=None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``limit`` rows or ``BATCH_BYTES`` bytes as told by ``weigh``."""
    kept: list[tuple] = []
    size = 0
    for row in rows:
        kept.append(row)
        size += weigh(row) if weigh else 0
        if len(kept) >= limit or size >= BATCH_BYTES:
            yield _batch(kept, schema)
            kept, size = [], 0
            give_back()
    if kept:
        yield _batch(kept, schema)
    give_back()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def columns_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)
        give_back()
