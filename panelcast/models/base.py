"""Shared parts of the forecasters.

A forecaster is any object with ``name``, ``fit`` and ``forecast``:

* ``fit(panel, factors)`` gives a parameter table with one row per series; a model that names
  parameters in ``tunable`` also takes ``settings``, a table ``series_id, params map<string,string>`` whose
  values replace the model's own for their series, so that one job fits every series its own way;
* ``forecast(fitted, horizon, freq, factors)`` gives one row per series and step with
  ``series_id, step, ds, yhat, lower_ci, upper_ci``.

Both work on all series at once. A fitted table can be stored and used later without
the panel. Nothing inspects ``series_id``: a fold or candidate number may be part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.dates import future_date
from ..functions.scalars import safe_float, uplift_pct

Factors = dict[str, DataFrame]
FORECAST = ["series_id", "step", "ds", "yhat", "lower_ci", "upper_ci"]
Z95 = 1.96  # fixed value: two-sided 95 % point of the normal distribution


class TooLittleData(ValueError):
    """A training set below the least number of rows."""


class Forecaster(Protocol):
    name: str

    def fit(self, panel: DataFrame, factors: Factors | None = None) -> DataFrame: ...

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame: ...


#: Names under which a parameter is also known.
ALIASES = {"period": ("period", "seasonal_periods")}
OFF = "none"  # text that stands for a part that is left out


def configured(table: DataFrame, settings: DataFrame | None, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """``table`` with a column ``own_<name>`` per parameter, given as name: (type, default).

    ``settings`` has at most one row per series. A text value ``none`` becomes null.
    """
    if settings is None:
        return table.withColumns({f"own_{n}": F.lit(v).cast(t) for n, (t, v) in defaults.items()})
    joined = table.join(settings.select("series_id", "params"), "series_id", "left")
    own = {}
    for name, (kind, default) in defaults.items():
        given = F.coalesce(*[F.element_at("params", k) for k in ALIASES.get(name, (name,))])
        value = F.when(F.lower(given) != OFF, given.cast("double").cast(kind) if kind == "int" else given.cast(kind))
        own[f"own_{name}"] = F.when(given.isNull(), F.lit(default).cast(kind)).otherwise(value)
    return joined.withColumns(own).drop("params")


def fit_with(model: Forecaster, panel: DataFrame, factors: Factors | None, settings: DataFrame | None) -> DataFrame:
    """Fit, with the series' own settings where the model can use them."""
    if settings is None or not getattr(model, "tunable", ()):
        return model.fit(panel, factors)
    return model.fit(panel, factors, settings)


def steps(fitted: DataFrame, horizon: int, freq: str) -> DataFrame:
    """Each fitted row once per step, with the date of that step.

    A column ``own_steps`` limits the steps of its series.
    """
    last = F.least(F.lit(horizon), F.col("own_steps").cast("int")) if "own_steps" in fitted.columns else F.lit(horizon)
    return fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.greatest(last, F.lit(1))))).withColumn(
        "ds", future_date("last_ds", "step", freq)
    )


def banded(df: DataFrame, yhat: Column, half_width: Column | None, share: float = 0.15,
           non_negative: bool = False) -> DataFrame:
    """Forecast columns with an interval of ``half_width``, or of a share where it is 0."""
    raw = safe_float(yhat)
    low, high = raw * (1 - share), raw * (1 + share)
    if half_width is not None:
        low = F.when(half_width > 0, raw - half_width).otherwise(low)
        high = F.when(half_width > 0, raw + half_width).otherwise(high)
    value = raw
    if non_negative:
        value, low = F.greatest(raw, F.lit(0.0)), F.greatest(low, F.lit(0.0))
    return df.select(
        "series_id", "step", "ds", value.alias("yhat"), low.alias("lower_ci"), high.alias("upper_ci")
    )


def with_baseline(
    model: Forecaster, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
) -> DataFrame:
    """Forecast with the factors beside the one without them, and the uplift in percent."""
    full = model.forecast(fitted, horizon, freq, factors)
    base = model.forecast(fitted, horizon, freq, None).select(
        "series_id", "step", F.col("yhat").alias("baseline")
    )
    return full.join(base, ["series_id", "step"]).select(
        F.lit(model.name).alias("model"), *FORECAST, "baseline",
        uplift_pct("yhat", "baseline").alias("uplift"),
    )


def as_arrays(panel: DataFrame, *values: str) -> DataFrame:
    """One row per series: its values as arrays in date order and its last date.

    The panel has one row per period, so an array is bounded by the calendar. The
    partition number is set: it follows the cost of the numeric work done on the arrays
    and must not shrink with their size in bytes.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ds", *(values or ("y",)))))
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = panel.repartition(parts, "series_id").groupBy("series_id").agg(ordered.alias("rows"))
    picked = [F.col("rows")[v].alias(f"{v}s") for v in (values or ("y",))]
    return out.select(
        "series_id", *picked, F.col("rows")["ds"].alias("dss"),
        F.element_at(F.col("rows")["ds"], -1).alias("last_ds"),
    )


def per_row(
    table: DataFrame, schema: str, work: Callable[[pd.Series], dict], keep: tuple[str, ...] = ()
) -> DataFrame:
    """Numeric work on one array row per series, in Arrow batches and without a shuffle."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [{**{k: row[k] for k in keep}, **work(row)} for _, row in frame.iterrows()]
            if out:
                yield pd.DataFrame(out)

    return table.mapInPandas(batches, schema)


def appended(table: DataFrame, name: str, kind: str, inputs: Sequence[str], work: Callable) -> DataFrame:
    """``table`` with one more column, ``work`` of a row's ``inputs``; all other columns pass unread."""
    field = T.StructType.fromDDL(f"`{name}` {kind}").fields[0]
    schema, arrow = T.StructType([*table.schema.fields, field]), to_arrow_type(field.dataType)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = zip(*(part.column(c).to_pylist() for c in inputs), strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([work(*r) for r in rows], arrow)], names=schema.names)

    return table.mapInArrow(batches, schema)
