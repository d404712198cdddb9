"""Gradient-boosted trees over calendar, lag and rolling features of all series.

One distributed ``pyspark.ml`` ensemble serves the whole panel. Values are divided by the
level of their series, so series of any size share the trees and no series identifier
has to be encoded. Trees do not depend on feature scale, so nothing is standardised.

Trees are grown in stages of ``parallel`` trees. Those of a stage see the same residuals, each its own
sample of rows and columns, and grow together, a level of all of them per job; their mean counts as that many
steps of the learning rate at once. So 200 trees take 5 rounds of jobs instead of 200.

What a forecast needs of the ensemble is its node table, whose size is bounded by the number of
trees and their depth. It goes to the tasks, and each walks the steps of its series: the lags of
a step are known only after the one before, but all series of a batch take a step together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.enrich import attach_factors, wide_factors
from ..operators.grid import LAGS, ROLLING, calendar_features, lag_features, rolling_features
from ..store import materialize, scratch_path
from .base import Factors, TooLittleData, banded, steps

CALENDAR = [
    "dayofweek", "dayofmonth", "month", "quarter", "year", "weekofyear", "is_weekend", "is_month_start", "is_month_end",
]
MEMORY = max(*LAGS, *ROLLING)
ROWS_PER_TASK = 50_000
LEAST_ROWS = 10  # fixed value: fewer training rows are an error
PARALLEL = 40  # trees of a stage
SCORED = 4_000  # rows that walk all trees at once
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, gain double, weight double"


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees as arrays; a leaf has feature -1. ``depth`` is the longest path."""

    roots: np.ndarray
    weights: np.ndarray  # of each tree in the sum
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    base: float
    depth: int

    @classmethod
    def of(cls, nodes: pd.DataFrame, base: float) -> Trees:
        """From rows of the node table, whose ``left`` and ``right`` are node numbers within a tree."""
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        first = nodes.groupby("tree")["node"].transform("size")
        roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
        start = np.repeat(roots, first.to_numpy()[roots])
        feature = nodes["feature"].to_numpy(np.int64)
        left, right = (np.where(feature < 0, 0, nodes[c].to_numpy(np.int64) + start) for c in ("left", "right"))
        depth, level = 0, roots
        while len(level := level[feature[level] >= 0]):
            level, depth = np.concatenate([left[level], right[level]]), depth + 1
        return cls(roots, nodes["weight"].to_numpy()[roots], feature, nodes["threshold"].to_numpy(), left, right, nodes["value"].to_numpy(), nodes["gain"].to_numpy(), base, depth)

    def _walk(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each level's nodes and the ones after them, rows by trees."""
        rows = np.arange(len(x))[:, None]
        at = np.tile(self.roots, (len(x), 1))
        for _ in range(self.depth):
            feature = self.feature[at]
            down = np.where(x[rows, np.maximum(feature, 0)] <= self.threshold[at], self.left[at], self.right[at])
            after = np.where(feature < 0, at, down)
            yield at, after
            at = after

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for first in range(0, len(x), SCORED):
            part = x[first : first + SCORED]
            last = np.tile(self.roots, (len(part), 1))
            for _, last in self._walk(part):
                pass
            out[first : first + SCORED] = self.base + self.value[last] @ self.weights
        return out

    def mean(self) -> float:
        """What a row gets before any split is asked."""
        return float(self.base + self.value[self.roots] @ self.weights)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """What each feature adds to ``mean`` on the way to a row's prediction: rows by features."""
        out = np.zeros(x.shape)
        for first in range(0, len(x), SCORED):
            part = x[first : first + SCORED]
            for at, after in self._walk(part):
                change = (self.value[after] - self.value[at]) * self.weights
                rows = np.broadcast_to(np.arange(len(part))[:, None] + first, at.shape)
                np.add.at(out, (rows, np.maximum(self.feature[at], 0)), change)
        return out


def memory_values(recent: np.ndarray) -> dict[str, np.ndarray]:
    """Lag and rolling features of the next step, for rows of newest values; a missing one is 0."""
    out = {f"lag_{k}": np.nan_to_num(recent[:, -k]) for k in LAGS}
    for w in ROLLING:
        window = recent[:, -w:]
        known = ~np.isnan(window)
        n, filled = known.sum(axis=1), np.where(known, window, 0.0)
        total, squares = filled.sum(axis=1), (filled * filled).sum(axis=1)
        mean = total / np.maximum(n, 1)
        out[f"rolling_mean_{w}"] = mean
        out[f"rolling_std_{w}"] = np.sqrt(np.maximum(squares - total * mean, 0.0) / np.maximum(n - 1, 1))
        out[f"rolling_min_{w}"] = np.where(n > 0, np.where(known, window, np.inf).min(axis=1), 0.0)
        out[f"rolling_max_{w}"] = np.where(n > 0, np.where(known, window, -np.inf).max(axis=1), 0.0)
    return out


class Boosted:
    """Boosted trees with a recursive multi-step forecast; trained on the pooled panel."""

    pooled = True

    def __init__(self, n_estimators: int = 200, learning_rate: float = 0.05, max_depth: int = 5, num_leaves: int | None = None,
                 min_child_samples: int = 20, subsample: float = 1.0, colsample: float = 1.0, non_negative: bool = True,
                 scale: str = "mean", seed: int = 42, name: str = "lightgbm", parallel: int = PARALLEL,
                 only: tuple[str, ...] | None = None) -> None:
        self.n_estimators, self.learning_rate = n_estimators, learning_rate
        # the trees grow by level, so a leaf limit becomes a depth limit
        depth = max_depth if max_depth > 0 else 10
        self.depth = min(depth, math.ceil(math.log2(num_leaves))) if num_leaves else depth
        self.min_child_samples, self.subsample, self.colsample = min_child_samples, subsample, colsample
        self.non_negative, self.scale, self.seed, self.name = non_negative, scale, seed, name
        self.parallel, self.only = max(1, parallel), only  # only: these features and no others
        self.trees: Trees | None = None
        self.features: list[str] = []

    def _level(self) -> Column:
        level = F.avg("y") if self.scale == "mean" else F.stddev_pop("y")
        return F.when(F.abs(level) > 1e-9, F.abs(level)).otherwise(1.0)

    def training_rows(self, panel: DataFrame, factors: Factors | None = None) -> DataFrame:
        """Feature rows with the scaled target; rows without all lags are dropped."""
        levels = panel.groupBy("series_id").agg(self._level().alias("level"))
        scaled = panel.join(levels, "series_id").withColumn("y", F.col("y") / F.col("level")).select("series_id", "ds", "y")
        rows = calendar_features(rolling_features(lag_features(scaled))).drop("dayofyear")
        if factors:
            rows = attach_factors(rows, factors)
        return rows.dropna()

    def fit(self, panel: DataFrame, factors: Factors | None = None) -> DataFrame:
        rows = self.training_rows(panel, factors)
        self.features = [c for c in rows.columns if c not in ("series_id", "ds", "y") and (self.only is None or c in self.only)]
        vector = VectorAssembler(inputCols=self.features, outputCol="features")
        table = materialize(vector.transform(rows.select(*[F.col(c).cast("double").alias(c) for c in self.features], "y")).select("features", "y"))
        n, base = table.agg(F.count(F.lit(1)), F.avg("y")).first()
        if n < LEAST_ROWS:
            raise TooLittleData(f"boosted trees need {LEAST_ROWS} rows with all lags")
        # every level of a stage is a pass over these rows, so small panels get few tasks
        rest = table.coalesce(math.ceil(n / ROWS_PER_TASK)).withColumn("rest", F.col("y") - F.lit(base)).drop("y").persist()
        spark, nodes, done = panel.sparkSession, [], 0
        writer = ThreadPoolExecutor(1)  # a stage's nodes are read while the next one grows
        while done < self.n_estimators:
            size = min(self.parallel, self.n_estimators - done)
            share = 1 - (1 - self.learning_rate) ** size
            model = self._stage(size, done).fit(rest)
            nodes.append(writer.submit(_node_rows, spark, model, done, share / size))
            done += size
            if done < self.n_estimators:
                before, rest = rest, model.transform(rest).select("features", (F.col("rest") - share * F.col("prediction")).alias("rest")).persist()
                rest.count()
                before.unpersist()
        rest.unpersist()
        self.trees = Trees.of(pd.concat([n.result() for n in nodes], ignore_index=True), float(base))
        writer.shutdown()
        return self.state(panel)

    def _stage(self, size: int, number: int) -> RandomForestRegressor:
        """Trees of a stage; a single one without sampling sees all rows."""
        alone = size == 1 and self.subsample >= 1.0
        return RandomForestRegressor(
            labelCol="rest", numTrees=size, maxDepth=self.depth, minInstancesPerNode=self.min_child_samples,
            bootstrap=not alone, subsamplingRate=self.subsample, maxMemoryInMB=1024, seed=self.seed + number,
            featureSubsetStrategy="all" if self.colsample >= 1.0 else str(self.colsample), cacheNodeIds=False,
        )

    def state(self, panel: DataFrame) -> DataFrame:
        """Level, last date and newest scaled values per series: all a forecast needs."""
        newest = Window.partitionBy("series_id").orderBy(F.desc("ds"))
        aged = panel.withColumn("age", F.row_number().over(newest))
        kept = F.array_sort(F.collect_list(F.when(F.col("age") <= MEMORY, F.struct("ds", "y"))))
        out = aged.groupBy("series_id").agg(F.max("ds").alias("last_ds"), self._level().alias("level"), kept.alias("rows"))
        return out.select("series_id", "last_ds", "level", F.transform("rows", lambda r: r["y"] / F.col("level")).alias("recent"))

    def tree_table(self, spark: SparkSession) -> DataFrame:
        """The node table (``NODES``), which can be stored; ``restored`` takes it back."""
        t = self._fitted()
        tree = np.searchsorted(t.roots, np.arange(len(t.feature)), "right") - 1
        start = t.roots[tree]
        nodes = pd.DataFrame({
            "tree": tree, "node": np.arange(len(tree)) - start, "feature": t.feature, "threshold": t.threshold,
            "left": np.where(t.feature < 0, -1, t.left - start), "right": np.where(t.feature < 0, -1, t.right - start),
            "value": t.value, "gain": t.gain, "weight": t.weights[tree],
        })
        return spark.createDataFrame(nodes, NODES)

    def restored(self, nodes: DataFrame, features: list[str], base: float) -> Boosted:
        self.trees, self.features = Trees.of(nodes.toPandas(), base), list(features)
        return self

    def _fitted(self) -> Trees:
        if self.trees is None:
            raise ValueError("the model is not fitted")
        return self.trees

    def _future(self, fitted: DataFrame, horizon: int, freq: str, factors: Factors | None) -> tuple[DataFrame, list[str]]:
        """Fitted rows with ``future``: date, calendar and factor values of all steps, one array per series."""
        outside = [c for c in self.features if c not in CALENDAR and not c.startswith(("lag_", "rolling_"))]
        dated = calendar_features(steps(fitted.select("series_id", "last_ds"), horizon, freq))
        known: list[str] = []
        if factors and outside:
            wide = wide_factors(factors)
            known = [c for c in outside if c in wide.columns]
            dated = dated.join(wide.select("ds", *known), "ds", "left")
        given = [c for c in self.features if c in CALENDAR] + outside
        values = [F.coalesce(F.col(c) if c in CALENDAR or c in known else F.lit(0.0), F.lit(0.0)).cast("double") for c in given]
        listed = F.array_sort(F.collect_list(F.struct("step", "ds", F.array(*values).cast("array<double>").alias("x"))))
        return fitted.join(dated.groupBy("series_id").agg(listed.alias("future")), "series_id"), given

    def _walked(self, fitted: DataFrame, horizon: int, freq: str, factors: Factors | None, explain: bool) -> DataFrame:
        """``series_id, level, future, values`` and, if asked for, the contributions of all steps."""
        trees, features, non_negative = self._fitted(), self.features, self.non_negative
        rows, given = self._future(fitted, horizon, freq, factors)
        place = {c: i for i, c in enumerate(features)}
        memory = [c for c in features if c not in given]

        def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if frame.empty:
                    continue
                recent = np.full((len(frame), MEMORY), np.nan)
                for i, values in enumerate(frame["recent"]):
                    own = np.asarray(values, float)[-MEMORY:]
                    recent[i, MEMORY - len(own) :] = own
                future = np.array([[*map(list, row)] for row in frame["x"]], dtype=float).reshape(len(frame), horizon, len(given))
                out, parts = np.empty((len(frame), horizon)), []
                x = np.zeros((len(frame), len(features)))
                for step in range(horizon):
                    x[:, [place[c] for c in given]] = future[:, step]
                    known = memory_values(recent) if memory else {}
                    for c in memory:
                        x[:, place[c]] = known[c]
                    value = trees.predict(x)
                    if explain:
                        parts.append(trees.contributions(x))
                    value = np.maximum(value, 0.0) if non_negative else value
                    out[:, step] = value
                    recent = np.column_stack([recent[:, 1:], value])
                done = pd.DataFrame({"series_id": frame["series_id"], "last_ds": frame["last_ds"], "level": frame["level"], "dss": frame["dss"], "values": list(out)})
                if explain:
                    done["parts"] = list(np.stack(parts, axis=1).reshape(len(frame), -1))
                yield done

        schema = "series_id string, last_ds date, level double, dss array<date>, values array<double>" + (", parts array<double>" if explain else "")
        table = rows.select("series_id", "last_ds", "level", F.col("recent").cast("array<double>").alias("recent"), F.col("future")["ds"].alias("dss"), F.col("future")["x"].alias("x"))
        return table.mapInPandas(walk, schema)

    def forecast(
        self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None
    ) -> DataFrame:
        """All steps of all series in one pass; each step's value joins the memory of the next."""
        done = self._walked(fitted, horizon, freq, factors, explain=False)
        rows = done.select("series_id", "level", F.posexplode(F.arrays_zip("dss", "values")).alias("pos", "r"))
        dated = rows.select("series_id", "level", (F.col("pos") + 1).alias("step"), F.col("r.dss").alias("ds"), F.col("r.values").alias("value"))
        return banded(dated, F.col("value") * F.col("level"), None, 0.15, self.non_negative)

    def contributions(self, fitted: DataFrame, horizon: int, freq: str = "D", factors: Factors | None = None) -> DataFrame:
        """What each feature adds to the ensemble's mean, per series and step, in units of the series.

        A split's part is the change of the node value on the decision path. They add up to the
        forecast less the mean, where no value was raised to zero.
        """
        width = len(self.features)
        done = self._walked(fitted, horizon, freq, factors, explain=True)
        rows = done.select("series_id", "level", F.posexplode("parts").alias("pos", "part"))
        names = F.array(*[F.lit(c) for c in self.features])
        return rows.select(
            "series_id", (F.floor(F.col("pos") / width) + 1).cast("int").alias("step"),
            F.get(names, F.col("pos") % width).alias("feature"), (F.col("part") * F.col("level")).alias("contribution"),
        )

    def importance(self, spark: SparkSession, k: int = 20) -> DataFrame:
        """Features by the gain of their splits over all rows, as shares of the largest."""
        t = self._fitted()
        weight = np.repeat(t.weights, np.diff([*t.roots, len(t.feature)]))
        total = np.bincount(t.feature[t.feature >= 0], (t.gain * weight)[t.feature >= 0], len(self.features))
        gains = [(n, float(v)) for n, v in zip(self.features, total, strict=True) if v > 0]
        top = sorted(gains, key=lambda g: (-g[1], g[0]))[:k]
        largest = top[0][1] if top else 1.0
        return spark.createDataFrame([(n, v, v / largest * 100) for n, v in top], "feature string, importance double, pct double")


def _node_rows(spark: SparkSession, model: RandomForestRegressionModel, first: int, weight: float) -> pd.DataFrame:
    """A stage's nodes, read from the stored form of the model: a table of bounded size."""
    path = scratch_path(spark, "trees")
    model.save(path)
    node, split = "nodeData.", "nodeData.split."
    rows = spark.read.parquet(f"{path}/data").select(
        (F.col("treeID") + first).alias("tree"), F.col(node + "id").alias("node"), F.col(split + "featureIndex").alias("feature"),
        F.get(split + "leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col(node + "leftChild").alias("left"),
        F.col(node + "rightChild").alias("right"), F.col(node + "prediction").alias("value"),
        (F.greatest(node + "gain", F.lit(0.0)) * F.col(node + "rawCount")).alias("gain"), F.lit(weight).alias("weight"),
    )
    out = rows.toPandas()
    out["feature"] = np.where(out["left"] < 0, -1, out["feature"])
    out["threshold"] = out["threshold"].fillna(0.0)
    return out


def boosted_rows(n_estimators: int = 200, learning_rate: float = 0.05, max_depth: int = 5, min_child_weight: int = 1,
                 subsample: float = 0.9, colsample_bytree: float = 0.9, **more) -> Boosted:
    """The variant that samples rows and columns for each tree."""
    return Boosted(n_estimators, learning_rate, max_depth, None, min_child_weight, subsample, colsample_bytree,
                   name=more.pop("name", "xgboost"), **more)
