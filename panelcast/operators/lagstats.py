"""Moments of lagged values, summed inside Spark; regressions on lags need nothing else.

A series is one row of arrays. Products with lagged copies are folded over the arrays; what
leaves Spark's expressions is a table of moments whose size depends on the number of lags alone, and the
small linear system that it makes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def span(first: Column, count: Column) -> Column:
    """``first, first + 1, ...``, ``count`` numbers; none if it isn't positive."""
    return F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(F.array().cast("array<int>"))


def filtered(values: Column, weights: Column) -> Column:
    """``sum of weights[k] * values[t - k]`` for every t that has all its earlier values."""
    lost = F.size(weights) - 1

    def at(t: Column) -> Column:
        terms = F.transform(weights, lambda w, k: w * F.get(values, t - k))
        return total(terms)

    return F.transform(span(lost, F.size(values) - lost), at)


def lagged(values: Column, lag: Column, start: Column) -> Column:
    """``values[t - lag]`` for t from ``start`` on."""
    return F.slice(values, start - lag + 1, F.greatest(F.size(values) - start, F.lit(0)))


def lag_moments(values: Column, most: Column) -> Column:
    """What ``lag_gram`` needs: products of the values from ``most`` on with their 0 to ``most`` steps
    earlier ones, sums, and the values at both ends."""
    n = F.size(values)
    now = lagged(values, F.lit(0), most)
    lags = F.sequence(F.lit(0), most)
    return F.struct(
        F.transform(lags, lambda k: dot(now, lagged(values, k, most))).alias("products"),
        F.transform(lags, lambda k: total(lagged(values, k, most))).alias("sums"),
        F.slice(values, F.lit(1), most).alias("head"),
        F.slice(values, F.greatest(n - most, F.lit(0)) + 1, most).alias("tail"),
        F.greatest(n - most, F.lit(0)).alias("rows"),
    )


def lag_gram(moments) -> np.ndarray:
    """``sum over t >= most of v[t - i] * v[t - j]`` for all i and j up to ``most``.

    Both factors move together along a diagonal, so an entry is the one before it with the products
    at both ends exchanged.
    """
    products, head, tail = (np.asarray(moments[c], float) for c in ("products", "head", "tail"))
    most = len(products) - 1
    out = np.empty((most + 1, most + 1))
    out[0] = out[:, 0] = products
    end = len(tail)
    for i in range(1, most + 1):
        for j in range(i, most + 1):
            gained = head[most - i] * head[most - j]
            out[i, j] = out[j, i] = out[i - 1, j - 1] + gained - tail[end - i] * tail[end - j]
    return out
