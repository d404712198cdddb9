"""Profiles of series: frequency, trend, seasonality, outliers, autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import (
    MODEL_LADDER, PATTERN_LADDER, VALIDATION_LADDER, frequency_by_gap,
)
from ..functions.scalars import clamp, correlation, ratio
from ..models.base import as_arrays, per_row
from .grid import along
from .lagstats import dot, filtered, lag_gram, lag_moments, lagged, total


def gap_stats(panel: DataFrame) -> DataFrame:
    """Median and most common gap in days between the dates of each series."""
    dates = panel.select("series_id", "ds").distinct()
    gaps = dates.withColumn("gap", F.datediff("ds", F.lag("ds").over(along())))
    return gaps.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("dates"),
        F.median("gap").alias("median_gap"),
        F.mode("gap", deterministic=True).alias("common_gap"),
    )


def frequencies(panel: DataFrame) -> DataFrame:
    """All frequency labels of each series, one per ladder in use."""
    gap = F.col("median_gap")
    enough = F.col("dates") >= 3
    whole_gap = F.floor(gap)
    cycle = F.when(whole_gap <= 1, 7).when(whole_gap <= 7, 52).when(whole_gap <= 31, 12)
    common = F.when(F.col("common_gap") == 1, "D").otherwise(F.concat("common_gap", F.lit("D")))
    return gap_stats(panel).select(
        "series_id",
        F.when(enough, frequency_by_gap(gap, VALIDATION_LADDER, "Y")).alias("validation"),
        F.when(enough, frequency_by_gap(gap, PATTERN_LADDER, "YS")).alias("pattern"),
        F.when(enough, common).otherwise("D").alias("common"),
        F.coalesce(frequency_by_gap(gap, MODEL_LADDER, "D"), F.lit("D")).alias("model"),
        F.when(F.col("dates") >= 14, cycle).alias("season_length"),
    )


def indexed(panel: DataFrame, *lags: int, value: str = "y") -> DataFrame:
    """Position and lagged values of each row; one sort serves all of them."""
    return panel.withColumns(
        {"idx": F.row_number().over(along()) - 1}
        | {f"{value}_lag_{k}": F.lag(value, k).over(along()) for k in lags}
    )


def trend_class(slope: Column, mean: Column, n: Column) -> Column:
    share = F.coalesce(ratio(slope, mean) * 100, F.lit(0.0))
    return (
        F.when(n < 10, "unknown").when(share > 1, "increasing").when(share < -1, "decreasing").otherwise("stable")
    )


def season_class(n: Column, ac7: Column, ac30: Column, ac365: Column) -> Column:
    return (
        F.when(n < 14, "none")
        .when(F.abs(ac7) > 0.5, "weekly")
        .when((n > 30) & (F.abs(ac30) > 0.5), "monthly")
        .when((n > 365) & (F.abs(ac365) > 0.5), "yearly")
        .otherwise("none")
    )


def characteristics(panel: DataFrame) -> DataFrame:
    """Length, moments, trend and seasonality class and outlier share per series.

    Windows and the final group-by share one exchange on the series key.
    """
    whole = Window.partitionBy("series_id")
    counted = panel.withColumn("missing", F.avg(F.col("y").isNull().cast("double")).over(whole) * 100)
    known = counted.filter(F.col("y").isNotNull())
    cut = indexed(known, 7, 30, 365).withColumn("cut", F.percentile("y", [0.25, 0.75]).over(whole))
    stats = cut.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("length"),
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("std"),
        F.max("missing").alias("missing_pct"),
        F.min("ds").alias("min_date"),
        F.max("ds").alias("max_date"),
        F.regr_slope("y", "idx").alias("slope"),
        correlation("y", "y_lag_7").alias("ac7"),
        correlation("y", "y_lag_30").alias("ac30"),
        correlation("y", "y_lag_365").alias("ac365"),
        _outliers(),
    )
    n = F.col("length")
    return stats.select(
        "series_id", "length", "mean", "std",
        ratio("std", "mean", 0.0).alias("cv"),
        "missing_pct", "min_date", "max_date", "slope",
        trend_class(F.col("slope"), F.col("mean"), n).alias("trend"),
        season_class(n, F.col("ac7"), F.col("ac30"), F.col("ac365")).alias("seasonality"),
        "outliers_pct",
    )


def _outliers() -> Column:
    """Aggregate over rows with their quartiles in ``cut``."""
    q1, q3 = F.col("cut")[0], F.col("cut")[1]
    spread = q3 - q1
    outside = (F.col("y") < q1 - 1.5 * spread) | (F.col("y") > q3 + 1.5 * spread)
    usable = (F.count(F.lit(1)) >= 4) & (F.max(spread) != 0)
    return F.when(usable, F.count_if(outside) / F.count(F.lit(1)) * 100).otherwise(0.0).alias("outliers_pct")


def outlier_share(panel: DataFrame) -> DataFrame:
    """Percent of rows beyond 1.5 interquartile ranges; 0 for tiny or flat series."""
    cut = F.percentile("y", [0.25, 0.75]).over(Window.partitionBy("series_id"))
    return panel.withColumn("cut", cut).groupBy("series_id").agg(_outliers())


# --- stationarity ------------------------------------------------------------------------


def _unit_root(row: pd.Series, fixed: bool) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller t statistic with constant, 5 % point and lag by AIC, from lag moments.

    The 5 % point is MacKinnon's (2010) response surface for the constant-only case.
    """
    moments, most = row["moments"], len(row["moments"]["products"]) - 1
    head, level_head = np.asarray(moments["head"], float), np.asarray(row["level_head"], float)
    rows, sums = moments["rows"], np.asarray(moments["sums"], float)
    # order of the columns: change, level, constant, changes 1 to most rows before
    gram = np.empty((most + 3, most + 3))
    changes = [0, *range(3, most + 3)]
    gram[np.ix_(changes, changes)] = lag_gram(moments)
    gram[1, changes] = gram[changes, 1] = np.asarray(row["level_products"], float)
    gram[2, changes] = gram[changes, 2] = sums
    gram[1, 1], gram[1, 2], gram[2, 1], gram[2, 2] = row["level_squares"], row["level_sum"], row["level_sum"], rows

    def solved(matrix: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, float]:
        x = matrix[1 : lags + 3, 1 : lags + 3]
        coef = np.linalg.lstsq(x, matrix[1 : lags + 3, 0], rcond=None)[0]
        return x, coef, float(max(matrix[0, 0] - 2 * coef @ matrix[1 : lags + 3, 0] + coef @ x @ coef, 0.0))

    lags = most
    if not fixed:  # the same rows for every lag, so that the criteria are comparable
        criteria = [rows * np.log(max(solved(gram, k)[2], 1e-300) / rows) + 2 * (k + 2) for k in range(most + 1)]
        lags = int(np.argmin(criteria))
    for s in range(lags, most):  # rows that the chosen lags have and the most lags don't
        line = np.zeros(most + 3)
        line[[0, 1, 2]] = head[s], level_head[s], 1.0
        line[3 : lags + 3] = head[s - lags : s][::-1]
        gram += np.outer(line, line)
    used = rows + most - lags
    x, coef, rss = solved(gram, lags)
    spread = rss / max(1, used - lags - 2)
    error = np.sqrt(max(spread * np.linalg.pinv(x)[0, 0], 0.0))
    t = float(coef[0] / error) if error > 0 else 0.0
    return t, -2.86154 - 2.8903 / used - 4.234 / used**2 - 40.04 / used**3, lags


def stationarity(panel: DataFrame, lags: int | None = None) -> DataFrame:
    """Whether each series passes the unit-root test; true below 30 rows.

    ``lags`` sets the number of lagged changes, else the information criterion does. All sums over a
    series are taken in Spark; the test sees its lag moments.
    """
    n = F.size("ys")
    most = F.least(F.ceil(12 * F.pow(n / 100, 0.25)).cast("int"), F.floor(n / 2).cast("int") - 2) if lags is None else F.lit(lags)
    arrays = as_arrays(panel).select("series_id", "ys", F.when(n >= 30, most).alias("most"))
    level = arrays.withColumn("mean", total(F.col("ys")) / n)
    centred = level.select("series_id", "most", F.transform("ys", lambda v: v - F.col("mean")).alias("ys"), F.size("ys").alias("n"))
    moved = centred.withColumn("changes", filtered(F.col("ys"), F.array(F.lit(1.0), F.lit(-1.0))))
    before = F.slice("ys", F.col("most") + 1, F.greatest(F.col("n") - 1 - F.col("most"), F.lit(0)))
    sums = moved.filter(F.col("most").isNotNull()).withColumn("before", before).select(
        "series_id", lag_moments(F.col("changes"), F.col("most")).alias("moments"),
        F.transform(F.sequence(F.lit(0), F.col("most")), lambda k: dot(F.col("before"), lagged(F.col("changes"), k, F.col("most")))).alias("level_products"),
        total(F.col("before")).alias("level_sum"), dot(F.col("before"), F.col("before")).alias("level_squares"), F.slice("ys", F.lit(1), F.col("most")).alias("level_head"),
    )

    def test(row: pd.Series) -> dict:
        statistic, critical, used = _unit_root(row, lags is not None)
        return {"statistic": statistic, "critical": critical, "lags": used, "stationary": bool(statistic < critical)}

    schema = "series_id string, statistic double, critical double, lags int, stationary boolean"
    tested = per_row(sums, schema, test, ("series_id",))
    short = moved.filter(F.col("most").isNull()).select(
        "series_id", *[F.lit(None).cast(t).alias(c) for c, t in (("statistic", "double"), ("critical", "double"), ("lags", "int"))], F.lit(True).alias("stationary")
    )
    return tested.unionByName(short)


# --- autocorrelation ---------------------------------------------------------------------


def lag_pairs(panel: DataFrame, max_lag: int, value: str = "y") -> DataFrame:
    """Each row once per lag with its value ``a`` and the earlier one ``b``.

    The rows of a series are already together, so the copies are folded into one row per
    series and lag before anything is shuffled again.
    """
    lagged = indexed(panel, *range(1, max_lag + 1), value=value)
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"{value}_lag_{k}").alias("b")) for k in range(1, max_lag + 1)])
    return lagged.select("series_id", F.col(value).alias("a"), F.explode(pairs).alias("p")).select("series_id", "p.lag", "a", "p.b")


def autocorrelation(panel: DataFrame, max_lag: int = 20, value: str = "y") -> DataFrame:
    """Sample autocorrelation per series and lag 1..max_lag."""
    whole = Window.partitionBy("series_id")
    centred = panel.withColumns({"c": F.col(value) - F.avg(value).over(whole)})
    sums = lag_pairs(centred, max_lag, "c").groupBy("series_id", "lag").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("a") * F.col("a")).alias("v"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("s"),
    )
    return sums.select("series_id", "n", "lag", ratio("s", "v", 0.0).alias("acf"))


def lag_correlation(panel: DataFrame, max_lag: int = 30) -> DataFrame:
    """Pearson correlation of each series with itself, per lag."""
    return lag_pairs(panel, max_lag).groupBy("series_id", "lag").agg(
        F.count(F.lit(1)).alias("n"), correlation("a", "b").alias("acf")
    )


def _partial(acf: Sequence[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations by the Durbin-Levinson recursion."""
    out: list[float] = []
    phi = np.zeros(0)
    for k, r in enumerate(acf):
        known = np.asarray(acf[:k])
        scale = 1.0 - phi @ known if k else 1.0
        last = (r - phi @ known[::-1]) / scale if abs(scale) > 1e-10 else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return out


def partial_autocorrelation(panel: DataFrame, max_lag: int = 20) -> DataFrame:
    """ACF and PACF per series and lag; the recursion sees one short array per series."""
    acf = autocorrelation(panel, max_lag)
    arrays = acf.groupBy("series_id").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("p")
    ).select("series_id", "n", F.col("p")["acf"].alias("acf"))
    solved = per_row(
        arrays, "series_id string, n long, acf array<double>, pacf array<double>",
        lambda row: {"pacf": _partial(row["acf"])}, ("series_id", "n", "acf"),
    )
    zipped = F.explode(F.arrays_zip("acf", "pacf", F.sequence(F.lit(1), F.size("acf")).alias("lag")))
    return solved.select("series_id", "n", zipped.alias("p")).select(
        "series_id", "n", F.col("p.lag").cast("int").alias("lag"), "p.acf", "p.pacf"
    )


def arima_orders(panel: DataFrame, max_lag: int = 20) -> DataFrame:
    """Suggested p, d, q and seasonal order per series.

    p and q are the last lags whose PACF and ACF exceed 2/sqrt(n), at most 5.
    """
    tested = stationarity(panel)
    marked = panel.join(tested.select("series_id", "stationary"), "series_id")
    change = F.col("y") - F.lag("y").over(along())
    # non-stationary series are judged on their differences
    working = marked.withColumn("y", F.when(F.col("stationary"), F.col("y")).otherwise(change)).filter("y is not null")
    lags = partial_autocorrelation(working.select("series_id", "ds", "y"), max_lag)
    seen = F.col("lag") <= F.least(F.lit(max_lag), F.floor(F.col("n") / 3)) - 1
    strong = 2 / F.sqrt("n")
    sig = lags.groupBy("series_id").agg(
        F.max("n").alias("n"),
        F.max(F.when(seen & (F.abs("pacf") > strong), F.col("lag"))).alias("p"),
        F.max(F.when(seen & (F.abs("acf") > strong), F.col("lag"))).alias("q"),
    )
    seasons = characteristics(panel).select("series_id", "seasonality", "length")
    d = F.when(F.col("stationary"), 0).otherwise(1)
    period = F.when(F.col("seasonality") == "weekly", 7).when(F.col("seasonality") == "monthly", 30).when(
        F.col("seasonality") == "yearly", 365)
    short = F.col("n") < 14
    p = F.when(short, 1).otherwise(F.greatest(F.least(F.coalesce("p", F.lit(0)), F.lit(5)), d))
    q = F.when(short, 1).otherwise(F.least(F.coalesce(F.col("q"), 1 - d), F.lit(5)))
    return (
        sig.join(tested.select("series_id", "stationary"), "series_id")
        .join(seasons, "series_id")
        .select(
            "series_id", p.cast("int").alias("p"), d.alias("d"), q.cast("int").alias("q"),
            F.when(F.col("length") >= 30, period).alias("season"),
            F.when(F.col("length") >= 30, F.when(period.isNotNull(), d)).alias("seasonal_d"),
        )
    )


# --- pattern profile ------------------------------------------------------------------------

# Seasonal periods tried for each frequency of the pattern ladder.
SEASON_CANDIDATES = {"D": [7, 14, 30, 365], "W": [4, 13, 52], "MS": [6, 12], "QS": [6, 12]}
OTHER_CANDIDATES = [4]


def season_strength(panel: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """Best seasonal period per series by autocorrelation of the differences."""
    frequency = frequencies(panel).select("series_id", "pattern") if frequency is None else frequency
    periods = sorted({p for ps in [*SEASON_CANDIDATES.values(), OTHER_CANDIDATES] for p in ps})
    moved = panel.withColumn("d", F.col("y") - F.lag("y").over(along())).withColumn(
        "idx", F.row_number().over(along()) - 1
    )
    changes = moved.filter(F.col("d").isNotNull())
    lagged = indexed(changes, *periods, value="d")
    sums = lagged.groupBy("series_id").agg(
        (F.count(F.lit(1)) + 1).alias("n"),
        *[correlation("d", f"d_lag_{k}").alias(f"r{k}") for k in periods],
    )
    tried = F.lit(None).cast("array<int>")
    for label, options in SEASON_CANDIDATES.items():
        tried = F.when(F.col("pattern") == label, F.array(*map(F.lit, options))).otherwise(tried)
    tried = F.coalesce(tried, F.array(*map(F.lit, OTHER_CANDIDATES)))
    scored = F.array(*[F.struct(F.col(f"r{k}").alias("strength"), F.lit(k).alias("period")) for k in periods])
    n = F.col("n")
    usable = F.filter(
        scored,
        lambda s: F.array_contains(tried, s.period) & (n >= s.period * 2) & (n - 1 >= s.period + 5)
        & (s.strength > 0) & (n >= 14),
    )
    best = F.array_max(usable)
    return sums.join(frequency, "series_id").select(
        "series_id", best["period"].alias("seasonal_period"),
        F.coalesce(best["strength"], F.lit(0.0)).alias("seasonal_strength"),
    )


def linear_trend(panel: DataFrame) -> DataFrame:
    """Linear trend where it explains more than a fifth of the variance."""
    stats = indexed(panel, 1).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "idx").alias("slope"),
        F.coalesce(F.regr_r2("y", "idx"), F.lit(0.0)).alias("r2"),
        F.coalesce(correlation("y", "y_lag_1"), F.lit(0.0)).alias("ac1"),
    )
    linear = (F.col("n") >= 5) & (F.col("r2") > 0.2)
    kind = F.when(linear, "linear").when((F.col("n") >= 5) & (F.abs("ac1") < 0.05), "none").otherwise("unknown")
    return stats.select(
        "series_id", kind.alias("trend_type"),
        F.when(linear, F.col("r2")).otherwise(0.0).alias("trend_strength"),
        F.when(linear, F.col("slope")).otherwise(0.0).alias("trend_slope"),
    )


def memory_signature(panel: DataFrame) -> DataFrame:
    """Significant lags and autoregressive / moving-average flags."""
    lags = lag_correlation(panel, 30)
    n = F.col("n")
    seen = F.col("lag") <= F.least(F.lit(30), F.floor(n / 3))
    threshold = 1.96 / F.sqrt("n")
    strong = seen & (F.abs("acf") > threshold)
    first_three = F.sum(F.when(seen & (F.col("lag") <= 3), F.abs("acf"))) / 3
    rows = F.max("n")
    return lags.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.when(strong, F.col("lag")))).alias("acf_peaks"),
        F.when((rows >= 12), F.coalesce(first_three > 2 * F.max(threshold), F.lit(False))).otherwise(False).alias("has_ar"),
        F.when((rows >= 10), F.count_if(strong) <= 2).otherwise(False).alias("has_ma"),
    )


def pattern_profile(panel: DataFrame) -> DataFrame:
    """One row per series with everything the model router needs."""
    stats = panel.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.countDistinct("ds").alias("n_unique_dates"),
        F.avg((F.col("y") == 0).cast("double")).alias("sparsity"),
        F.var_samp("y").alias("variance"),
        ratio(F.stddev_samp("y"), F.avg("y"), 0.0).alias("cv"),
    )
    frequency = frequencies(panel).select("series_id", F.col("pattern"))
    return (
        stats.join(frequency.withColumnRenamed("pattern", "frequency"), "series_id")
        .join(season_strength(panel, frequency), "series_id", "left")
        .join(linear_trend(panel), "series_id")
        .join(memory_signature(panel), "series_id")
        .fillna(0.0, ["seasonal_strength"])
    )


# --- insights and recommendations --------------------------------------------------------


def insights(chars: DataFrame) -> DataFrame:
    """One row per remark on a series."""

    def note(kind: str, text: Column | str) -> Column:
        return F.struct(F.lit(kind).alias("type"), (F.lit(text) if isinstance(text, str) else text).alias("text"))

    def percent(value: Column) -> Column:
        return F.format_string("%.1f%%", F.round(value, 1))

    cv, season, trend = F.col("cv"), F.col("seasonality"), F.col("trend")
    span = F.concat(F.lit("Data spans "), F.date_format("min_date", "yyyy-MM-dd"), F.lit(" to "),
                    F.date_format("max_date", "yyyy-MM-dd"), F.lit(" ("), F.col("length").cast("string"),
                    F.lit(" observations)."))
    remarks = F.array(
        note("info", span),
        F.when(trend == "increasing", note("info", "Upward trend: use models with a trend component."))
        .when(trend == "decreasing", note("warning", "Downward trend: look for causes; damped trends may help."))
        .otherwise(note("info", "No strong trend: simple models will do.")),
        F.when(season != "none", note("info", F.concat(F.lit("Clear "), season, F.lit(" seasonality: use seasonal models."))))
        .otherwise(note("info", "No strong seasonality: non-seasonal models may do.")),
        F.when(cv > 0.5, note("warning", F.concat(F.lit("High volatility (CV="), percent(cv * 100), F.lit("): boosted trees cope better."))))
        .when(cv < 0.2, note("info", F.concat(F.lit("Low volatility (CV="), percent(cv * 100), F.lit("): simple methods work well.")))),
        F.when(F.col("outliers_pct") > 5, note("warning", F.concat(percent(F.col("outliers_pct")), F.lit(" outliers: use robust models or clean the data.")))),
        F.when(F.col("missing_pct") > 0, note("warning", F.concat(percent(F.col("missing_pct")), F.lit(" of the values are missing and were filled.")))),
    )
    return chars.select("series_id", F.posexplode(remarks).alias("pos", "r")).filter("r is not null").select(
        "series_id", (F.col("pos") + 1).alias("no"), "r.type", "r.text"
    )


def recommend(chars: DataFrame, has_external: bool = False, stage: str | None = None, k: int = 5) -> DataFrame:
    """Models by rule scores. ``chars`` also needs the ``stationary`` column."""
    n, cv = F.col("length"), F.col("cv")
    ml, decline = stage in ("hyper_growth", "volatile"), stage == "declining"
    stable, seasonal_stage = stage in ("mature", "growth"), stage == "seasonal"
    seasonal = (F.col("seasonality") != "none") | F.lit(seasonal_stage)
    short = n < 14
    volatile = (cv > 0.5) | F.lit(ml)
    top = 0.90 if ml else 0.88
    # Condition, model and score of each rule, in the order of preference.
    rules = [
        (short, "wma", 0.9), (short, "theta", 0.85), (short, "ets", 0.8),
        (~short & volatile, "lightgbm", top), (~short & volatile, "xgboost", top - 0.03),
        (~short & ~volatile & (cv < 0.2), "wma", 0.82), (~short & ~volatile & (cv < 0.2), "ets", 0.80),
        (~short & seasonal, "prophet", 0.92), (~short & seasonal, "sarimax", 0.85),
        (~short & seasonal, "stl", 0.82), (~short & seasonal, "theta", 0.78),
        (~short & F.col("stationary") & F.lit(not decline), "arima", 0.78),
        (~short & F.lit(decline), "arima", 0.82),
        (~short & F.lit(has_external), "prophet", 0.9), (~short & F.lit(has_external), "lightgbm", 0.87),
        (~short & F.lit(has_external), "xgboost", 0.85),
        (~short & F.lit(ml), "prophet", 0.88), (~short & F.lit(stable), "ets", 0.85),
        (~short & (F.col("outliers_pct") > 5), "prophet", 0.83), (~short & (F.col("outliers_pct") > 5), "stl", 0.80),
        (~short, "theta", 0.7),
    ]
    options = F.array(*[
        F.when(cond, F.struct(F.lit(model).alias("model"), F.lit(round(score, 4)).alias("score"), F.lit(i).alias("rule")))
        for i, (cond, model, score) in enumerate(rules)
    ])
    rows = chars.select("series_id", F.explode(options).alias("o")).filter("o is not null").select("series_id", "o.*")
    best = rows.groupBy("series_id", "model").agg(
        F.max("score").alias("score"), F.min_by("rule", F.struct(-F.col("score"), F.col("rule"))).alias("rule")
    )
    order = Window.partitionBy("series_id").orderBy(F.desc("score"), "rule")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rule")


def recommend_from_cv(chars: DataFrame, cv_metrics: DataFrame, k: int = 8) -> DataFrame:
    """Models by cross-validated MAE relative to the mean of the series."""
    mean = F.when(F.col("mean") != 0, F.col("mean")).otherwise(1.0)
    scored = (
        cv_metrics.filter(F.col("mae") > 0)
        .join(chars.select("series_id", "mean"), "series_id")
        .withColumn("score", F.round(clamp(1 - F.col("mae") / mean, 0.5, 0.98), 4))
    )
    order = Window.partitionBy("series_id").orderBy(F.desc("score"), "mae", "model")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "series_id", "model", "score", "rank"
    )


def analyze(panel: DataFrame, has_external: bool = False) -> dict[str, DataFrame]:
    """Full report: validation, characteristics, frequencies, orders, insights, recommendations."""
    from .quality import sales_checks

    chars = characteristics(panel)
    tested = stationarity(panel).select("series_id", "stationary")
    full = chars.join(tested, "series_id")
    return {
        "validation": sales_checks(panel),
        "characteristics": full,
        "frequencies": frequencies(panel),
        "orders": arima_orders(panel),
        "insights": insights(chars),
        "recommendations": recommend(full, has_external),
    }
