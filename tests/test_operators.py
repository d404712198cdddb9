"""Grid, rollup, join, event and decomposition operators on small frames."""

import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions import dates, scalars as sc
from panelcast.operators import decompose, enrich, events, grid, lagstats, profile, ranking, rollup


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (9.0,), (-1.0,), (2.0,)], "v double")
    assert [r[0] for r in df.select(sc.clamp("v", 0.0, 5.0)).collect()] == [None, 5.0, 0.0, 2.0]


def test_safe_float(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (3.0,)], "v double")
    assert [r[0] for r in df.select(sc.safe_float("v")).collect()] == [0.0, 0.0, 0.0, 3.0]


@pytest.mark.parametrize("freq, alias", [("D", "D"), ("W", "W-SUN"), ("F", "14D"), ("M", "ME"), ("Q", "QE"), ("Y", "YE")])
def test_future_dates_match_pandas(spark, freq, alias):
    lasts = [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2023, 12, 31), dt.date(2024, 5, 15), dt.date(2024, 6, 30)]
    df = spark.createDataFrame([(d,) for d in lasts], "last_ds date").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    got = {}
    for r in df.select("last_ds", dates.future_date("last_ds", "step", freq).alias("d")).orderBy("last_ds", "step").collect():
        got.setdefault(r[0], []).append(r[1])
    for last in lasts:
        start = pd.Timestamp(last) + pd.tseries.frequencies.to_offset(alias)
        assert got[last] == [d.date() for d in pd.date_range(start, periods=5, freq=alias)]


@pytest.mark.parametrize("freq, alias", [("D", "D"), ("W", "W-SUN"), ("F", "14D"), ("M", "ME"), ("Q", "QE")])
def test_resample_matches_pandas(spark, freq, alias):
    rng = random.Random(3)
    days = sorted(rng.sample(range(200), 40))
    rows = [("a", dt.date(2023, 3, 5) + dt.timedelta(days=d), float(d)) for d in days]
    got = grid.resample_sum(spark.createDataFrame(rows, "series_id string, ds date, y double"), freq).orderBy("ds").collect()
    want = pd.Series([r[2] for r in rows], index=pd.to_datetime([r[1] for r in rows])).resample(alias).sum()
    assert [(r["ds"], r["y"]) for r in got] == [(d.date(), v) for d, v in want.items()]


def test_downsample_levels(panel_of):
    panel = panel_of({"long": range(2500), "short": range(100), "middle": range(900)}, start=dt.date(2015, 1, 1))
    found = {r["series_id"]: (r["level"], r["n"]) for r in grid.downsample(panel, 400).groupBy("series_id", "level").agg(F.count("*").alias("n")).collect()}
    assert found["short"] == ("none", 100) and found["middle"] == ("tail", 400)
    assert found["long"][0] == "weekly" and found["long"][1] <= 400
    total = grid.downsample(panel, 400).filter("series_id = 'long'").agg(F.sum("y")).first()[0]
    assert total == sum(range(2500))


def test_rolling_excludes_the_current_row(panel_of):
    rows = grid.rolling_features(panel_of({"a": [1, 2, 3, 10]}), (2,)).orderBy("ds").collect()
    assert [r["rolling_mean_2"] for r in rows] == [None, 1.0, 1.5, 2.5]
    assert [r["rolling_std_2"] for r in rows][:2] == [0.0, 0.0]


@pytest.mark.parametrize("hot", [1000, 2, 1])
def test_exact_median_equals_brute_force_with_a_hot_key(spark, monkeypatch, hot):
    """With all keys broadcast, the hot one only, and none."""
    monkeypatch.setattr(rollup, "HOT", hot)
    rng = random.Random(1)
    data = [("hot", round(rng.gauss(0, 100), 1)) for _ in range(20000)] + [("few", 1.0), ("few", 4.0), ("one", 2.0)]
    data += [(f"k{i % 50}", float(i % 7)) for i in range(1000)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r["median"] for r in rollup.exact_median(df, ["k"], "v").collect()}
    values = {}
    for k, v in data:
        values.setdefault(k, []).append(v)
    assert got == pytest.approx({k: statistics.median(v) for k, v in values.items()})


def test_rare_categories_share_a_column(spark, monkeypatch):
    monkeypatch.setattr(grid, "MAX_CATEGORIES", 2)
    rows = [("a", "x"), ("a", "x"), ("b", "x"), ("b", "x"), ("c", "x"), (None, "x")]
    out = grid.one_hot(spark.createDataFrame(rows, "kind string, same string"), ["kind", "same"])
    assert out.columns == ["kind", "same", "kind_a", "kind_b", "kind_(other)"]
    assert sorted(map(str, {tuple(r)[2:] for r in out.collect()})) == ["(0.0, 0.0, 1.0)", "(0.0, 1.0, 0.0)", "(1.0, 0.0, 0.0)"]


def test_lag_moments_give_every_product(spark):
    values = np.random.default_rng(4).normal(size=40)
    row = spark.createDataFrame([(values.tolist(), [1.0, 0.0, -1.0])], "v array<double>, w array<double>").select(
        lagstats.lag_moments(F.col("v"), F.lit(5)).alias("m"), lagstats.filtered(F.col("v"), F.col("w")).alias("d")).first()
    design = np.column_stack([values[5 - k : 40 - k] for k in range(6)])
    assert lagstats.lag_gram(row["m"]) == pytest.approx(design.T @ design)
    assert row["m"]["sums"] == pytest.approx(design.sum(axis=0)) and row["m"]["rows"] == 35
    assert row["d"] == pytest.approx(values[2:] - values[:-2])


def test_lagged_correlation_skips_gaps(spark, panel_of):
    y = [float(i % 5) + i / 10 for i in range(40)]
    x = [None if i in (3, 17) else float((i * 7) % 11) for i in range(40)]
    factor = spark.createDataFrame([(dt.date(2023, 1, 2) + dt.timedelta(days=i), v) for i, v in enumerate(x)], "ds date, x double")
    got = {r["lag"]: r["r"] for r in events.lagged_factor_correlation(panel_of({"a": y}), factor, 4).collect()}
    for lag in range(4):
        pairs = [(y[i], x[i - lag]) for i in range(lag, 40) if x[i - lag] is not None]
        assert got[lag] == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1])


def test_histogram_keeps_empty_bins_and_flat_series(panel_of):
    out = rollup.histogram(panel_of({"a": [0, 0, 10], "flat": [5, 5]}), 5)
    a = {r["bin"]: r["count"] for r in out.filter("series_id = 'a'").collect()}
    assert a == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1}
    assert [(r["midpoint"], r["count"]) for r in out.filter("series_id = 'flat'").collect()] == [(5.0, 2)]


def test_category_series_minimum_and_total(spark):
    rows = [("x", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(25)] + [("y", dt.date(2024, 1, 1), 2.0)]
    out = rollup.category_series(spark.createDataFrame(rows, "c string, ds date, y double"), ["c"])
    assert {r[0] for r in out.select("series_id").distinct().collect()} == {"x", "(all)"}
    assert out.filter("series_id = '(all)'").agg(F.sum("y")).first()[0] == 27.0


def test_hierarchy_depths(spark):
    df = spark.createDataFrame([("n", "a", 1.0), ("n", "b", 2.0), ("s", "c", 4.0)], "region string, store string, y double")
    out = rollup.hierarchy_rollup(df, ["region", "store"], F.lit("all"))
    assert sorted((r["depth"], r["y"]) for r in out.collect()) == [(0, 7.0), (1, 3.0), (1, 4.0), (2, 1.0), (2, 2.0), (2, 4.0)]


def test_asof_flags_carry_forward(spark, panel_of):
    panel = panel_of({"a": range(6), "b": range(6)})
    flags = spark.createDataFrame([(dt.date(2023, 1, 3),), (dt.date(2023, 1, 3),), (dt.date(2023, 1, 5),)], "ds date")
    out = enrich.attach_flags_asof(panel, {"holidays": flags}).filter("series_id = 'b'").orderBy("ds")
    assert [r["holidays_flag"] for r in out.collect()] == [0, 2, 2, 1, 1, 1]


def test_first_match_and_events(spark):
    plan = spark.createDataFrame([("a", dt.date(2024, 1, 1), 2, 0.3), ("a", dt.date(2024, 1, 1), 1, 0.1)], "k string, ds date, no int, discount double")
    assert enrich.first_match(plan, ["k", "ds"], ["no"]).first()["discount"] == 0.1
    sales = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5.0)], "series_id string, ds date, y double")
    intervals = spark.createDataFrame(
        [(2, "late", dt.date(2024, 1, 1), dt.date(2024, 1, 2), "a"), (1, "early", dt.date(2023, 12, 30), dt.date(2024, 1, 1), "a"),
         (3, "open", dt.date(2024, 1, 1), None, "a")],
        "event_id int, event_name string, start_date date, end_date date, series_id string",
    )
    daily = events.explode_intervals(intervals, ["series_id"])
    assert daily.count() == 5
    joined = enrich.attach_events(sales, daily, ["series_id"]).collect()
    assert len(joined) == 1 and joined[0]["event_name"] == "early"


def test_chart_rows_boundary(panel_of):
    actual = panel_of({"a": [1, 2, 3]})
    forecast = panel_of({"a": [9, 9, 9, 9]}).select("series_id", "ds", F.col("y").alias("yhat"), F.lit(0.0).alias("lower_ci"), F.lit(1.0).alias("upper_ci"))
    rows = enrich.chart_rows(actual, forecast).orderBy("ds").collect()
    assert [r["yhat"] for r in rows] == [None, None, None, 9.0]


def test_easter_dates(spark):
    known = {2000: ("2000-04-23", "2000-04-30"), 2019: ("2019-04-21", "2019-04-28"), 2024: ("2024-03-31", "2024-05-05"),
             2025: ("2025-04-20", "2025-04-20"), 1981: ("1981-04-19", "1981-04-26"), 2049: ("2049-04-18", "2049-04-25")}
    df = spark.createDataFrame([(y,) for y in known], "year int")
    got = {r[0]: (str(r[1]), str(r[2])) for r in df.select("year", dates.western_easter("year"), dates.orthodox_easter("year")).collect()}
    assert got == known


def test_sports_reachability_option(spark):
    years = spark.createDataFrame([(2026,)], "year int")
    everything = {r[0] for r in events.sports(years, ["US"]).select("name").distinct().collect()}
    assert everything == {"Super Bowl", "FIFA World Cup"}
    assert {r[0] for r in events.sports(years, ["US"], only_reachable=True).select("name").distinct().collect()} == {"Super Bowl"}


def test_event_impact_rules(spark, panel_of):
    panel = panel_of({"up": [10.0] * 21 + [20.0, 20.0], "zero": [0.0] * 23, "new": [1.0, 1.0]})
    marks = spark.createDataFrame([(dt.date(2023, 1, 23), "Sale")], "ds date, name string")
    got = {r["series_id"]: r["impact"] for r in events.event_impacts(marks, panel).collect()}
    assert got["up"] == 2.0 and got["zero"] is None and got.get("new") is None


def test_lifts(spark):
    rows = [("a", float(10 + 10 * (i % 2)), i % 2, 0.1 * (i % 2), "fair" if i < 3 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "series_id string, y double, promo_flag int, discount double, event_name string")
    lift = events.promo_lifts(df).first()
    assert lift["promo_lift"] == 2.0 and lift["discount_beta"] == pytest.approx(100 / 15)
    assert events.event_lifts(df).count() == 1


def test_classical_parts_add_up(panel_of):
    values = [10 + i + [0, 3, -3, 1, -1, 2, -2][i % 7] for i in range(70)]
    rows = decompose.classical(panel_of({"a": values}), 7).filter("trend is not null").collect()
    assert all(abs(r["y"] - r["trend"] - r["seasonal"] - r["residual"]) < 1e-9 for r in rows)
    assert max(abs(r["residual"]) for r in rows) < 1e-9
    short = decompose.classical(panel_of({"a": values[:10]}), 7)
    assert short.filter("trend is not null or seasonal is not null").count() == 0


def test_robust_decomposition_finds_the_week(panel_of):
    rng = np.random.default_rng(0)
    values = [100 + 20 * np.sin(2 * np.pi * i / 7) + rng.normal(0, 1) for i in range(200)]
    values[50] += 500
    row = decompose.robust_decompose(panel_of({"a": values})).first()
    assert row["period"] == 7 and row["strength"] > 0.0
    assert abs(np.asarray(row["trend"])[10:40].mean() - 100) < 5


def test_spectral_and_autocorrelation_periods(panel_of):
    panel = panel_of({"a": [np.sin(2 * np.pi * i / 12) for i in range(240)]})
    assert decompose.spectral_periods(panel).first()["periods"][0] == 12
    assert decompose.autocorrelation_periods(panel).first()["periods"][0] % 12 == 0


def test_partial_autocorrelation_of_ar1(panel_of):
    rng = np.random.default_rng(1)
    y = [0.0]
    for _ in range(600):
        y.append(0.7 * y[-1] + rng.normal())
    panel = panel_of({"a": y})
    lags = {r["lag"]: r["pacf"] for r in profile.partial_autocorrelation(panel).collect()}
    assert abs(lags[1] - 0.7) < 0.1 and all(abs(lags[k]) < 0.15 for k in range(2, 8))
    acf = {r["lag"]: r["acf"] for r in profile.autocorrelation(panel).collect()}
    c = np.asarray(y) - np.mean(y)
    assert acf[3] == pytest.approx(float(c[3:] @ c[:-3] / (c @ c)))


def test_stationarity(panel_of):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=300)
    panel = panel_of({"noise": noise, "walk": np.cumsum(noise), "tiny": noise[:10]})
    got = {r["series_id"]: r["stationary"] for r in profile.stationarity(panel).collect()}
    assert got == {"noise": True, "walk": False, "tiny": True}


def test_characteristics_of_a_short_trending_series(panel_of):
    row = profile.characteristics(panel_of({"a": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]})).first()
    assert (row["trend"], row["seasonality"], row["length"]) == ("increasing", "none", 10)
    assert row["missing_pct"] == pytest.approx(100 / 11)


def test_union_by_priority_prefers_the_first_part(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in ranking.union_by_priority([a, b], ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_dimension_join_routes_agree(spark, folder):
    from panelcast.sources.tables import brand_panel, region_panel

    small = {tuple(r) for r in brand_panel(spark, folder).collect()}, {tuple(r) for r in region_panel(spark, folder).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = {tuple(r) for r in brand_panel(spark, folder).collect()}, {tuple(r) for r in region_panel(spark, folder).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small == large


def test_fill_join_matches_loop_on_a_hot_group(spark):
    from panelcast.operators.normalize import fill_by_date

    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(40)),
             None if rng.random() < 0.4 else float(rng.randrange(9))) for _ in range(800)]
    df = spark.createDataFrame(data, "k string, ds date, y double")
    got = sorted(tuple(r) for r in fill_by_date(df, ["y"], ["k"]).collect())
    want = []
    for k, d, y in data:
        known = {}
        for k2, d2, y2 in data:
            if k2 == k and y2 is not None:
                known[d2] = max(known.get(d2, y2), y2)
        before = [x for x in known if x <= d]
        fill = known[max(before)] if before else known[min(known)] if known else 0.0
        want.append((k, d, fill if y is None else y))
    assert got == sorted(want)
