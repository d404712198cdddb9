"""Forecasters: shape, invariants, recovery of noiseless series, panel independence."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.models import arima
from panelcast.models.additive import AdditiveRegression, rank_contributions
from panelcast.models.arima import ARIMA, SARIMAX
from panelcast.models.auto import AutoML, Hybrid, route
from panelcast.models.base import with_baseline
from panelcast.models.boosted import Boosted, boosted_rows, memory_values
from panelcast.models.groupwise import GroupForecaster
from panelcast.models.smoothing import ETS, STL, Theta
from panelcast.models.wma import WMA, Naive, multipliers

WEEK = [0, 5, 10, 15, 10, 5, 0]
H = 7


def line_and_week(n=140, slope=0.5, level=100):
    return [level + slope * i + WEEK[i % 7] for i in range(n)]


def noisy(n=120, seed=0):
    rng = np.random.default_rng(seed)
    return list(200 + np.cumsum(rng.normal(0, 2, n)) + np.tile(WEEK, n // 7 + 1)[:n])


CLOSED = [WMA(), Naive(), ETS(), ETS(trend="mul", seasonal="mul", alphas=(0.2,), betas=(0.1,), gammas=(0.1,)),
          ETS(trend=None, seasonal=None), Theta(), Theta(deseasonalize=False), STL(), STL(robust=True), ARIMA(), SARIMAX(), AdditiveRegression()]


@pytest.mark.parametrize("model", CLOSED, ids=lambda m: f"{m.name}-{hash(m) % 1000}")
def test_shape_and_band(model, panel_of):
    panel = panel_of({"a": noisy(), "b": noisy(90, 1), "short": noisy(6, 2)})
    rows = model.forecast(model.fit(panel), H).collect()
    assert len(rows) == 3 * H
    assert {(r["series_id"], r["step"]) for r in rows} == {(s, k) for s in ("a", "b", "short") for k in range(1, H + 1)}
    for r in rows:
        assert np.isfinite([r["yhat"], r["lower_ci"], r["upper_ci"]]).all()
        assert r["lower_ci"] <= r["yhat"] + 1e-9 and r["yhat"] <= r["upper_ci"] + 1e-9
    last = dt.date(2023, 1, 2) + dt.timedelta(days=119)
    assert sorted(r["ds"] for r in rows if r["series_id"] == "a") == [last + dt.timedelta(days=k) for k in range(1, H + 1)]


@pytest.mark.parametrize("model", [ETS(), Theta(), STL(), ARIMA(), AdditiveRegression()], ids=lambda m: m.name)
def test_band_does_not_shrink(model, panel_of):
    rows = model.forecast(model.fit(panel_of({"a": noisy()})), 14).orderBy("step").collect()
    width = [r["upper_ci"] - r["lower_ci"] for r in rows]
    assert all(b >= a - 1e-6 for a, b in zip(width, width[1:]))


@pytest.mark.parametrize("model", CLOSED, ids=lambda m: f"{m.name}-{hash(m) % 1000}")
def test_one_series_equals_the_same_series_in_a_panel(model, panel_of):
    alone = model.forecast(model.fit(panel_of({"a": noisy()})), 3).orderBy("step").collect()
    panel = panel_of({"a": noisy(), "b": noisy(60, 5)})
    among = model.forecast(model.fit(panel), 3).filter("series_id = 'a'").orderBy("step").collect()
    assert [r["yhat"] for r in alone] == pytest.approx([r["yhat"] for r in among])


@pytest.mark.parametrize("model", [STL(), AdditiveRegression(yearly_seasonality=False), SARIMAX((1, 0, 0), (0, 1, 0, 7)),
                                   ETS(damped_trend=False, alphas=(0.5,), betas=(0.1,), gammas=(0.2,))],
                         ids=["stl", "additive", "sarimax", "ets"])
def test_recovers_a_line_with_a_week(model, panel_of):
    rows = model.forecast(model.fit(panel_of({"a": line_and_week()})), H).orderBy("step").collect()
    want = [100 + 0.5 * (140 + k) + WEEK[(140 + k) % 7] for k in range(H)]
    assert [r["yhat"] for r in rows] == pytest.approx(want, abs=1.5)


def test_arima_recovers_ar_coefficient(panel_of):
    rng = np.random.default_rng(4)
    y = [0.0]
    for _ in range(1500):
        y.append(0.6 * y[-1] + rng.normal())
    row = ARIMA((1, 0, 0)).fit(panel_of({"a": y}, start=dt.date(2015, 1, 1))).first()
    assert row["phi"][1] == pytest.approx(-0.6, abs=0.05) and row["sigma"] == pytest.approx(1.0, abs=0.06)


def test_arima_keeps_few_python_processes(panel_of):
    """A task keeps a process per Python step: two in a fit, made once, and one in a forecast of its own stage."""
    model = SARIMAX((1, 0, 1), (1, 0, 1, 7))
    out = model.forecast(model.fit(panel_of({"a": range(60)})), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapIn(?:Arrow|Pandas)", plan)) == 3
    assert "Exchange" in re.search(r"MapInPandas.*?MapInPandas", plan, re.S)[0]


def test_arima_falls_back_by_length(spark):
    rows = [(200, 1, 0, 1, 1, 1, 1, 7), (15, 1, 0, 1, 1, 1, 1, 7), (8, 1, 1, 1, 0, 0, 0, 0), (4, 2, 0, 0, 0, 0, 0, 0), (30, 3, 2, 0, 0, 1, 0, 3)]
    names = ["p", "d", "q", "sp", "sd", "sq", "period"]
    table = spark.createDataFrame(rows, "n int, " + ", ".join(f"{c} int" for c in names))
    got = {r["n"]: r["plan"].asDict() for r in table.withColumn("plan", arima.planned(F.col("n"), 0, [F.col(c) for c in names])).collect()}
    assert got[200]["order"] == [1, 0, 1, 1, 1, 1, 7] and got[200]["delta"] == [1.0, *[0.0] * 6, -1.0]
    assert got[200]["ar"] == [1, 7] and got[200]["ma"] == [1, 7] and (got[200]["long"], got[200]["start"]) == (13, 20)
    assert got[15]["order"] == [1, 0, 1, 0, 0, 0, 1]
    assert got[4] == arima.WALK
    assert got[30]["delta"] == [1.0, -2.0, 1.0, -1.0, 2.0, -1.0] and got[30]["ar"] == [1, 2, 3]


def test_wma_value_and_weekday_factors(panel_of):
    row = WMA(window=3).fit(panel_of({"a": [1, 2, 3, 4]})).first()
    assert row["wma"] == pytest.approx((2 * 1 + 3 * 2 + 4 * 3) / 6)
    assert row["factors"] == [1.0] * 7
    long = WMA().fit(panel_of({"a": [10] * 7 + [20] * 7})).first()
    assert long["factors"] == pytest.approx([1.0] * 7)


def test_multipliers_combine(spark):
    day = dt.date(2024, 1, 1)
    promotions = spark.createDataFrame([(day, 20.0), (day, 150.0)], "ds date, discount double")
    holidays = spark.createDataFrame([(day, 1.5)], "ds date, holiday_impact double")
    media = spark.createDataFrame([(day, 3.0)], "ds date, media_spend double")
    given = {"promotions": promotions, "holidays": holidays, "media_plan": media}
    assert multipliers(given).first()["multiplier"] == pytest.approx(1.2 * 2.0 * 1.5)
    assert multipliers(given, use_media=True).first()["multiplier"] == pytest.approx(1.2 * 2.0 * 1.5 * 3.0)


def test_uplift_comes_from_the_factors(spark, panel_of):
    panel = panel_of({"a": [10.0] * 20})
    day = dt.date(2023, 1, 2) + dt.timedelta(days=21)
    holidays = spark.createDataFrame([(day, 1.3)], "ds date, holiday_impact double")
    rows = with_baseline(WMA(), WMA().fit(panel), 3, "D", {"holidays": holidays}).orderBy("step").collect()
    assert [round(r["uplift"], 6) for r in rows] == [0.0, 30.0, 0.0]


def test_regressor_effect_is_learned_and_explained(spark, panel_of):
    start = dt.date(2023, 1, 2)
    promo_days = {start + dt.timedelta(days=i) for i in range(0, 160, 11)}
    values = [100 + (50 if start + dt.timedelta(days=i) in promo_days else 0) for i in range(150)]
    factors = {"promotions": spark.createDataFrame([(d, 10.0) for d in promo_days], "ds date, discount double")}
    model = AdditiveRegression(yearly_seasonality=False)
    panel = panel_of({"a": values})
    fitted = model.fit(panel, factors)
    rows = with_baseline(model, fitted, 10, "D", factors).collect()
    for r in rows:
        assert r["yhat"] - r["baseline"] == pytest.approx(50 if r["ds"] in promo_days else 0, abs=3)
    parts = model.contributions(fitted, 10, "D", factors)
    total = {r["step"]: r["s"] for r in parts.groupBy("step").agg(F.sum("contribution").alias("s")).collect()}
    mean = np.mean(values)
    assert all(total[r["step"]] + mean == pytest.approx(r["yhat"], abs=1.0) for r in rows)
    assert rank_contributions(parts).filter("rank = 1").first()["feature"] == "promo_discount"


def test_multiplicative_mode_needs_positive_data(panel_of):
    model = AdditiveRegression(seasonality_mode="multiplicative")
    fitted = {r["series_id"]: r["log_scale"] for r in model.fit(panel_of({"a": noisy(), "b": [-1.0] * 50})).collect()}
    assert fitted == {"a": True, "b": False}


def test_settings_give_each_series_its_own_form(spark, panel_of):
    """One fit with a weekly and a monthly series equals two fits with the periods as model parameters."""
    cycle = lambda p: [100 + 30 * np.sin(2 * np.pi * i / p) + 0.1 * i for i in range(150)]
    panel = panel_of({"week": cycle(7), "month": cycle(30)})
    settings = spark.createDataFrame([("week", {"seasonal_periods": "7"}), ("month", {"seasonal_periods": "30"})], "series_id string, params map<string,string>")
    other = {"Theta": "period", "STL": "period", "ETS": "seasonal_periods"}
    for kind in (Theta, STL, ETS):
        both = {(r["series_id"], r["step"]): r["yhat"] for r in kind().forecast(kind().fit(panel, settings=settings), 5).collect()}
        for name, period in (("week", 7), ("month", 30)):
            own = kind(**{other[kind.__name__]: period})
            part = panel.filter(F.col("series_id") == name)
            for r in own.forecast(own.fit(part), 5).collect():
                assert both[name, r["step"]] == pytest.approx(r["yhat"], rel=1e-9)
    off = spark.createDataFrame([("week", {"seasonal": "none", "trend": "none"}), ("month", {"damped_trend": "false"})], settings.schema)
    kinds = {r["series_id"]: (r["trend_kind"], r["season_kind"], r["phi"]) for r in ETS().fit(panel, settings=off).collect()}
    assert kinds == {"week": ("none", "none", 0.98), "month": ("add", "add", 1.0)}
    orders = spark.createDataFrame([("week", {"p": "2", "d": "0", "q": "0"})], settings.schema)
    found = {r["series_id"]: r["order"][:3] for r in ARIMA((1, 1, 0)).fit(panel, settings=orders).collect()}
    assert found == {"week": [2, 0, 0], "month": [1, 1, 0]}
    modes = spark.createDataFrame([("week", {"yearly_seasonality": "false", "changepoint_prior_scale": "0.5"})], settings.schema)
    names = {r["series_id"]: any(n.startswith("yearly") for n in r["names"]) for r in AdditiveRegression().fit(panel, settings=modes).collect()}
    assert names == {"week": False, "month": True}


def test_boosted_is_deterministic_and_non_negative(panel_of):
    panel = panel_of({"a": line_and_week(100), "b": noisy(100, 3)})
    first, second = (Boosted(5, max_depth=3, min_child_samples=2) for _ in range(2))
    a = sorted(map(tuple, first.forecast(first.fit(panel), 5).collect()))
    b = sorted(map(tuple, second.forecast(second.fit(panel), 5).collect()))
    assert a == b and len(a) == 10 and min(r[3] for r in a) >= 0
    gains = first.importance(panel.sparkSession).collect()
    assert gains[0]["pct"] == 100.0 and all(x["importance"] >= y["importance"] for x, y in zip(gains, gains[1:]))


def test_boosted_steps_equal_steps_taken_one_by_one(panel_of):
    values = line_and_week(100)
    model = Boosted(5, max_depth=3, min_child_samples=2, scale="mean")
    fitted = model.fit(panel_of({"a": values}))
    ahead = [r["yhat"] for r in model.forecast(fitted, 10).orderBy("step").collect()]  # the state is written in between
    level = fitted.first()["level"]
    one_by_one = []
    for step in range(10):
        state = model.state(panel_of({"a": values + one_by_one})).withColumn("recent", F.transform("recent", lambda v: v * F.col("level") / level))
        one_by_one.append(model.forecast(state.withColumn("level", F.lit(level)), 1).first()["yhat"])
    assert ahead == pytest.approx(one_by_one)


def test_memory_features_match_training_features(panel_of):
    panel = panel_of({"a": noisy(40, 5)})
    model = Boosted(1, scale="mean")
    rows = model.training_rows(panel).orderBy(F.desc("ds")).first()
    before = np.array(model.state(panel).first()["recent"][:-1])
    found = memory_values(np.r_[np.full(28 - len(before), np.nan), before][None, :])
    assert all(rows[n] == pytest.approx(v[0]) for n, v in found.items() if not n.endswith("_28"))
    some = memory_values(np.array([[np.nan] * 28, [np.nan] * 26 + [3.0, 5.0]]))
    assert some["lag_1"].tolist() == [0.0, 5.0] and some["lag_3"].tolist() == [0.0, 0.0]
    assert some["rolling_min_7"].tolist() == [0.0, 3.0] and some["rolling_std_7"][1] == pytest.approx(np.sqrt(2))


def test_tree_walk_equals_the_fitted_ensemble(spark, panel_of):
    """Node arrays give what the ensemble itself gives, and contributions what lies between mean and forecast."""
    panel = panel_of({"a": line_and_week(120), "b": noisy(120, 3)})
    model = Boosted(8, 0.3, max_depth=4, min_child_samples=2, parallel=3)
    fitted = model.fit(panel)
    rows = model.training_rows(panel).toPandas()
    x = rows[model.features].to_numpy(float)
    predicted = model.trees.predict(x)
    assert np.mean((rows["y"] - predicted) ** 2) < 0.2 * np.var(rows["y"])
    assert model.trees.contributions(x).sum(axis=1) + model.trees.mean() == pytest.approx(predicted)
    level = {r["series_id"]: r["level"] for r in fitted.collect()}
    ahead = {(r["series_id"], r["step"]): r["yhat"] for r in model.forecast(fitted, 6).collect()}
    parts = model.contributions(fitted, 6).groupBy("series_id", "step").agg(F.sum("contribution").alias("total"), F.count("feature").alias("n"))
    for r in parts.collect():
        assert r["n"] == len(model.features)
        assert r["total"] == pytest.approx(ahead[r["series_id"], r["step"]] - model.trees.mean() * level[r["series_id"]])
    again = Boosted().restored(model.tree_table(spark), model.features, model.trees.base)
    assert {(r["series_id"], r["step"]): r["yhat"] for r in again.forecast(fitted, 6).collect()} == pytest.approx(ahead)


def test_boosted_uses_factors(spark, panel_of):
    start = dt.date(2023, 1, 2)
    on = [i for i in range(120) if i % 3 == 0]
    values = [100 + (80 if i in on else 0) for i in range(110)]
    promos = spark.createDataFrame([(start + dt.timedelta(days=i), 5.0, "x" if i % 2 else "y") for i in on], "ds date, discount double, promo_type string")
    model = boosted_rows(20, 0.3, 3, 1, 1.0, 1.0)
    factors = {"promotions": promos}
    fitted = model.fit(panel_of({"a": values}), factors)
    with_plan = {r["step"]: r["yhat"] for r in model.forecast(fitted, 4, "D", factors).collect()}
    assert "promotions_discount" in model.features and "promotions_promo_type_x" in model.features
    assert all(v > 0 for v in with_plan.values())


def test_routing_and_automl(panel_of):
    rng = np.random.default_rng(6)
    week = [100 + 60 * np.sin(2 * np.pi * i / 7) + rng.normal(0, 1) for i in range(80)]
    panel = panel_of({"week": week, "few": list(rng.normal(50, 1, 20)), "sparse": [0.0, 0.0, 5.0] * 20})
    strategies = {r["series_id"]: r["strategy"] for r in route(panel).collect()}
    assert strategies["week"] == "additive" and strategies["few"] == "wma"
    model = AutoML()
    assert model.forecast(model.fit(panel), 3).count() == 9


def test_hybrid_widens_the_band(panel_of):
    panel = panel_of({"a": noisy(100)})
    model = Hybrid(residual=boosted_rows(3, 0.1, 2, 1, non_negative=False, scale="sd", name="residual"))
    fitted = model.fit(panel)
    base = {r["step"]: r["upper_ci"] - r["yhat"] for r in model.base.forecast(fitted, 3).collect()}
    for r in model.forecast(fitted, 3).collect():
        assert r["upper_ci"] - r["yhat"] == pytest.approx(base[r["step"]] * 1.2)


@pytest.mark.parametrize("method, base", [("wma", (10 * 1 + 20 * 2 + 30 * 3) / 6), ("median", 20.0)])
def test_group_baseline_by_weekday(spark, method, base):
    start = dt.date(2024, 1, 1)
    rows = [("a", start + dt.timedelta(days=7 * w), 10.0 * (w + 1), 0, 0.0) for w in range(3)]
    sales = spark.createDataFrame(rows, "series_id string, ds date, y double, promo_flag int, discount double")
    out = GroupForecaster(method=method, use_trend=False).forecast(sales, "2024-01-22", 2).orderBy("ds").collect()
    assert out[0]["yhat"] == pytest.approx(base)
    assert out[1]["yhat"] == pytest.approx(20.0)  # no Tuesday in the history: mean of the last rows


def test_group_forecast_inside_the_history(spark):
    start = dt.date(2024, 1, 1)
    rows = [("a", start + dt.timedelta(days=i), float(i), 0, 0.0) for i in range(60)]
    sales = spark.createDataFrame(rows, "series_id string, ds date, y double, promo_flag int, discount double")
    model = GroupForecaster(use_trend=False, method="median")
    got = {r["ds"]: r["yhat"] for r in model.forecast(sales, str(start + dt.timedelta(days=20)), 30).collect()}
    for day, value in got.items():
        i = (day - start).days
        earlier = [j for j in range(i) if j % 7 == i % 7][-8:]
        assert value == pytest.approx(np.median(earlier))


def test_group_settings_take_the_longest_prefix(spark):
    from panelcast.models.groupwise import resolve_settings

    groups = spark.createDataFrame([("n", "x"), ("n", "y"), ("s", "x")], "region string, item string")
    config = spark.createDataFrame([("n", None, 4, 4, 4, "median"), ("n", "x", 2, 2, 2, "wma")], "region string, item string, D int, W int, M int, method string")
    got = {(r["region"], r["item"]): (r["lookback"], r["method"]) for r in resolve_settings(groups, config, ["region", "item"], "D").collect()}
    assert got == {("n", "x"): (2, "wma"), ("n", "y"): (4, "median"), ("s", "x"): (8, "wma")}
