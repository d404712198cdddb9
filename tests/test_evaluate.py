"""Splits, folds, metrics, ensembles, tuning, scenarios, storage, runs and the job."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelcast import job, run, store
from panelcast.models.boosted import Boosted
from panelcast.models.smoothing import Theta
from panelcast.models.wma import WMA, Naive
from panelcast.operators import evaluate as ev
from panelcast.operators import scenario as sn
from panelcast.operators import tuning


def walk(n=90, seed=42):
    return list(100 + np.cumsum(np.random.default_rng(seed).normal(0, 1, n) * 5) + 300)


def test_split_sizes(panel_of):
    panel = panel_of({"hundred": range(100), "nine": range(9), "twelve": range(12)})
    got = {(r["series_id"], r["split"]): r["count"] for r in ev.split_panel(panel, 0.8).groupBy("series_id", "split").count().collect()}
    assert got[("hundred", "test")] == 19  # 1 - 0.8 is a little below 0.2
    assert got[("nine", None)] == 9
    by_horizon = ev.split_panel(panel, horizon=30).filter("split = 'test'").groupBy("series_id").count()
    assert {r[0]: r[1] for r in by_horizon.collect()} == {"hundred": 20, "twelve": 2}


def test_folds_expand_and_never_overlap(panel_of):
    rows = ev.cv_folds(panel_of({"a": range(60)}), 7, 5).collect()
    for fold in range(5):
        train = [r for r in rows if r["fold"] == fold and r["role"] == "train"]
        test = [r for r in rows if r["fold"] == fold and r["role"] == "test"]
        assert len(train) == 14 + 7 * fold and len(test) == 7
        assert max(r["ds"] for r in train) < min(r["ds"] for r in test)
        assert sorted(r["step"] for r in test) == list(range(1, 8))


def test_too_short_for_cv(panel_of):
    assert ev.cross_validate(panel_of({"a": range(5)}), WMA()).count() == 0
    one_fold = ev.fold_summary(ev.cross_validate(panel_of({"a": range(16)}), WMA(), 2, 1))
    assert one_fold.first()["mae"] is None


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 4.0, 2.0), ("a", 0.0, 0.0)], "series_id string, y double, yhat double")
    row = ev.error_metrics(df, ["series_id"]).first()
    assert row["mae"] == pytest.approx(1.0) and row["rmse"] == pytest.approx((5 / 3) ** 0.5)
    assert row["mape"] == pytest.approx((100 + 50 + 0) / 3)
    spread = sum((v - 5 / 3) ** 2 for v in (1, 4, 0))
    assert row["r2"] == pytest.approx(1 - 5 / spread)
    huge = ev.error_metrics(spark.createDataFrame([("a", 0.0, 5.0)], "series_id string, y double, yhat double"), ["series_id"], 1000.0)
    assert huge.first()["mape"] == 1000.0


def test_fold_key_does_not_change_a_model(panel_of):
    panel = panel_of({"a": walk(), "b": walk(70, 1)})
    folds = ev.cross_validate(panel, Theta(alpha=0.3)).filter("series_id = 'a' and fold = 2").first()
    train = panel.filter("series_id = 'a'").orderBy("ds").limit(14 + 2 * 7)
    forecast = [r["yhat"] for r in Theta(alpha=0.3).forecast(Theta(alpha=0.3).fit(train), 7).orderBy("step").collect()]
    assert folds["mae"] == pytest.approx(np.mean(np.abs(np.array(forecast) - walk()[28:35])))


def test_pooled_model_is_fitted_once_per_fold(panel_of):
    out = ev.cross_validate(panel_of({"a": walk(60)}), Boosted(2, max_depth=2, min_child_samples=1), 3, 2)
    assert {r["fold"] for r in out.collect()} <= {0, 1}


def test_backtest_window(panel_of):
    split = ev.backtest_split(panel_of({"a": range(100), "b": range(50)}))
    got = {(r["series_id"], r["split"]): r["count"] for r in split.groupBy("series_id", "split").count().collect()}
    assert got == {("a", "train"): 79, ("a", "test"): 21, ("b", None): 50}
    by_days = ev.backtest_split(panel_of({"a": range(100)}), overlap=10).filter("split = 'test'")
    assert by_days.count() == 11


def test_ensemble_weights(spark):
    metrics = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", None), ("b", "y", 0.0)], "series_id string, model string, mae double")
    w = {(r[0], r[1]): r[2] for r in ev.inverse_error_weights(metrics).collect()}
    assert w[("a", "x")] / w[("a", "y")] == pytest.approx(3.001 / 1.001) and w[("b", "x")] == 0.5
    rows = spark.createDataFrame(
        [("a", "x", dt.date(2024, 1, 1), 10.0, 8.0, 12.0), ("a", "y", dt.date(2024, 1, 1), 20.0, 15.0, 30.0), ("a", "y", dt.date(2024, 1, 2), 20.0, 15.0, 30.0)],
        "series_id string, model string, ds date, yhat double, lower_ci double, upper_ci double")
    weights = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0)], "series_id string, model string, weight double")
    out = ev.combine_forecasts(rows, weights).orderBy("ds").collect()
    assert [r["yhat"] for r in out] == [12.5, 20.0] and (out[0]["lower_ci"], out[0]["upper_ci"]) == (8.0, 30.0)


def test_ranking_prefers_test_metrics(spark):
    cv = spark.createDataFrame([("a", "x", 5.0, 6.0, 7.0, 0.1), ("a", "y", 1.0, 2.0, 3.0, 0.9), ("a", "z", None, None, None, None)],
                               "series_id string, model string, mae double, rmse double, mape double, r2 double")
    test = cv.filter("model = 'x'").withColumn("mae", F.lit(0.5))
    got = [(r["model"], r["source"], r["rank"]) for r in ev.rank_from_test(test, cv).orderBy("rank").collect()]
    assert got == [("x", "test", 1), ("y", "cv", 2), ("z", "cv", 3)]


def test_tuning_picks_a_window_per_series(panel_of):
    best = tuning.tune(panel_of({"a": walk(80), "b": [5.0] * 80}), "wma", n_iter=3, folds=2)
    rows = {r["series_id"]: r for r in best.collect()}
    assert set(rows) == {"a", "b"} and all("window" in r["params"] and r["n_folds"] == 2 for r in rows.values())


def test_a_search_round_is_one_fit_for_all_candidates(panel_of, monkeypatch):
    """The scores of the joint job are those of each candidate alone, and only best halves go on."""
    panel = panel_of({"a": walk(90), "b": walk(80, 2)})
    candidates = [{"window": w} for w in (4, 8, 20)]
    rows = ev.tuning_folds(panel, 3)
    chosen = panel.select("series_id").distinct().crossJoin(tuning.candidate_table(panel.sparkSession, candidates))
    fits = []
    monkeypatch.setattr(WMA, "fit", lambda self, *a, _fit=WMA.fit, **k: (fits.append(1), _fit(self, *a, **k))[1])
    joint = {(r["series_id"], r["params"]["window"]): r["mae"] for r in tuning.score_candidates(rows, WMA(), chosen, 9).collect()}
    assert len(fits) == 1 and len(joint) == 6
    for params in candidates:
        alone = ev.cross_validate(panel, WMA(**params), 9, rows=rows).groupBy("series_id").avg("mae").collect()
        for name, mae in alone:
            assert joint[name, str(params["window"])] == pytest.approx(mae)
    halved = {r["series_id"]: r for r in tuning.tune(panel, "wma", folds=3, halving=True).collect()}
    assert set(halved) == {"a", "b"} and all(r["n_folds"] == 3 for r in halved.values())


def test_found_parameters_reach_the_forecast(panel_of):
    from panelcast.run import ForecastRequest, run_forecast

    panel = panel_of({"a": walk(90), "b": walk(90, 4)})
    out = run_forecast(panel, ForecastRequest(models=["wma"], horizon=3, tune=True))
    for r in out["parameters"].filter("model = 'wma'").collect():
        own = WMA(int(r["params"]["window"]))
        part = panel.filter(F.col("series_id") == r["series_id"])
        alone = [x["yhat"] for x in own.forecast(own.fit(part), 3).orderBy("step").collect()]
        found = [x["yhat"] for x in out["forecast"].filter(F.col("series_id") == r["series_id"]).orderBy("step").collect()]
        assert found == pytest.approx(alone)


def test_narrow_and_unknown_parameters():
    space = {"window": [4, 8, 12, 20], "robust": [True, False], "trend": ["add", "mul", None]}
    assert tuning.narrow(space, {"window": 8, "robust": True})["window"] == [4, 8, 12]
    assert tuning.narrow(space, {"window": 8})["robust"] == [True, False]
    assert tuning.sample_candidates(space, 3, 1) == tuning.sample_candidates(space, 3, 1)
    with pytest.raises(ValueError):
        tuning.build_model("wma", {"speed": 1})
    with pytest.raises(ValueError):
        tuning.build_model("arima", {"speed": 1})


def test_adjustments(spark):
    media = spark.createDataFrame([(dt.date(2024, 1, 1), 10.0, 2.0)], "ds date, media_spend double, reach double")
    out = sn.adjust_factors({"media_plan": media}, {"media_plan": {"multiplier": 2, "media_spend_multiplier": 1.5, "media_spend_add": 1, "reach_set": 7}, "none": {"multiplier": 3}})
    assert tuple(out["media_plan"].first())[1:] == (31.0, 7.0)


def test_contributions_have_direction(spark, panel_of):
    panel = panel_of({"a": [10.0] * 20})
    day = dt.date(2023, 1, 23)
    factors = {
        "holidays": spark.createDataFrame([(day, 0.5)], "ds date, holiday_impact double"),
        "promotions": spark.createDataFrame([(day, 40.0)], "ds date, discount double"),
    }
    model = WMA()
    got = {r["factor"]: (round(r["total"], 6), r["direction"], r["rank"]) for r in sn.sorted_contributions(
        sn.factor_contributions(model, model.fit(panel), 5, "D", factors)).collect()}
    assert got == {"holidays": (-5.0, "negative", 1), "promotions": (4.0, "positive", 2)}


# --- storage, runs, job ------------------------------------------------------------------


def test_dataset_catalogue(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "ds date, y double")
    first = store.save_dataset(df, root, "sales", "one")
    second = store.save_dataset(df.union(df), root, "sales", "two")
    store.save_dataset(df, root, "weather", "sky")
    catalog = spark.read.parquet(f"{root}/catalog")
    assert [r["dataset_id"] for r in store.list_datasets(catalog, "sales").collect()] == [second, first]
    newest = {r["kind"]: r["name"] for r in store.newest_datasets(catalog).collect()}
    assert newest == {"sales": "two", "weather": "sky"}
    assert store.load_dataset(spark, root, "sales", second).count() == 2


def test_runs_are_replaced_and_deleted_alone(spark, tmp_path, panel_of):
    root, model, panel = str(tmp_path), WMA(), panel_of({"a": walk()})
    fitted = model.fit(panel)
    for run_id in ("r1", "r2"):
        store.save_run(root, run_id, {"forecast": model.forecast(fitted, 3)}, run_id)
    store.update_run(root, "r1", "forecast", model.forecast(fitted, 5))
    assert store.load_run(spark, root, "r1", "forecast").count() == 5
    assert store.load_run(spark, root, "r2", "forecast").count() == 3
    assert store.delete_run(spark, root, "r1") and not store.delete_run(spark, root, "r1")
    assert [r["run_id"] for r in store.list_runs(spark, root).collect()] == ["r2"]


def test_saved_model_forecasts_the_same_and_detects_changes(spark, tmp_path, panel_of):
    root, model, panel = str(tmp_path), Theta(), panel_of({"a": walk(), "b": walk(70, 3)})
    fitted = model.fit(panel)
    model_id = store.save_model(fitted, root, "theta", "T", tags=["x"], notes="n")
    loaded = store.load_model(spark, root, model_id)
    a = sorted(map(tuple, model.forecast(fitted, 5).collect()))
    assert sorted(map(tuple, model.forecast(loaded, 5).collect())) == a
    store.update_model(spark, root, model_id, name="U", tags=["y", "z"])
    row = store.list_models(spark, root).first()
    assert (row["name"], row["tags"], row["notes"]) == ("U", ["y", "z"], "n")
    rows = spark.createDataFrame([(r["series_id"], r["params"] + " ", r["sha256"], None, None, None, r["model_id"]) for r in
                                  spark.read.parquet(f"{root}/parameters").collect()],
                                 "series_id string, params string, sha256 string, mae double, rmse double, mape double, model_id string")
    rows.write.mode("overwrite").partitionBy("model_id").parquet(f"{root}/parameters")
    with pytest.raises(PySparkException):
        store.load_model(spark, root, model_id).collect()
    assert store.delete_model(spark, root, model_id) and not store.delete_model(spark, root, model_id)


def test_json_export_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "a double, b double, c double")
    store.export_json(df, str(tmp_path / "j"))
    line = spark.read.text(str(tmp_path / "j")).first()[0]
    assert json.loads(line) == {"a": None, "b": None, "c": 1.0}


def test_end_to_end_run(spark, panel_of):
    panel = panel_of({"a": walk(), "b": walk(90, 9)})
    day = dt.date(2023, 1, 2) + dt.timedelta(days=91)
    factors = {"holidays": spark.createDataFrame([(day, 1.4), (day - dt.timedelta(days=30), 1.2)], "ds date, holiday_impact double")}
    request = run.ForecastRequest(models=["wma", "theta", "lightgbm"], horizon=7, ensemble=["wma", "theta"], params={"lightgbm": {"n_estimators": 2}})
    out = run.run_forecast(panel, request, factors)
    assert out["forecast"].count() == 2 * 3 * 7
    assert out["ranking"].filter("rank = 1").count() == 2
    assert out["test"].count() == 2 and set(r["source"] for r in out["ranking"].collect()) == {"test", "cv"}
    assert out["ensemble"].count() == 14 and out["summary"].count() == 2
    for name in ("history", "decomposition", "parameters", "backtest_metrics", "factor_totals", "contributions", "ensemble_backtest"):
        assert out[name].count() > 0, name


def test_weekly_downsampling_switches_the_frequency(panel_of):
    request = run.ForecastRequest(models=["wma"], horizon=3, max_points=300)
    out = run.run_forecast(panel_of({"a": [float(i % 9) for i in range(1900)]}, start=dt.date(2015, 1, 4)), request)
    days = [r["ds"] for r in out["forecast"].orderBy("ds").collect()]
    assert request.freq == "D" and (days[1] - days[0]).days == 7 and days[0].weekday() == 6


def test_train_and_save(spark, tmp_path, panel_of):
    panel = panel_of({"a": walk(), "b": walk(90, 4)})
    stored, metrics = run.train_and_save(panel, str(tmp_path), ["wma", "naive"], run.ForecastRequest())
    best = {}
    for r in metrics.orderBy("mae", "model").collect():
        best.setdefault(r["series_id"], r["model"])
    assert metrics.count() == 4 and set(stored) == set(best.values())
    assert {r["model_id"] for r in store.list_models(spark, str(tmp_path)).collect()} == set(stored.values())
    for model, model_id in stored.items():
        assert {r["series_id"] for r in store.load_model(spark, str(tmp_path), model_id).collect()} == {k for k, m in best.items() if m == model}


def test_batch_job(spark, tmp_path):
    start = dt.date(2024, 1, 1)
    rows = [(str(start + dt.timedelta(days=i)), r, float(10 + i % 7), i % 2, 0.1 * (i % 2)) for r in ("n", "s") for i in range(60)]
    spark.createDataFrame(rows, "date string, region string, sales double, promo_flag int, discount double").write.csv(f"{tmp_path}/sales", header=True)
    spark.createDataFrame([(1, "fair", "2024-02-01", "2024-02-03", "n")], "event_id int, event_name string, start_date string, end_date string, region string").write.csv(f"{tmp_path}/events", header=True)
    spark.createDataFrame([("2024-03-01", "n", 1, 0.1)], "date string, region string, promo_flag int, discount double").write.csv(f"{tmp_path}/plan", header=True)
    args = job.parser().parse_args([
        "--sales", f"{tmp_path}/sales", "--events", f"{tmp_path}/events", "--future-plan", f"{tmp_path}/plan", "--attributes", "region",
        "--start", "2024-03-01", "--periods", "5", "--output", f"{tmp_path}/out", "--lookback", '[{"region": "n", "D": 4}]',
    ])
    out = job.forecast(spark, args).collect()
    assert len(out) == 10 and all(r["yhat"] >= 0 for r in out)
    assert [r["promo_flag"] for r in out if r["region"] == "n" and str(r["ds"]) == "2024-03-01"] == [1]
