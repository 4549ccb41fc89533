"""Properties of ordered helpers, checks as objects, series pipelines, searches, explanations, figures and decomposers."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import metrics, ordered, problems, utils
from quarry.operators import base, decompose, split
from quarry.plans import check_classes as checks
from quarry.plans import ensemble, figures, graph, profile, search, timeseries
from quarry.plans import estimators as est
from quarry.plans import models_explained as explained
from quarry.sources import demos


@pytest.fixture(scope="module")
def two(spark):
    rng = random.Random(1)
    rows = [(i, a := rng.gauss(0, 1), b := rng.gauss(0, 1), "x" if rng.random() < 0.5 else "z", int(2 * a - b + rng.gauss(0, 0.3) > 0)) for i in range(400)]
    return spark.createDataFrame(rows, "k bigint, a double, b double, c string, y int").cache()


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(2)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 10 + 0.1 * i + 3 * math.sin(2 * math.pi * i / 7) + rng.gauss(0, 0.1)) for i in range(140)]
    return spark.createDataFrame(rows, "d timestamp, y double").cache()


# Order ---------------------------------------------------------------------------------------------------------------


def test_numbered_running_previous(spark):
    rows = [(i * 7919 % 1000, float(i % 13)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k bigint, v double").repartition(9)
    got = sorted((r.n, r.k) for r in ordered.numbered(df, "n", "k").collect())
    assert got == [(i + 1, i) for i in range(1000)]
    by_key, total = dict(rows), 0.0
    sums = {r.k: r.s for r in ordered.running(df, {"s": "v"}, F.desc("k")).collect()}
    for k in range(999, -1, -1):
        total += by_key[k]
        assert sums[k] == pytest.approx(total)
    before = {r.k: r.p for r in ordered.with_previous(df, "k", "v", "p").collect()}
    assert all(before[k] == (by_key[k - 1] if k else None) for k in range(1000))
    assert ordered.numbered(df.where("k < 0"), "n", "k").count() == 0


# Problems, checks, objectives -----------------------------------------------------------------------------------------


def test_problem_types():
    assert problems.handle_problem_types("Time Series Binary") is problems.ProblemType.TIME_SERIES_BINARY == "time_series_binary"
    assert problems.is_binary("time_series_binary") and problems.is_time_series("time_series_binary") and not problems.is_regression("binary")
    assert problems.is_multiseries("multiseries_time_series_regression") and problems.is_classification("multiclass") and problems.is_multiclass("multiclass")
    with pytest.raises(KeyError):
        problems.handle_problem_types("other")


def test_checks_as_objects(spark):
    df = spark.createDataFrame([(i, None if i % 3 else 1.0, i % 2) for i in range(30)], "id bigint, v double, y int")
    messages = checks.DataChecks([checks.NullDataCheck, checks.InvalidTargetDataCheck], {"NullDataCheck": {"pct_null_col": 0.5}, "InvalidTargetDataCheck": {"problem": "binary"}}).validate(df, "y")
    assert [m.code for m in messages] == ["HIGHLY_NULL_COLS"]
    with pytest.raises(ValueError):
        checks.DataChecks([checks.NullDataCheck], {"SparsityDataCheck": {}})
    assert checks.DefaultDataChecks("binary").validate(df, None)[0].code == "TARGET_IS_NONE"

    class Tall(checks.DataCheck):
        def validate(self, df, y=None):
            return [profile.Message(self.name, "warning", "TALL", "many rows")] if df.count() > self.options["most"] else []

    assert Tall(most=10).validate(df)[0].check == "Tall" and not Tall(most=100).validate(df)


def test_action_options(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i), None if i % 10 == 0 else i % 2) for i in range(40)], "k bigint, v double, y int")
    messages = profile.null_check(df.drop("k"), "y") + profile.invalid_target_check(df, "y", "binary")
    options = checks.options_of(messages)
    impute = next(o for o in options if o.code == "impute_col" and not o.metadata.get("is_target"))
    assert impute.get_action_from_defaults().parameters == {"impute_strategies": {"v": {"impute_strategy": "most_frequent"}}}
    assert impute.action({"impute_strategies": {"v": {"impute_strategy": "mean"}}}).parameters["impute_strategies"]["v"]["impute_strategy"] == "mean"
    assert len(checks.actions_from_defaults(options)) == len(options)
    with pytest.raises(ValueError):
        checks.ActionOption("drop_col", "c", {}, {"p": {"type": "global"}})


def test_row_order_and_keys(spark):
    good = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(50)], "k bigint, t timestamp").repartition(5)
    bad = good.withColumn("t", F.when(F.col("k") == 20, F.lit(dt.datetime(2023, 1, 1))).otherwise(F.col("t")))
    assert not checks.time_order_check(good, "t", "k") and checks.time_order_check(bad, "t", "k")[0].code == "DATETIME_IS_NOT_MONOTONIC"
    assert not checks.keys_check(good, good, "k")
    assert checks.keys_check(good, good.where("k > 3"), "k")[0].code == "MISMATCHED_LENGTHS"
    assert checks.keys_check(good, good.withColumn("k", F.col("k") + 1), "k")[0].code == "MISMATCHED_INDICES"


def test_score_all_is_complete(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 5.0), (0, 1, 0.6, 3.0), (1, 0, 0.4, 2.0), (0, 0, 0.1, 10.0)], "y int, p int, s double, amount double")
    names = [o.name for o in metrics.OBJECTIVES.values() if "binary" in o.problems]
    got = metrics.score_all(df, "binary", names, "y", "p", proba="s", amount="amount")
    assert not got.errors and set(got.values) == set(names)
    assert got.values["CostBenefitMatrix"] == 0.0 and got.values["LeadScoring"] == 0.0 and got.values["FraudCost"] == pytest.approx((2.0 + 3.0 * 0.5 * 0.02) / 20)
    train = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 4.0)], "t int, v double")
    reg = spark.createDataFrame([(4.0, 5.0), (6.0, 4.0)], "y double, p double")
    assert metrics.score_all(reg, "time_series_regression", ["MASE"], "y", "p", train=(train, "v", "t")).values["MASE"] == pytest.approx(1.0)
    assert "MASE" in metrics.score_all(reg, "time_series_regression", ["MASE", "MAE"], "y", "p").errors


def test_objectives_to_subclass(spark):
    class Missed(metrics.CustomObjective):
        name, problems, greater_is_better = "Missed", ("binary",), False

        def score_column(self, y, pred):
            return F.avg(((y == 1) & (pred == 0)).cast("double")) + 0.1 * F.avg((pred == 1).cast("double"))

    df = spark.createDataFrame([(1, 0.9), (1, 0.7), (0, 0.3), (0, 0.2)], "y int, s double")
    t = Missed().best_threshold(df, "y", "s")
    assert 0.3 <= t < 0.7
    assert Missed().score(df.withColumn("p", Missed().decision(F.col("s"), t)), "y", "p") == pytest.approx(0.05)
    with pytest.raises(ValueError):
        Missed().score(df.where("y > 5"), "y", "s")
    assert metrics.organized_objectives("binary", ["MCCBinary"], ["AUC"]) == ["F1", "BalancedAccuracyBinary", "LogLossBinary", "MCCBinary"]
    assert "AUC" in metrics.recommended_objectives("binary", imbalanced=True) and {o.name for o in metrics.ranking_only_objectives()} == set(metrics.RANKING_ONLY)


# Loaders, helpers ------------------------------------------------------------------------------------------------------


def test_demo_loaders(spark, tmp_path):
    (tmp_path / "wine.csv").write_text("alcohol,kind,target\n1.5,red,0\n2.5, ,1\n3.5,white,2\n")
    df, y = demos.load_wine(spark, str(tmp_path))
    assert y == "target" and df.count() == 3 and df.where("kind is null").count() == 1
    spark.createDataFrame([(1, "yes")], "a int, fraud string").write.parquet(str(tmp_path / "fraud.parquet"))
    assert demos.load_fraud(spark, str(tmp_path), n_rows=1)[0].count() == 1
    with pytest.raises(ValueError):
        demos.load_demo(spark, str(tmp_path), "other")


def test_helpers(spark):
    import numpy as np

    assert utils.safe_repr([1.0, float("inf"), {"a": float("nan")}]) == "[1.0, float('inf'), {'a': float('nan')}]"
    assert 0 <= utils.random_seed(np.random.default_rng(0)) < 2**31 - 1 and utils.random_seed(7) == 7
    assert utils.imputed_types({"a": "integer", "b": "category"}, {"a": "mean", "b": "most_frequent"}) == {"a": "double", "b": "category"}
    assert "SimpleImputer" in base.all_components() and "SimpleImputer(" in base.component_code(base.component("SimpleImputer")())
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "k bigint, v double")
    train, test = split.resplit(df, "k", 0.25)
    assert train.count() == 15 and test.count() == 5 and split.no_split(df).where("is_test").count() == 0
    assert utils.matched(df, df.select("k", F.col("v").alias("w")), "k").count() == 20


# Pipelines, ensembles, search ------------------------------------------------------------------------------------------


def test_rolling_origins_do_not_look_ahead(series):
    h = timeseries.Horizon("d", gap=1, max_delay=3, forecast_horizon=5)
    pairs = timeseries.rolling_origins(series, h, 3)
    assert len(pairs) == 3
    for train, test in pairs:
        assert train.agg(F.max("d")).first()[0] < test.agg(F.min("d")).first()[0] and test.count() == 5


@pytest.mark.parametrize("name", ["ARIMARegressor", "ProphetRegressor", "ExponentialSmoothingRegressor", "LinearRegressor"])
def test_series_pipelines_beat_the_baseline(series, name):
    h = timeseries.Horizon("d", max_delay=7, forecast_horizon=7)
    cut = dt.datetime(2024, 1, 1) + dt.timedelta(days=133)
    train, test = series.where(F.col("d") < F.lit(cut)), series.where(F.col("d") >= F.lit(cut))
    p = timeseries.make_timeseries_pipeline(train, "y", name, "time_series_regression", h, {"ExponentialSmoothingRegressor": {"sp": 7}}).fit(train, "y")
    mean = train.agg(F.avg("y")).first()[0]
    mae = p.score(test, ["MAE", "MASE"], train)
    assert not mae.errors and mae.values["MAE"] < 0.6 * test.agg(F.avg(F.abs(F.col("y") - mean))).first()[0]
    ahead = p.get_forecast_predictions(train)
    assert ahead.count() == 7 and ahead.agg(F.min("d")).first()[0] == cut and ahead.where("prediction is null").count() == 0
    assert p.get_prediction_intervals(test, train).where("lower > upper").count() == 0


def test_series_search(series):
    got = search.AutoMLSearch(series, "y", "time_series_regression", "d", horizon=timeseries.Horizon("d", max_delay=7, forecast_horizon=7), estimators=["LinearRegressor", "ARIMARegressor"], n_splits=2, on_error="raise").search()
    assert {r.pipeline.graph.order[-1] for r in got.results} == {"LinearRegressor", "ARIMARegressor"} and all(len(r.cv_scores) == 2 for r in got.results)
    low = timeseries.baseline_pipeline("time_series_regression", got.horizon)
    got.add_to_rankings(low)
    assert got.rankings().orderBy(F.desc("mean_cv_score")).first().pipeline_name == "TimeSeriesBaselineEstimator"
    with pytest.raises(ValueError):
        search.AutoMLSearch(series, "y", "time_series_regression", "d")


def test_search_stacks_and_is_stored(spark, two, tmp_path):
    got = search.AutoMLSearch(two, "y", "binary", "k", estimators=["LogisticRegressionClassifier", "KNeighborsClassifier"], n_splits=2, max_batches=3, ensembling=True, on_error="raise", engine_name="sequential").search()
    stacked = [r for r in got.results if isinstance(r.pipeline, ensemble.StackedPipeline)]
    assert len(stacked) == 1 and stacked[0].mean_cv_score < 0.4
    assert len(got.ensemble_inputs()) == 2 and got.best_so_far()[-1][2] == min(r.mean_cv_score for r in got.results)
    got.save(str(tmp_path / "s"))
    again = search.AutoMLSearch.load(two, str(tmp_path / "s"))
    assert [r.mean_cv_score for r in again.results] == [r.mean_cv_score for r in got.results]
    for r, s in zip(got.results, again.results, strict=True):
        if not isinstance(r.pipeline, ensemble.StackedPipeline):
            own = {x.k: x.p for x in r.pipeline.predict_proba(two).select("k", F.get("probability", F.lit(1)).alias("p")).collect()}
            assert own == pytest.approx({x.k: x.p for x in s.pipeline.predict_proba(two).select("k", F.get("probability", F.lit(1)).alias("p")).collect()})
    trained = got.train_pipelines([got.results[0].pipeline])
    assert got.score_pipelines(list(trained.values()), two, ["AUC"])[got.results[0].pipeline.name]["AUC"] > 0.9
    with pytest.raises(ValueError):
        search.unique_names([got.results[0].pipeline] * 2)
    assert got.recommendation_scores(["AUC", "F1"]).count() == len(got.results)


def test_algorithms_and_engines():
    names = ["LogisticRegressionClassifier", "RandomForestClassifier", "XGBoostClassifier"]
    plan = search.DefaultAlgorithm(names, search.RandomSearchTuner, ensembling=True)
    assert [e for e, _ in plan.next_batch([])] == names[:2] and [e for e, _ in plan.next_batch(names[:2])] == names[2:]
    assert all(p for _, p in plan.next_batch(names)) and plan.next_batch(names) == [("ensemble", {})]
    with search.engine("sequential") as pool:
        assert list(pool.map(lambda x: x + 1, [1, 2])) == [2, 3]
    with pytest.raises(ValueError):
        search.engine("other")
    with pytest.raises(RuntimeError):
        search.raise_error(RuntimeError("x"), "p")
    assert search.silent(RuntimeError(), "p") is None
    (p,) = search.pipelines_of({"one": {"LogisticRegressionClassifier": ["LogisticRegressionClassifier", "X", "y"]}}, "binary")
    assert p.name == "one" and p.can_tune_threshold_with("F1") and not p.can_tune_threshold_with("AUC")


def test_baseline_and_tree_intervals(spark, two, tmp_path):
    for name in ("BaselineClassifier", "RandomForestClassifier"):
        p = graph.make_pipeline(two, "y", name, "binary", key="k").fit(two, "y")
        p.save(str(tmp_path / name))
        again = graph.Pipeline.load(spark, str(tmp_path / name))
        assert again.predict_proba(two).agg(F.sum("prediction")).first()[0] == p.predict_proba(two).agg(F.sum("prediction")).first()[0]
    assert "digraph" in p.graph.dot() and "fitted.score" in p.example("/data")
    e = est.Estimator("RandomForestRegressor", n_estimators=15).fit(two, "a", ["b", "y"])
    got = est.tree_intervals(e, two, [0.5, 0.95])
    assert got.where("`0.95_lower` > `0.5_lower` or `0.95_upper` < `0.5_upper`").count() == 0
    assert max(abs(r.x - r.z) for r in got.select("k", F.col("prediction").alias("x")).join(e.predict(two).select("k", F.col("prediction").alias("z")), "k").collect()) < 1e-9
    assert est.unable_to_handle_nans("LinearRegressor") and not est.unable_to_handle_nans("ARIMARegressor")


# Explanations, figures -------------------------------------------------------------------------------------------------


def test_explanations_of_a_fitted_pipeline(two):
    p = graph.make_pipeline(two, "y", "LogisticRegressionClassifier", "binary", key="k").fit(two, "y")
    line = [r.average for r in explained.dependence(p, two, "a", 8).orderBy("value").collect()]
    assert len(line) == 8 and line == sorted(line) and line[-1] - line[0] > 0.5
    assert explained.dependence(p, two, ["a", "c"], 4).count() == 8
    imp = explained.importance(p, two, "k", "AUC").collect()
    assert imp[0].feature == "a" and imp[0].importance > 0.1 and imp[-1].feature == "c"
    few = two.where("k < 12")
    values = explained.shapley(p, few, "k", two, samples=6)
    total = {r.k: r.s for r in values.groupBy("k").agg(F.sum("contribution").alias("s")).collect()}
    own = {r.k: r.p for r in p.predict_proba(few).select("k", F.get("probability", F.lit(1)).alias("p")).collect()}
    gap = [own[k] - total[k] for k in total]
    assert len(total) == 12 and max(gap) - min(gap) < 1e-9  # the same base for all
    top = explained.explained(p, few, "k", two, top_k=1, samples=6)
    assert top.count() == 12 and top.groupBy("feature").count().orderBy(F.desc("count")).first().feature == "a"
    local = explained.local_linear(p, few, "k", two, ["a", "b"])
    assert local.where("feature = 'a' and contribution < 0").count() == 0 and local.where("feature = 'b' and contribution > 0").count() == 0
    row = explained.force(values, "k", gap[0]).first()
    assert row.prediction == pytest.approx(own[row.k]) and len(row.features) == 3
    with pytest.raises(ValueError):
        explained.dependence(p, two.withColumn("c", F.lit("x")), "c")


def test_figures(spark, two, tmp_path):
    scored = two.select("y", F.when(F.col("a") > 0, 1).otherwise(0).alias("p"), (1 / (1 + F.exp(-F.col("a")))).alias("s"), "a")
    got = figures.roc(scored, "y", "s")
    assert got["series"]["model"]["y"][-1] == 1.0 and got["title"].startswith("ROC, area 0.9")
    assert len(figures.confusion(scored, "y", "p")["series"]["cells"]["cells"]) == 4 and figures.precision_recall(scored, "y", "s")["series"]["model"]["n"] == 400
    assert figures.threshold(scored, "y", "s", "F1", 10)["series"]["model"]["n"] == 11
    assert figures.prediction_vs_actual(scored, "y", "s", 0.8)["series"]["outliers"]["n"] < 100
    assert figures.bars(spark.createDataFrame([("a", 0.1), ("b", -0.5)], "f string, v double"), "f", "v", "t")["series"]["bars"]["x"] == ["b", "a"]
    path = figures.save(got, str(tmp_path / "roc.json"))
    assert open(path).read().startswith("{") and "n0 -> n1" in figures.tree_dot([{"id": 0, "label": "x", "children": [1]}, {"id": 1, "label": "y"}])


# Decomposers -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["PolynomialDecomposer", "STLDecomposer"])
def test_decomposers(series, name):
    assert decompose.determine_periodicity(series, "y", "d") == 7
    step = base.component(name)(time_index="d").fit(series, "y")
    flat = step.transform(series)
    assert flat.agg(F.stddev("y")).first()[0] < 0.3
    back = step.inverse_transform(flat, "y").select("d", F.col("y").alias("z")).join(series, "d")
    assert back.agg(F.max(F.abs(F.col("y") - F.col("z")))).first()[0] < 1e-9
    parts = step.trend_table(series)
    assert parts.agg(F.stddev("seasonality")).first()[0] > 1.5 and parts.where("abs(signal - trend - seasonality - residual) > 1e-9").count() == 0
    ahead = series.select((F.col("d") + F.expr("interval 140 days")).alias("d")).limit(20)
    bounds = step.trend_intervals(ahead).collect()
    for r in bounds:
        i = (r.d - dt.datetime(2024, 1, 1)).days
        assert r.lower < r.upper and abs((r.lower + r.upper) / 2 - (10 + 0.1 * i + 3 * math.sin(2 * math.pi * i / 7))) < 2.0
    step.set_period(14)
    assert step.parameters["period"] == 14 and decompose.frequency_valid(86400) and not decompose.frequency_valid(90)
    with pytest.raises(ValueError):
        step.set_period(1)
    again = base.Component.from_json(step.to_json())
    assert again.transform(series).agg(F.sum("y")).first()[0] == pytest.approx(flat.agg(F.sum("y")).first()[0])
