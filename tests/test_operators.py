"""Components on small tables."""

import datetime

import pytest

from quarry import schema
from quarry.operators import columns, encode, featurize, impute, sample, series, split
from quarry.operators.base import Component, component
from quarry.plans import estimators, graph, profile, search


def test_inferred_types(spark):
    rows = [(i, f"a{i}@b.org", f"https://x.org/{i}", "some words that make a longer text than categories " + str(i), "ab"[i % 2], None) for i in range(40)]
    df = schema.infer(spark.createDataFrame(rows, "n int, mail string, url string, text string, kind string, nothing string"))
    assert schema.logical_types(df) == {"n": "integer", "mail": "email", "url": "url", "text": "text", "kind": "category", "nothing": "unknown"}


def test_impute_and_store(spark):
    df = spark.createDataFrame([(1.0, "a", None), (None, "a", None), (3.0, None, None), (5.0, "b", None)], "x double, c string, e string")
    imputer = impute.Imputer().fit(df)
    again = Component.from_json(imputer.to_json())
    assert sorted(map(tuple, again.transform(df).collect())) == sorted([(1.0, "a"), (3.0, "a"), (3.0, "a"), (5.0, "b")])


def test_interpolation_holds_tail_and_fills_head(spark):
    df = spark.createDataFrame([(1, None), (2, 2.0), (3, None), (4, 6.0), (5, None)], "t int, x double")
    got = impute.TimeSeriesImputer(time_index="t").fit(df).transform(df).orderBy("t").collect()
    assert [r.x for r in got] == [2.0, 2.0, 4.0, 6.0, 6.0]


def test_knn_imputer(spark):
    df = spark.createDataFrame([(1.0, 10.0), (1.1, 11.0), (9.0, 90.0), (1.05, None)], "x double, y double")
    got = impute.KNNImputer(number_neighbors=2).fit(df).transform(df).where("x = 1.05").first()
    assert got.y == pytest.approx(10.5)


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    out = encode.OneHotEncoder().fit_transform(df)
    assert out.columns == ["c_b"] and [r.c_b for r in out.collect()] == [False, False, True]
    with pytest.raises(ValueError):
        encode.OneHotEncoder().fit(spark.createDataFrame([("a",), (None,)], "c string"))


def test_label_encoder_round_trip(spark):
    df = spark.createDataFrame([("no",), ("yes",), ("no",)], "y string")
    e = encode.LabelEncoder(positive_label="no").fit(df, "y")
    coded = e.transform(df)
    assert sorted(r.y for r in coded.collect()) == [0, 1, 1]
    assert sorted(r.y for r in e.inverse_transform(coded).collect()) == ["no", "no", "yes"]


def test_dates_count_from_zero(spark):
    df = spark.createDataFrame([(datetime.datetime(2023, 1, 1, 5),)], "d timestamp")
    r = featurize.DateTimeFeaturizer().fit_transform(df).first()
    assert (r.d_year, r.d_month, r.d_day_of_week, r.d_hour) == (2023, 0, 0, 5)


def test_log_shift_is_learnt(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,)], "y double")
    t = featurize.LogTransformer().fit(df, "y")
    back = t.inverse_transform(t.transform(df.where("y > 0")))
    assert back.first().y == pytest.approx(5.0)


def test_undersampler_rules():
    assert sample.undersample_quotas({"a": 1000, "b": 200}) == {"a": 800}
    assert sample.undersample_quotas({"a": 1000, "b": 900}) == {}
    assert sample.undersample_quotas({"a": 1000, "b": 50}) == {}


def test_oversampler_reaches_ratio(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(100)] + [(float(i) + 0.5, 1) for i in range(5)], "x double, y int")
    got = sample.Oversampler(sampling_ratio=0.25).fit(df, "y").transform(df).where("y = 1").count()
    assert got >= 25


def test_regularizer(spark):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    df = spark.createDataFrame([(day(1), 1.0), (day(2), None), (day(2), 2.0), (day(4), 4.0), (day(5), 5.0), (day(6), 6.0)], "t timestamp, x double")
    out = series.TimeSeriesRegularizer(time_index="t", threshold=0.6).fit(df).transform(df).orderBy("t").collect()
    assert [r.x for r in out] == [1.0, 2.0, None, 4.0, 5.0, 6.0]


def test_stack_is_inverse_of_unstack(spark):
    df = spark.createDataFrame([(t, s, float(10 * t + s)) for t in range(3) for s in range(2)], "t int, s int, v double")
    wide = series.unstack(df, ["v"], "s", "t", [0, 1])
    assert wide.columns == ["t", "v|0", "v|1"]
    assert sorted((r.t, int(r.s), r.v) for r in series.stack(wide, "t", "s").collect()) == sorted(map(tuple, df.collect()))


def test_decomposition_adds_up(spark):
    rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), 0.5 * i + [0, 3, -3][i % 3]) for i in range(30)]
    out = series.decompose(spark.createDataFrame(rows, "t timestamp, y double"), "y", "t", 3).toPandas()
    assert abs(out.signal - out.trend - out.seasonality - out.residual).max() < 1e-9
    assert abs(out.residual).mean() < 0.5


def test_splits(spark):
    df = spark.range(90).selectExpr("id", "id % 3 as y")
    assert sorted(r["count"] for r in split.kfold(df, "id", 3, "y").groupBy("fold").count().collect()) == [30, 30, 30]
    assert split.train_test(df, "id", 0.2, "y").where("is_test").count() == 18
    with pytest.raises(ValueError):
        split.time_series_split(df, "id", 3, 40)
    assert split.make_splitter(200_000, "binary")["test_size"] == 0.75


def test_checks(spark):
    df = spark.createDataFrame([(i, 1, None if i else 2.0, i % 2) for i in range(100)], "some_id int, one int, gaps double, y int")
    found = {m.code for m in profile.null_check(df, "y") + profile.id_check(df, "y") + profile.no_variance_check(df, "y")}
    assert {"HIGHLY_NULL_COLS", "HAS_ID_FIRST_COLUMN", "NO_VARIANCE"} <= found
    table = graph.cleaned(df, "y", profile.null_check(df, "y"))
    assert "gaps" not in table.columns
    assert 0 < profile.gamma_cdf(2.0, 3.0) == pytest.approx(0.32332358)


def test_graph_order():
    assert graph.topological({"a": ["X"], "b": ["a"], "c": ["a", "b"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        graph.topological({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError):
        graph.topological({"a": ["X"], "b": ["X"]})


def test_pipeline_fits_scores_and_stores(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 50), "ab"[i % 2], "yes" if i % 50 > 25 else "no") for i in range(300)], "id int, x double, c string, y string")
    p = graph.make_pipeline(df, "y", "LogisticRegressionClassifier", "binary", key="id").fit(df, "y")
    assert p.score(df, ["AUC", "F1"]).values["AUC"] > 0.95
    p.save(f"file://{tmp_path}/p")
    q = graph.Pipeline.load(spark, f"file://{tmp_path}/p")
    assert {(r.id, r.prediction) for r in q.predict(df).select("id", "prediction").collect()} == {(r.id, r.prediction) for r in p.predict(df).select("id", "prediction").collect()}


def test_tuners():
    grid = search.GridSearchTuner({"a": ["x", "y"], "b": (1, 2)}, n_points=2)
    assert [grid.propose() for _ in range(4)] == [{"a": a, "b": b} for a in "xy" for b in (1, 2)]
    with pytest.raises(search.NoParamsLeft):
        grid.propose()
    tuner = search.BayesianTuner({"a": (0.0, 1.0)})
    for _ in range(25):
        p = tuner.propose()
        tuner.add(p, -abs(p["a"] - 0.3))
    assert min(abs(x[0][0] - 0.3) for x in tuner.history) < 0.1


def test_registry():
    assert component("Imputer") is impute.Imputer
    with pytest.raises(ValueError):
        component("Nothing")
    with pytest.raises(ValueError):
        columns.DropColumns(colums=["a"])
    assert "XGBoostClassifier" in estimators.estimators_for("multiclass")


def test_streaming_profile_equals_batch(spark, tmp_path):
    from quarry.sources.tables import table
    from quarry.streaming import profile as streaming

    events = table(spark, "/root/testdata/sf0.001", "events").select("event_id", "ts", "event_type", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    query = streaming.start(streaming.windowed(streaming.stream(spark, f"{tmp_path}/in", events.schema)), "streamed")
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("streamed").collect())) == sorted(map(str, streaming.windowed(events).collect()))


def test_distributions_and_trees(spark):
    from quarry.plans import explain

    df = spark.createDataFrame([(float(i % 10), float(i % 10), i % 2, 0, float(i % 10 > 4)) for i in range(200)], "a double, b double, y int, p int, t double")
    assert explain.same_distribution(df, "a", "b", "regression") == 1
    assert explain.same_distribution(df, "y", "p", "binary") == 0
    model = estimators.Estimator("DecisionTreeRegressor", max_depth=2).fit(df, "t", ["a"])
    got = explain.tree(model)
    assert got["feature"] == "a" and 4 <= got["threshold"] < 5 and got["left"] == {"value": 0.0}
    line = estimators.Estimator("LinearRegressor").fit(df.selectExpr("a", "2 * a + 1 as z"), "z", ["a"])
    assert {r.feature: round(r.coefficient, 6) for r in explain.coefficients(spark, line).collect()} == {"Intercept": 1.0, "a": 2.0}


def test_driver_helpers():
    from quarry.functions import utils

    assert utils.convert_to_seconds("3 hours") == 10800.0 and utils.convert_to_seconds("2 min") == 120.0
    with pytest.raises(ValueError):
        utils.convert_to_seconds("1 fortnight")
    assert utils.contains_ts_parameters({"gap": 1})[0] is False


def test_outliers(spark):
    calm = [(float(i % 10),) for i in range(500)]
    assert profile.outlier_check(spark.createDataFrame(calm, "x double")) == []
    found = profile.outlier_check(spark.createDataFrame([*calm, *[(1000.0 + i,) for i in range(60)]], "x double"))
    assert found[0].code == "HAS_OUTLIERS" and found[0].details["rows"] == {"x": 60}
    assert profile.no_outlier_probability(500, 0.0) == 1.0


def test_knn_against_brute_force(spark):
    import random

    from quarry.operators import impute

    rng = random.Random(3)
    rows = [tuple(None if rng.random() < 0.2 else float(rng.randrange(25)) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k string, a double, b double, c double")
    step = impute.KNNImputer(number_neighbors=3)
    step.QUERIES, step.ROWS = 40, 70
    got = {r.k: (r.a, r.b, r.c) for r in step.fit(df).transform(df).collect()}
    for i, r in enumerate(rows):
        for j in range(3):
            if r[j] is None:
                far = lambda s, r=r: (lambda d: sum(d) / len(d) if d else float("inf"))([(x - y) ** 2 for x, y in zip(r, s, strict=True) if x is not None and y is not None])
                near = sorted((round(far(s), 9), s[j]) for s in rows if s[j] is not None)[:3]
                assert abs(got[str(i)][j] - sum(v for _, v in near) / 3) < 1e-9, (i, j)
            else:
                assert got[str(i)][j] == r[j]


def test_boosting_runs_all_rounds_asked_for():
    from quarry.plans import estimators as est

    for name in ("XGBoostClassifier", "XGBoostRegressor", "LightGBMClassifier", "CatBoostRegressor"):
        assert est._ml(name, est.ESTIMATORS[name].defaults | {"n_estimators": 150}, 2, 1).getOrDefault("maxIter") == 150
