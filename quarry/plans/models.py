"""Queries that fit models; rows depend on them, so tests check properties instead of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import register
from quarry.plans import estimators as est
from quarry.plans import search as auto
from quarry.plans.graph import cleaned, make_pipeline
from quarry.plans.profile import default_checks
from quarry.sources.tables import holed_events, table


def labelled(spark, sf_dir):
    """Documents with counts as features and their quality label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.size(F.split("text", r"\s+")).alias("n_words"), F.length(F.regexp_replace("text", "[^#$%&*|<>]", "")).alias("n_symbols"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def _fit(name: str, problem: str):
    def run(spark, sf_dir):
        if problem == "regression":
            li = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("row_id"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
            return make_pipeline(li, "l_extendedprice", name, problem, key="row_id").fit(li, "l_extendedprice").predict(li).select("row_id", "prediction")
        d = labelled(spark, sf_dir)
        return make_pipeline(d, "quality", name, problem, key="doc_id").fit(d, "quality").predict_proba(d).select("doc_id", "prediction")

    return run


for _name, _query in (
    ("LinearRegressor", "fit_linear"), ("ElasticNetRegressor", "fit_elastic_net"), ("DecisionTreeRegressor", "fit_tree_regressor"), ("RandomForestRegressor", "fit_forest_regressor"), ("XGBoostRegressor", "fit_boosted_regressor"),
    ("BaselineRegressor", "fit_baseline_regressor"),
):
    register(_query)(_fit(_name, "regression"))
for _name, _query in (
    ("LogisticRegressionClassifier", "fit_logistic"), ("DecisionTreeClassifier", "fit_tree"), ("RandomForestClassifier", "fit_forest"), ("ExtraTreesClassifier", "fit_extra_trees"), ("XGBoostClassifier", "fit_gbt"),
    ("KNeighborsClassifier", "fit_neighbors"), ("SVMClassifier", "fit_svm"), ("BaselineClassifier", "fit_baseline_classifier"),
):
    register(_query)(_fit(_name, "binary"))


@register("fit_stack")
def fit_stack(spark, sf_dir):
    d = labelled(spark, sf_dir).drop("lang")
    _, _, out = est.stacked(d, "quality", ["n_chars", "n_words", "n_symbols"], ["LogisticRegressionClassifier", "DecisionTreeClassifier"], "doc_id")
    return out.select("doc_id", "prediction")


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("d"), "o_orderpriority").agg(F.sum("o_totalprice").alias("y"))


for _name, _query in (("ExponentialSmoothingRegressor", "holt_winters"), ("ARIMARegressor", "autoregression"), ("ProphetRegressor", "trend_fourier")):

    def _forecast(spark, sf_dir, name=_name):
        return est.forecast(_daily(spark, sf_dir), "y", "d", 7, name, "o_orderpriority")

    register(_query)(_forecast)


@register("vector_autoregression")
def vector_autoregression(spark, sf_dir):
    from quarry.operators.series import unstack

    daily = _daily(spark, sf_dir)
    ids = sorted(r[0] for r in daily.select("o_orderpriority").distinct().collect())
    wide = unstack(daily, ["y"], "o_orderpriority", "d", ids)
    return est.var_forecast(wide, [f"y|{i}" for i in ids], "d", 5).toDF("step", *[i.split("-")[-1].lower().replace(" ", "_") for i in ids])


@register("prediction_intervals")
def prediction_intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "user_id", F.col("value").alias("prediction"))
    return est.prediction_intervals(e, "ts", 0.95, "user_id")


@register("cleaned_table")
def cleaned_table(spark, sf_dir):
    e = holed_events(spark, sf_dir).select("value", "event_type", F.lit(1).alias("constant"), (F.col("user_id") % 2).alias("y"))
    return cleaned(e, "y", default_checks(e, "y", "binary"))


@register("automl_search")
def automl_search(spark, sf_dir):
    got = auto.AutoMLSearch(labelled(spark, sf_dir), "quality", "binary", "doc_id", estimators=["LogisticRegressionClassifier", "DecisionTreeClassifier"], n_splits=2).search()
    return got.rankings().select("pipeline_name", "mean_cv_score")


@register("automl_ts")
def automl_ts(spark, sf_dir):
    """Rolling origins over the daily totals of all orders: a kernel for whole series beside learners on lags."""
    from quarry.plans.timeseries import Horizon

    daily = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("y"))
    got = auto.AutoMLSearch(daily, "y", "time_series_regression", "d", horizon=Horizon("d", gap=0, max_delay=7, forecast_horizon=7), estimators=["LinearRegressor", "DecisionTreeRegressor", "ARIMARegressor", "ExponentialSmoothingRegressor", "ProphetRegressor"]).search()
    return got.rankings().select("pipeline_name", "mean_cv_score")


@register("automl_stack")
def automl_stack(spark, sf_dir):
    got = auto.AutoMLSearch(labelled(spark, sf_dir), "quality", "binary", "doc_id", estimators=["LogisticRegressionClassifier", "DecisionTreeClassifier"], n_splits=2, ensembling=True, max_batches=3).search()
    return got.full_rankings().select("id", "pipeline_name", "batch", "mean_cv_score")
