"""Queries of operators that the other modules' queries do not reach."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quarry import schema
from quarry.catalog import register
from quarry.functions import metrics, ordered, utils
from quarry.operators import columns, encode, impute, sample, series, split
from quarry.plans import estimators as est
from quarry.plans import explain, profile, search
from quarry.plans.checks import HOLED
from quarry.sources.tables import holed_events, number_of_features, table, target_distribution

_MODEL = "(select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) as y, l_extendedprice * 0.95 as p from lineitem)"


def rated(spark, sf_dir):
    """Lines with the discounted price as label and a fixed share of the price as prediction."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"), (F.col("l_extendedprice") * 0.95).alias("p"))


# Sources, columns ------------------------------------------------------------------------------------------------------


@register("feature_types", "select * from (values ('Numeric', 3), ('DateTime', 1), ('Categorical', 2)) t(type, n_features)")
def feature_types(spark, sf_dir):
    return number_of_features(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"))


@register("target_shares", "select o_orderstatus, printf('%.2f%%', 100.0 * count(*) / sum(count(*)) over ()) as share from orders group by 1")
def target_shares(spark, sf_dir):
    return target_distribution(table(spark, sf_dir, "orders"), "o_orderstatus")


@register("drop_columns", "select event_id, ts, user_id from events")
def drop_columns(spark, sf_dir):
    return columns.DropColumns(columns=["value", "event_type", "props"]).fit_transform(table(spark, sf_dir, "events"))


@register("select_columns", "select value, event_id from events")
def select_columns(spark, sf_dir):
    return columns.SelectColumns(columns=["value", "absent", "event_id"]).fit_transform(table(spark, sf_dir, "events"))


@register("replace_nullable", f"select event_id, (case when value is not null then user_id end)::double as u, case when event_type is not null then cast(value > 50 as varchar) end as b from {HOLED} e")
def replace_nullable(spark, sf_dir):
    e = holed_events(spark, sf_dir)
    t = e.select("event_id", F.when(F.col("value").isNotNull(), F.col("user_id")).alias("u"), F.when(F.col("event_type").isNotNull(), F.col("value") > 50).alias("b"))
    return columns.ReplaceNullableTypes().fit_transform(t)


@register("bool_to_double", "select o_orderkey, (o_totalprice > 100000)::int::double as dear from orders")
def bool_to_double(spark, sf_dir):
    return columns.bool_to_double(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("dear")))


@register("float_categories", "select l_orderkey, l_linenumber, cast(cast(l_quantity as bigint) as varchar) as q from lineitem")
def float_categories(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", columns.float_category(F.col("l_quantity").cast("double")).alias("q"))


@register("pad_rows", "select event_id, value from events union all select -1, null union all select -2, null union all select -3, null")
def pad_rows(spark, sf_dir):
    return columns.pad_with_nulls(table(spark, sf_dir, "events").select("event_id", "value"), 3, "event_id")


@register("all_numeric", "select true as lines, false as orders, false as holed")
def all_numeric(spark, sf_dir):
    names = {"lines": table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax"), "orders": table(spark, sf_dir, "orders"), "holed": holed_events(spark, sf_dir).select("value")}
    return spark.createDataFrame([tuple(columns.is_all_numeric(df) for df in names.values())], ", ".join(f"{k} boolean" for k in names))


@register("label_round_trip", "select o_orderkey, o_orderpriority from orders")
def label_round_trip(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    step = encode.LabelEncoder().fit(o, "o_orderpriority")
    return step.inverse_transform(step.transform(o))


@register("inferred_types", "select * from (values ('o_orderkey', 'integer'), ('o_custkey', 'integer'), ('o_orderstatus', 'category'), ('o_totalprice', 'double'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'category')) t(name, kind)")
def inferred_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    got = schema.logical_types(schema.infer(o))
    return spark.createDataFrame([(k, got[k]) for k in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")], "name string, kind string")


@register("schemas_equal", "select true as same, false as other")
def schemas_equal(spark, sf_dir):
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    loose = o.withColumn("o_custkey", F.col("o_custkey").cast("double"))
    return spark.createDataFrame([(schema.schema_equal(o.schema, loose.schema), schema.schema_equal(o.schema, e.schema))], "same boolean, other boolean")


@register("imputed_types", "select * from (values ('a', 'double'), ('b', 'integer'), ('c', 'category')) t(name, kind)")
def imputed_types(spark, sf_dir):
    got = utils.imputed_types({"a": "integer", "b": "integer", "c": "category"}, {"a": "mean", "b": "most_frequent", "c": "most_frequent"})
    return spark.createDataFrame(list(got.items()), "name string, kind string")


@register("matched_rows", "select o_orderkey, o_totalprice, o_orderstatus from orders")
def matched_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return utils.matched(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderstatus"), "o_orderkey")


@register("seconds", "select * from (values ('3 hours', 10800.0::double), ('10 s', 10.0), ('1 minute', 60.0)) t(said, seconds)")
def seconds(spark, sf_dir):
    return spark.createDataFrame([(t, utils.convert_to_seconds(t)) for t in ("3 hours", "10 s", "1 minute")], "said string, seconds double")


# Samplers, splits ------------------------------------------------------------------------------------------------------

_RARE = "(select case when o_totalprice > 480000 then 'dear' else 'plain' end as c, count(*) as n from orders group by 1)"


@register("oversample_targets", f"select c as class, case when n * 1.0 / m < 0.25 then greatest(n, cast(floor(m * 0.25) as bigint)) else n end as rows from {_RARE} r, (select max(n) as m from {_RARE} q) t")
def oversample_targets(spark, sf_dir):
    counts = sample.class_counts(table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") > 480000, "dear").otherwise("plain").alias("c")), "c")
    return spark.createDataFrame(list(sample.oversample_targets(counts).items()), "class string, rows bigint")


@register("chosen_sampler", f"select case when min(n) * 1.0 / max(n) >= 0.25 then 'none' when sum(n) >= 20000 then 'Undersampler' else 'Oversampler' end as sampler from {_RARE} r")
def chosen_sampler(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") > 480000, "dear").otherwise("plain").alias("c"))
    return spark.createDataFrame([(sample.best_sampler(o.count(), sample.class_counts(o, "c")) or "none",)], "sampler string")


@register("resplit", "select o_orderkey, r > ceil(n * 0.25) as trains from (select o_orderkey, row_number() over (order by (o_orderkey % 2147483647 * 48271) % 2147483647, o_orderkey) as r, count(*) over () as n from orders) t")
def resplit(spark, sf_dir):
    train, valid = split.resplit(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.25)
    return train.withColumn("trains", F.lit(True)).union(valid.withColumn("trains", F.lit(False)))


@register("tail_split", "select o_orderkey, dense_rank() over (order by o_orderdate desc) <= (select cast(floor(count(distinct o_orderdate) * 0.1) as bigint) from orders) as is_test from orders")
def tail_split(spark, sf_dir):
    return split.tail_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 0.1).select("o_orderkey", "is_test")


@register("problem_types", "select 'multiclass' as status, 'regression' as price, 'binary' as dear")
def problem_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("dear", F.col("o_totalprice") > 100000)
    return spark.createDataFrame([tuple(split.detect_problem_type(o, c) for c in ("o_orderstatus", "o_totalprice", "dear"))], "status string, price string, dear string")


@register("chosen_split", "select case when (select count(*) from lineitem) > 100000 then 'single' else 'kfold' end as lines, 'stratified' as nations, 'time_series' as series")
def chosen_split(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").count()
    kinds = (split.make_splitter(n, "regression"), split.make_splitter(table(spark, sf_dir, "nation").count(), "binary"), split.make_splitter(n, "time_series_regression"))
    return spark.createDataFrame([tuple(k["kind"] for k in kinds)], "lines string, nations string, series string")


# Order -----------------------------------------------------------------------------------------------------------------


@register("numbered_rows", "select event_id, row_number() over (order by value, event_id) as place from events where value is not null")
def numbered_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id", "value")
    return ordered.numbered(e, "place", "value", "event_id").drop("value")


@register("running_sums", "select event_id, cast(sum(user_id) over (order by event_id desc rows unbounded preceding) as bigint) as so_far from events")
def running_sums(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("bigint").alias("u"))
    return ordered.running(e, {"so_far": "u"}, F.desc("event_id")).drop("u")


@register("value_before", "select event_id, lag(value) over (order by event_id) as before from events")
def value_before(spark, sf_dir):
    return ordered.with_previous(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", "before").drop("value")


# Series ----------------------------------------------------------------------------------------------------------------


@register("time_index", "select 'ts' as name")
def time_index(spark, sf_dir):
    return spark.createDataFrame([(utils.time_index_of(table(spark, sf_dir, "events")),)], "name string")


@register("dates_needed", "select strftime(max(o_orderdate) - interval 9 day, '%Y-%m-%d') as first, strftime(max(o_orderdate) - interval 2 day, '%Y-%m-%d') as last from orders")
def dates_needed(spark, sf_dir):
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]
    got = series.dates_needed(last, horizon=5, max_delay=3, gap=1, step=datetime.timedelta(days=1))
    return spark.createDataFrame([tuple(x.strftime("%Y-%m-%d") for x in got)], "first string, last string")


@register("gap_between", "select true as follows, false as touches")
def gap_between(spark, sf_dir):
    last, day = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0], datetime.timedelta(days=1)
    return spark.createDataFrame([(series.separated_by_gap(last, last + 3 * day, 2, day), series.separated_by_gap(last, last + day, 2, day))], "follows boolean, touches boolean")


@register("series_parameters", "select (select count(distinct date_trunc('day', o_orderdate)) from orders) - 3 * 7 > 1 + 7 + 7 as fits, false as too_many")
def series_parameters(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select(F.date_trunc("day", "o_orderdate")).distinct().count()
    return spark.createDataFrame([(series.valid_for_split(1, 7, 7, n, 3), series.valid_for_split(1, 7, 7, n, n))], "fits boolean, too_many boolean")


@register("gapped_config", "select * from (values ('whole', true), ('partial', false)) t(config, complete)")
def gapped_config(spark, sf_dir):
    whole = {"time_index": "d", "gap": 0, "max_delay": 1, "forecast_horizon": 1}
    return spark.createDataFrame([("whole", utils.contains_ts_parameters(whole)[0]), ("partial", utils.contains_ts_parameters({"gap": 0})[0])], "config string, complete boolean")


# Estimators with results that SQL has ----------------------------------------------------------------------------------


@register("baseline_mean", "select l_orderkey, l_linenumber, round(avg(l_extendedprice) over (), 4) as prediction from lineitem")
def baseline_mean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return est.Estimator("BaselineRegressor").fit(li, "l_extendedprice", []).predict(li).select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))


@register("baseline_median", "select n_nationkey, (select quantile_cont(n_regionkey, 0.5) from nation)::double as prediction from nation")
def baseline_median(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return est.Estimator("BaselineRegressor", strategy="median").fit(n, "n_regionkey", []).predict(n).select("n_nationkey", "prediction")


@register("baseline_mode", "select doc_id, (select quality from labels group by 1 order by count(*) desc, 1 limit 1)::double as prediction from labels")
def baseline_mode(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return est.Estimator("BaselineClassifier").fit(t, "quality", []).predict(t).select("doc_id", "prediction")


@register("simple_regression", "select l_orderkey, l_linenumber, round(regr_intercept(l_extendedprice, l_quantity) over () + regr_slope(l_extendedprice, l_quantity) over () * l_quantity, 2) as prediction from lineitem")
def simple_regression(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return est.Estimator("LinearRegressor").fit(li, "l_extendedprice", ["l_quantity"]).predict(li).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


@register("regression_coefficients", "select 'Intercept' as feature, round(regr_intercept(l_extendedprice, l_quantity), 2) as coefficient from lineitem union all select 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 2) from lineitem")
def regression_coefficients(spark, sf_dir):
    fitted = est.Estimator("LinearRegressor").fit(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return explain.coefficients(spark, fitted).withColumn("coefficient", F.round("coefficient", 2))


_DAY = "(select date_trunc('day', o_orderdate) as d, sum(o_totalprice) as y from orders group by 1)"


@register("series_baseline", f"select strftime(d, '%Y-%m-%d') as day, round(p, 4) as prediction from (select d, row_number() over (order by d) as i, count(*) over () as n from {_DAY} t) a join (select y as p, n - i as back from (select y, row_number() over (order by d) as i, count(*) over () as n from {_DAY} t where d < (select max(d) - interval 6 day from {_DAY} m)) q) b on b.back = 6 - (i - (n - 7) - 1) where a.d >= (select max(d) - interval 6 day from {_DAY} m) and (select count(*) from {_DAY} w where d >= (select max(d) - interval 6 day from {_DAY} m)) = 7")
def series_baseline(spark, sf_dir):
    """The last week predicted by the week before, where every one of its days has orders."""
    daily = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("y"))
    first = daily.agg((F.max("d") - F.expr("interval 6 days")).alias("m")).first()["m"]
    test = daily.where(F.col("d") >= F.lit(first))
    if test.count() != 7:
        return test.limit(0).select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.col("y").alias("prediction"))
    model = est.Estimator("TimeSeriesBaselineEstimator", time_index="d", gap=0, forecast_horizon=7).fit(daily.where(F.col("d") < F.lit(first)), "y", [])
    return model.predict(test).select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.round("prediction", 4).alias("prediction"))


# Objectives, explanations, search --------------------------------------------------------------------------------------


@register("log_loss_multiclass", "select round(avg(-ln(case when o_orderstatus = 'F' then 0.5 when o_orderstatus = 'O' then 0.3 else 0.2 end)), 6) as loss from orders")
def log_loss_multiclass(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.lit("F").alias("p"), F.lit(0.5).alias("f"), F.lit(0.3).alias("o"), F.lit(0.2).alias("q"))
    got = metrics.score_all(o, "multiclass", ["LogLossMulticlass"], "o_orderstatus", "p", probas={"F": "f", "O": "o", "P": "q"})
    return spark.createDataFrame([(round(got.values["LogLossMulticlass"], 6),)], "loss double")


@register("percent_better", "select * from (values ('AUC', 10.0::double), ('LogLossBinary', 50.0), ('R2', 20.0)) t(objective, per_cent)")
def percent_better(spark, sf_dir):
    rows = [("AUC", 0.8, 0.7), ("LogLossBinary", 0.3, 0.6), ("R2", 0.6, 0.5)]
    return spark.createDataFrame([(n, round(metrics.objective(n).percent_better(a, b), 6)) for n, a, b in rows], "objective string, per_cent double")


@register("prediction_table", f"select round(p, 4) as prediction, round(y, 4) as actual, abs(p - y) >= 2000 as outlier from {_MODEL} m")
def prediction_table(spark, sf_dir):
    return explain.prediction_vs_actual(rated(spark, sf_dir), "y", "p", 2000.0).select(F.round("prediction", 4).alias("prediction"), F.round("actual", 4).alias("actual"), "outlier")


@register("cross_entropies", "select l_orderkey, l_linenumber, round(-ln(greatest(l_discount, 2.220446049250313e-16)), 6) as loss from lineitem")
def cross_entropies(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(explain.cross_entropy(F.col("l_discount")), 6).alias("loss"))


@register("contribution_shares", "select p_partkey, f as feature, round(case when abs(a) + abs(b) > 0 then v / (abs(a) + abs(b)) else 0 end, 6) as share from (select p_partkey, 0.002 * p_retailprice as a, -0.05 * p_size as b from part) t, lateral (select 'p_retailprice' as f, a as v union all select 'p_size', b) x")
def contribution_shares(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cells = F.inline(F.array(F.struct(F.lit("p_retailprice").alias("feature"), (0.002 * F.col("p_retailprice")).alias("contribution")), F.struct(F.lit("p_size").alias("feature"), (-0.05 * F.col("p_size")).alias("contribution"))))
    return explain.normalised_contributions(p.select("p_partkey", cells), ["p_partkey"]).select("p_partkey", "feature", F.round("share", 6).alias("share"))


@register("distribution_test", "select round(sum((p - t) * (p - t) * 1.0 / t), 6) as statistic from (select o_orderstatus as c, count(*) as t, sum(case when o_orderstatus = 'F' then 1 else 0 end) as own, (select count(*) from orders) as n from orders group by 1) a, lateral (select case when c = 'F' then t + (select count(*) from orders where o_orderstatus = 'P' and o_totalprice > 400000) when c = 'P' then t - (select count(*) from orders where o_orderstatus = 'P' and o_totalprice > 400000) else t end as p) b")
def distribution_test(spark, sf_dir):
    moved = F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000), "F").otherwise(F.col("o_orderstatus"))
    stat, _ = explain.chi_square(table(spark, sf_dir, "orders").select("o_orderstatus", moved.alias("p")), "o_orderstatus", "p")
    return spark.createDataFrame([(round(stat, 6),)], "statistic double")


@register("mostly_one", "select (select max(n) * 1.0 / sum(n) + 0.01 >= 0.95 from (select count(*) as n from orders group by o_orderstatus) a) as status, (select max(n) * 1.0 / sum(n) + 0.01 >= 0.3 from (select count(*) as n from orders group by o_orderstatus) a) as loosely")
def mostly_one(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return spark.createDataFrame([(explain.mostly_one_value(o, "o_orderstatus", 0.95), explain.mostly_one_value(o, "o_orderstatus", 0.3))], "status boolean, loosely boolean")


@register("multicollinearity", "select count(*) as n from (values ('l_quantity', 'twice')) t(a, b)")
def multicollinearity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", (2 * F.col("l_quantity")).alias("twice"), "l_tax")
    pairs = [p for m in profile.multicollinearity_check(li) for p in m.details["columns"]]
    return spark.createDataFrame([(sum(p == ("l_quantity", "twice") for p in pairs),)], "n bigint")


@register("search_grid", "select c::double as c, k::bigint as k from (values (0.01), (5.005), (10.0)) a(c), (values (2), (7), (12)) b(k)")
def search_grid(spark, sf_dir):
    tuner, rows = search.GridSearchTuner({"c": (0.01, 10.0), "k": (2, 12)}, n_points=3), []
    while not tuner.search_space_exhausted():
        p = tuner.propose()
        rows.append((p["c"], p["k"]))
    return spark.createDataFrame(rows, "c double, k bigint")


@register("influence_text", "select 'price is heavily influenced by quantity; somewhat influenced by tax. Detrimental: discount.' as text")
def influence_text(spark, sf_dir):
    rows = spark.createDataFrame([("quantity", "heavy"), ("tax", "somewhat"), ("discount", "detrimental")], "feature string, influence string")
    return spark.createDataFrame([(explain.readable(rows, "price"),)], "text string")


@register("imputed_by_type", f"select event_id, coalesce(event_type, (select event_type from {HOLED} m where event_type is not null group by 1 order by count(*) desc, event_type limit 1)) as event_type, round(coalesce(value, (select quantile_cont(value, 0.5) from {HOLED} q)), 6) as value from {HOLED} e")
def imputed_by_type(spark, sf_dir):
    e = holed_events(spark, sf_dir).select("event_id", "event_type", "value")
    return impute.Imputer(numeric_impute_strategy="median").fit(e).transform(e).withColumn("value", F.round("value", 6))
