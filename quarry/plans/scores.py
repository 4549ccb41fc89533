"""Queries over objectives, curves and explanations.

Predictions are fixed expressions of columns, so that SQL can repeat them without a fitted model.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.catalog import register
from quarry.functions import metrics
from quarry.plans import explain
from quarry.sources.tables import table

_P = "round(1.0 / (1.0 + exp(-(0.06 * l_quantity - 8.0 * l_discount - 1.2))), 8)"
_LI = f"(select l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice, case when l_returnflag = 'R' then 1 else 0 end as y, {_P} as p, case when {_P} > 0.5 then 1 else 0 end as yhat from lineitem)"
_PARTS = f"(select sum(case when y = 1 and yhat = 1 then 1 else 0 end)::double as tp, sum(case when y = 0 and yhat = 0 then 1 else 0 end)::double as tn, sum(case when y = 0 and yhat = 1 then 1 else 0 end)::double as fp, sum(case when y = 1 and yhat = 0 then 1 else 0 end)::double as fn from {_LI} t)"


def scored(spark, sf_dir):
    """lineitem with a binary label, a score and its prediction at 0.5."""
    p = F.round(1.0 / (1.0 + F.exp(-(0.06 * F.col("l_quantity") - 8.0 * F.col("l_discount") - 1.2))), 8)
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), p.alias("p"), F.when(p > 0.5, 1).otherwise(0).alias("yhat"))


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) for c in df.columns])


@register("metrics_binary", f'select round((tp + tn) / (tp + tn + fp + fn), 6) as "AccuracyBinary", round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as "BalancedAccuracyBinary", round(2 * tp / (2 * tp + fp + fn), 6) as "F1", round(tp / (tp + fp), 6) as "Precision", round(tp / (tp + fn), 6) as "Recall", round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as "MCCBinary" from {_PARTS} c')
def metrics_binary(spark, sf_dir):
    return rounded(metrics.binary_scores(scored(spark, sf_dir), "y", "yhat"))


_OR = "(select o_orderkey, o_orderstatus as y, case when o_orderkey % 4 = 0 then 'F' when o_totalprice > 250000 then 'O' else o_orderstatus end as yhat from orders)"


def classed(spark, sf_dir):
    """orders with a label of three classes and a prediction."""
    yhat = F.when(F.col("o_orderkey") % 4 == 0, "F").when(F.col("o_totalprice") > 250000, "O").otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("y"), yhat.alias("yhat"))


@register("metrics_multiclass", f'with c as (select c, sum(tp)::double as tp, sum(t)::double as t, sum(p)::double as p from (select y as c, case when y = yhat then 1 else 0 end as tp, 1 as t, 0 as p from {_OR} a union all select yhat, 0, 0, 1 from {_OR} b) u group by 1) select round(sum(tp) / sum(t), 6) as "AccuracyMulticlass", round(avg(tp / t), 6) as "BalancedAccuracyMulticlass", round(avg(2 * tp / (t + p)), 6) as "F1Macro", round(sum(2 * tp / (t + p) * t) / sum(t), 6) as "F1Weighted", round(avg(tp / p), 6) as "PrecisionMacro", round(sum(tp / p * t) / sum(t), 6) as "PrecisionWeighted", round(avg(tp / t), 6) as "RecallMacro", round((sum(tp) * sum(t) - sum(t * p)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))), 6) as "MCCMulticlass" from c')
def metrics_multiclass(spark, sf_dir):
    out = metrics.multiclass_scores(classed(spark, sf_dir), "y", "yhat")
    return rounded(out.select("AccuracyMulticlass", "BalancedAccuracyMulticlass", "F1Macro", "F1Weighted", "PrecisionMacro", "PrecisionWeighted", "RecallMacro", "MCCMulticlass"))


_REG = "(select l_extendedprice as y, 1500.0 * l_quantity as p from lineitem)"


def priced(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (1500.0 * F.col("l_quantity")).alias("p"))


@register("metrics_regression", f'select round(sqrt(avg((y - p) * (y - p))), 4) as "RootMeanSquaredError", round(avg(abs(y - p)), 4) as "MAE", round(quantile_cont(abs(y - p), 0.5), 4) as "MedianAE", round(max(abs(y - p)), 4) as "MaxError", round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as "R2", round(1 - var_pop(y - p) / var_pop(y), 6) as "ExpVariance", round(avg(power(ln(1 + y) - ln(1 + p), 2)), 6) as "MeanSquaredLogError", round(100 * avg(abs(y - p) / abs(y)), 6) as "MAPE", round(100 * avg(2 * abs(y - p) / (abs(y) + abs(p))), 6) as "SMAPE" from {_REG} t')
def metrics_regression(spark, sf_dir):
    out = metrics.regression_scores(priced(spark, sf_dir), "y", "p")
    four = ["RootMeanSquaredError", "MAE", "MedianAE", "MaxError"]
    return out.select(*[F.round(c, 4).alias(c) for c in four], *[F.round(c, 6).alias(c) for c in ("R2", "ExpVariance", "MeanSquaredLogError", "MAPE", "SMAPE")])


@register("metrics_ts", 'with s as (select value, lag(value, 1) over (order by ts) as p from events) select round(avg(abs(value - p)) / (select avg(abs(d)) from (select value - lag(value) over (order by ts) as d from events) t), 6) as "MASE" from s')
def metrics_ts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "value")
    naive = e.withColumn("p", F.lag("value").over(W.partitionBy(F.lit(0)).orderBy("ts"))).where("p is not null")
    return rounded(metrics.mase(naive, "value", "p", e, "value", "ts"))


_RANK = f"(select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from {_LI} t)"


@register("auc", f'select round((sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6)::double as "AUC" from {_RANK} t')
def auc(spark, sf_dir):
    return rounded(metrics.auc(scored(spark, sf_dir), "y", "p").select("AUC"))


@register("gini", f'select round(2 * (sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) - 1, 6)::double as "Gini" from {_RANK} t')
def gini(spark, sf_dir):
    return rounded(metrics.auc(scored(spark, sf_dir), "y", "p").select("Gini"))


@register("log_loss", f'select round(avg(-ln(greatest(least(case when y = 1 then p else 1 - p end, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) as "LogLossBinary" from {_LI} t')
def log_loss(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(s.agg(metrics.log_loss(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))).alias("LogLossBinary")))


_CELL = "(select c.c, case when o.o_orderstatus = c.c then 1 else 0 end as y, case c.c when 'F' then o.f when 'O' then o.o else 1 - o.f - o.o end as s from (select o_orderstatus, 0.2 + 0.6 * (o_orderkey % 7) / 10.0 as f, 0.1 + 0.2 * (o_orderkey % 5) / 10.0 as o from orders) o, (values ('F'), ('O'), ('P')) c(c))"


@register("auc_multiclass", f'with r as (select c, y, rank() over (partition by c order by s) + (count(*) over (partition by c, s) - 1) / 2.0 as r from (select c, y, round(s, 6) as s from {_CELL} t) z), a as (select c, sum(y) as n, (sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as auc from r group by 1) select round(avg(auc), 6)::double as "AUCMacro", round(sum(auc * n) / sum(n), 6)::double as "AUCWeighted" from a')
def auc_multiclass(spark, sf_dir):
    f, o = 0.2 + 0.6 * (F.col("o_orderkey") % 7) / 10.0, 0.1 + 0.2 * (F.col("o_orderkey") % 5) / 10.0
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.round(f, 6).alias("f"), F.round(o, 6).alias("o"), F.round(1 - f - o, 6).alias("p"))
    return rounded(metrics.multiclass_auc(rows, "o_orderstatus", {"F": "f", "O": "o", "P": "p"}).select("AUCMacro", "AUCWeighted"))


_FRAUD = "(select case when o_orderstatus = 'F' then 1 else 0 end as y, case when o_totalprice > 200000 then 1 else 0 end as yhat, o_totalprice as amount from orders)"


def fraud(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), F.when(F.col("o_totalprice") > 200000, 1).otherwise(0).alias("yhat"), F.col("o_totalprice").alias("amount"))


@register("cost_benefit", f'select round(avg(case when y = 1 and yhat = 1 then 10.0 when y = 0 and yhat = 0 then 1.0 when yhat = 1 then -5.0 else -2.0 end), 6)::double as "CostBenefitMatrix" from {_FRAUD} t')
def cost_benefit(spark, sf_dir):
    return rounded(fraud(spark, sf_dir).agg(metrics.cost_benefit(F.col("y"), F.col("yhat"), 10.0, 1.0, -5.0, -2.0).alias("CostBenefitMatrix")))


@register("fraud_cost", f'select round((sum(case when y = 1 and yhat = 0 then amount else 0 end) + sum(case when y = 0 and yhat = 1 then amount * 0.5 * 0.02 else 0 end)) / sum(amount) + (2 - count(distinct yhat)), 6) as "FraudCost" from {_FRAUD} t')
def fraud_cost(spark, sf_dir):
    return rounded(fraud(spark, sf_dir).agg(metrics.fraud_cost(F.col("y"), F.col("yhat"), F.col("amount")).alias("FraudCost")))


@register("lead_scoring", f'select round((sum(case when y = 1 and yhat = 1 then 1 else 0 end) - sum(case when y = 0 and yhat = 1 then 1 else 0 end)) / count(*)::double - (2 - count(distinct yhat)), 6) as "LeadScoring" from {_FRAUD} t')
def lead_scoring(spark, sf_dir):
    return rounded(fraud(spark, sf_dir).agg(metrics.lead_scoring(F.col("y"), F.col("yhat")).cast("double").alias("LeadScoring")))


@register("low_alert", 'with s as (select case when o_orderstatus = \'F\' then 1 else 0 end as y, o_totalprice as p from orders), c as (select quantile_cont(p, 0.99) as cut from s) select round(sum(case when y = 1 and p >= cut then 1 else 0 end) / sum(y)::double, 6) as "SensitivityLowAlert" from s, c')
def low_alert(spark, sf_dir):
    return rounded(metrics.sensitivity_low_alert(fraud(spark, sf_dir).withColumnRenamed("amount", "score"), "y", "score"))


_CURVE = f"(select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, sum(pos) over () as p, sum(neg) over () as n, coalesce(lead(score) over (order by score desc), 0) as nxt from (select p as score, sum(y) as pos, count(*) - sum(y) as neg from {_LI} t group by 1) d)"


@register("threshold_sweep", f"select round(nxt, 6) as threshold, round(2.0 * tp / (2.0 * tp + fp + (p - tp)), 6)::double as value from {_CURVE} c order by 2.0 * tp / (2.0 * tp + fp + (p - tp)) desc, nxt desc limit 1")
def threshold_sweep(spark, sf_dir):
    return rounded(metrics.best_threshold(scored(spark, sf_dir), "y", "p", "F1"))


@register("roc_points", f"select round(score, 8) as threshold, round(fp * 1.0 / n, 6)::double as fpr, round(tp * 1.0 / p, 6)::double as tpr from {_CURVE} c")
def roc_points(spark, sf_dir):
    return metrics.roc_points(scored(spark, sf_dir), "y", "p").select(F.round("threshold", 8).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@register("pr_points", f'select round(score, 8) as threshold, round(tp * 1.0 / (tp + fp), 6)::double as "precision", round(tp * 1.0 / p, 6)::double as recall from {_CURVE} c')
def pr_points(spark, sf_dir):
    return metrics.pr_points(scored(spark, sf_dir), "y", "p").select(F.round("threshold", 8).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


for _name, _of in (("true", "partition by y"), ("pred", "partition by yhat"), ("all", "")):

    def _confusion(spark, sf_dir, how=_name):
        return metrics.confusion(classed(spark, sf_dir), "y", "yhat", how).withColumn("value", F.round("value", 6))

    register(f"confusion_matrix_{_name}", f"select y as label, yhat as predicted, round(count(*) * 1.0 / sum(count(*)) over ({_of}), 6)::double as value from {_OR} t group by y, yhat")(_confusion)


@register("confusion_matrix", f"select y as label, yhat as predicted, count(*)::double as value from {_OR} t group by 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(classed(spark, sf_dir), "y", "yhat", None)


@register("boundary_bins", f"with b as (select least(cast(floor(p * 10) as integer), 9) as bin, sum(y) as pos, count(*) - sum(y) as neg from {_LI} t group by 1) select bin, cast(sum(pos) over (order by bin) as bigint) as fn, cast(sum(neg) over (order by bin) as bigint) as tn, cast(sum(pos) over () - sum(pos) over (order by bin) as bigint) as tp, cast(sum(neg) over () - sum(neg) over (order by bin) as bigint) as fp from b")
def boundary_bins(spark, sf_dir):
    return explain.boundary_bins(scored(spark, sf_dir), "y", "p", 10).select("bin", "fn", "tn", "tp", "fp")


@register("objective_vs_threshold", f"select round(k / 20.0, 6)::double as threshold, round(coalesce(2.0 * sum(case when y = 1 and p > k / 20.0 then 1 else 0 end) / nullif(2.0 * sum(case when y = 1 and p > k / 20.0 then 1 else 0 end) + sum(case when y = 0 and p > k / 20.0 then 1 else 0 end) + sum(case when y = 1 and p <= k / 20.0 then 1 else 0 end), 0), 0), 6)::double as score from {_LI} t, generate_series(0, 20) g(k) group by k")
def objective_vs_threshold(spark, sf_dir):
    return explain.objective_vs_threshold(scored(spark, sf_dir), "y", "p", "F1", 20).select(F.round("threshold", 6).alias("threshold"), F.round("score", 6).alias("score"))


_GRID = "(select distinct l_discount as v from lineitem)"


@register("partial_dependence", f"select round(v, 4) as value, round(avg(1.0 / (1.0 + exp(-(0.06 * l_quantity - 8.0 * v - 1.2)))), 6) as average from lineitem, {_GRID} g group by v")
def partial_dependence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount")
    predict = lambda c: 1.0 / (1.0 + F.exp(-(0.06 * c["l_quantity"] - 8.0 * c["l_discount"] - 1.2)))
    out = explain.partial_dependence(li, "l_discount", predict, resolution=100)
    return out.select(F.round("value", 4).alias("value"), F.round("average", 6).alias("average"))


@register("partial_dependence_two_way", "select round(d.v, 4) as value_1, round(q.v, 4) as value_2, round(avg(1.0 / (1.0 + exp(-(0.06 * q.v - 8.0 * d.v - 1.2 + 0.0 * l_tax)))), 6) as average from lineitem, (select distinct l_discount as v from lineitem) d, (values (1.0), (25.0), (50.0)) q(v) group by 1, 2")
def partial_dependence_two_way(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax")
    predict = lambda c: 1.0 / (1.0 + F.exp(-(0.06 * c["l_quantity"] - 8.0 * c["l_discount"] - 1.2 + 0.0 * c["l_tax"])))
    out = explain.partial_dependence_two_way(li, "l_discount", "l_quantity", predict, second=[1.0, 25.0, 50.0])
    return out.select(F.round("value_1", 4).alias("value_1"), F.round("value_2", 4).alias("value_2"), F.round("average", 6).alias("average"))


@register("ice", "select o_orderkey, g.v::double as value, round(o_totalprice * 0.5 + g.v * 10.0, 4) as prediction from orders, (values (0), (1), (2)) g(v)")
def ice(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(0.0).alias("x"))
    out = explain.ice(o, "x", lambda c: c["o_totalprice"] * 0.5 + c["x"] * 10.0, [0.0, 1.0, 2.0])
    return out.select("o_orderkey", "value", F.round("prediction", 4).alias("prediction"))


_SHUFFLE = "with r as (select o_totalprice, case when o_orderstatus = 'F' then 1.0 else 0.0 end as y, row_number() over (order by o_orderkey) as i, row_number() over (order by (o_orderkey % 2147483647 * 48271) % 2147483647, o_orderkey) as j from orders)"


@register("permutation_importance", _SHUFFLE + " select round(avg(power(a.y - 0.000003 * b.o_totalprice, 2)) - avg(power(a.y - 0.000003 * a.o_totalprice, 2)), 6) as importance from r a, r b where a.i = b.j")
def permutation_importance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"))
    error = lambda c: F.avg(F.pow(F.col("y") - 0.000003 * c["o_totalprice"], F.lit(2)))
    return rounded(explain.permutation_importance(o, "o_orderkey", "o_totalprice", error).select("importance"))


_MEANS = "(select avg(p_size) as ms, avg(p_retailprice) as mp from part)"


@register("linear_contributions", f"select p_partkey, feature, round(v, 6) as contribution from (select *, row_number() over (partition by p_partkey order by abs(v) desc, feature) as r from (select p_partkey, 'p_retailprice' as feature, round(0.002 * (p_retailprice - mp), 9) as v from part, {_MEANS} m union all select p_partkey, 'p_size', round(-0.05 * (p_size - ms), 9) from part, {_MEANS} m) c) t where r <= 1")
def linear_contributions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    out = explain.linear_contributions(p, {"p_retailprice": 0.002, "p_size": -0.05}, ["p_partkey"], top_k=1)
    return out.select("p_partkey", "feature", F.round("contribution", 6).alias("contribution"))


@register("best_worst", "(select o_orderkey, 'best' as kind from orders order by abs(o_totalprice - 150000), o_orderkey limit 5) union all (select o_orderkey, 'worst' from orders order by abs(o_totalprice - 150000) desc, o_orderkey limit 5)")
def best_worst(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.abs(F.col("o_totalprice") - 150000).alias("error"))
    return explain.best_worst(o, "error", "o_orderkey", 5).select("o_orderkey", "kind")


@register("rows_of_interest", f"select l_orderkey, l_linenumber, round(abs(p - 0.5), 6) as distance from {_LI} t where abs(p - 0.5) <= 0.05 and y <> case when p >= 0.5 then 1 else 0 end")
def rows_of_interest(spark, sf_dir):
    out = explain.rows_of_interest(scored(spark, sf_dir), "y", "p", 0.5, 0.05, "incorrect")
    return out.select("l_orderkey", "l_linenumber", F.round("distance", 6).alias("distance"))


_RES = "(select o_orderpriority as pipeline, o_orderstatus, round(avg(o_totalprice) / 500000, 6) as auc, round(avg(o_custkey) / 1000, 6) as loss from orders group by 1, 2) r"


def _results(spark, sf_dir):
    """A score of two kinds for each priority and status, as results of pipelines."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("pipeline"), "o_orderstatus")
    return o.agg(F.round(F.avg("o_totalprice") / 500000, 6).alias("AUC"), F.round(F.avg("o_custkey") / 1000, 6).alias("LogLossBinary"))


@register("rankings", f'select pipeline, max(auc)::double as "AUC" from {_RES} group by 1')
def rankings(spark, sf_dir):
    from quarry.plans import search

    return search.best_per_name(_results(spark, sf_dir), "pipeline", "AUC", True).select("pipeline", "AUC")


@register("recommendation", f"select pipeline || o_orderstatus as pipeline, round(100 * (0.5 * auc + 0.5 * (1 - (loss - least(min(loss) over (), 0)) / (greatest(max(loss) over (), 0) - least(min(loss) over (), 0)))), 4)::double as recommendation from {_RES}")
def recommendation(spark, sf_dir):
    named = _results(spark, sf_dir).withColumn("pipeline", F.concat("pipeline", "o_orderstatus"))
    return metrics.recommendation(named, ["AUC", "LogLossBinary"]).withColumn("recommendation", F.round("recommendation", 4))


_CORR = "(select 'l_quantity' as f, corr(l_quantity, l_extendedprice) as v from lineitem union all select 'l_discount', corr(l_discount, l_extendedprice) from lineitem union all select 'l_tax', corr(l_tax, l_extendedprice) from lineitem) c"


@register("influential_features", f"select f as feature, case when v < 0 then 'detrimental' when s >= 0.2 then 'heavy' when s >= 0.05 then 'somewhat' end as influence from (select f, v, greatest(v, 0) / sum(abs(v)) over () as s from {_CORR}) t where v < 0 or s >= 0.05")
def influential_features(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax"]
    one = table(spark, sf_dir, "lineitem").agg(*[F.corr(c, "l_extendedprice").alias(c) for c in names])
    imp = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in names])))
    return explain.influential_features(imp).select("feature", "influence")
