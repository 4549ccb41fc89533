"""Profiling queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.catalog import register
from quarry.operators import series as ts
from quarry.plans import profile
from quarry.sources.tables import holed_events, table

#: events with nulls put into fixed places, for both engines.
HOLED = "(select event_id, ts, user_id, case when event_id % 5 = 0 then null else event_type end as event_type, case when event_id % 3 = 0 then null else value end as value from events)"


@register(
    "class_imbalance",
    "select o_orderstatus as class, count(*) as n, round(count(*) / (count(*) + max(count(*)) over ()), 6) as share from orders group by 1",
)
def class_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / (F.col("n") + F.max("n").over(W.partitionBy(F.lit(0)))), 6))


@register(
    "null_columns",
    f"select 'event_type' as column_name, round(avg(case when event_type is null then 1.0 else 0.0 end), 6) as share from {HOLED} e union all select 'value', round(avg(case when value is null then 1.0 else 0.0 end), 6) from {HOLED} e",
)
def null_columns(spark, sf_dir):
    e = holed_events(spark, sf_dir)
    one = e.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in ("event_type", "value")])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(c, 6).alias("share")) for c in ("event_type", "value")])))


@register("null_rows", f"select event_id, ((case when event_type is null then 1 else 0 end) + (case when value is null then 1 else 0 end)) / 2.0::double as pct_null from {HOLED} e where event_type is null and value is null")
def null_rows(spark, sf_dir):
    return profile.null_rows(holed_events(spark, sf_dir), ["event_type", "value"], 0.95).select("event_id", "pct_null")


@register(
    "id_columns",
    " union all ".join(f"select '{c}' as column_name, case when count(distinct {c}) = count(*) then 0.95 else 0.0 end::double as score from orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")),
)
def id_columns(spark, sf_dir):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    o = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(c) for c in names])
    return o.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.col(c) == F.col("n"), 0.95).otherwise(0.0).alias("score")) for c in names])))


@register("no_variance", " union all ".join(f"select '{c}' as column_name, count(distinct {c}) as n_values, count(*) - count({c}) as n_nulls from part" for c in ("p_brand", "p_type", "p_size")))
def no_variance(spark, sf_dir):
    names = ["p_brand", "p_type", "p_size"]
    p = table(spark, sf_dir, "part").agg(*[f for c in names for f in (F.count_distinct(c).alias(f"d_{c}"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}"))])
    return p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d_{c}").alias("n_values"), F.col(f"n_{c}").alias("n_nulls")) for c in names])))


_CELLS = "(select 'event_type' as c, event_type as v from events union all select 'user_id', cast(user_id as varchar) from events)"


def _cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in ("event_type", "user_id")])))


@register("uniqueness", f"select c as column_name, round(1 - sum(n * 1.0 * n) / (sum(n) * 1.0 * sum(n)), 6)::double as uniqueness from (select c, v, count(*) as n from {_CELLS} t group by 1, 2) u group by 1")
def uniqueness(spark, sf_dir):
    n = _cells(spark, sf_dir).groupBy("c", "v").count()
    return n.groupBy(F.col("c").alias("column_name")).agg(F.round(1 - F.sum(F.pow("count", F.lit(2.0))) / F.pow(F.sum("count"), F.lit(2.0)), 6).alias("uniqueness"))


@register("sparsity", f"select c as column_name, round(avg(case when n > 10 then 1.0 else 0.0 end), 6) as sparsity from (select c, v, count(*) as n from {_CELLS} t group by 1, 2) u group by 1")
def sparsity(spark, sf_dir):
    n = _cells(spark, sf_dir).groupBy("c", "v").count()
    return n.groupBy(F.col("c").alias("column_name")).agg(F.round(F.avg((F.col("count") > 10).cast("double")), 6).alias("sparsity"))


_BOX = "(select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as q2, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem)"


@register("outlier_fences", f"select round(q1, 4) as q1, round(q2, 4) as median, round(q3, 4) as q3, round(q1 - 1.5 * (q3 - q1), 4) as low_bound, round(q3 + 1.5 * (q3 - q1), 4) as high_bound from {_BOX} b")
def outlier_fences(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").agg(F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q1, q2, q3 = (F.get("q", F.lit(i)) for i in range(3))
    return q.select(*[F.round(v, 4).alias(k) for k, v in {"q1": q1, "median": q2, "q3": q3, "low_bound": q1 - 1.5 * (q3 - q1), "high_bound": q3 + 1.5 * (q3 - q1)}.items()])


@register("outlier_rows", "select o_orderkey from orders, (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders) b where o_totalprice < q1 - 0.3 * (q3 - q1) or o_totalprice > q3 + 0.3 * (q3 - q1)")
def outlier_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    q = o.agg(F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select(F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    low, high = F.col("q1") - 0.3 * (F.col("q3") - F.col("q1")), F.col("q3") + 0.3 * (F.col("q3") - F.col("q1"))
    return o.crossJoin(F.broadcast(q)).where((F.col("o_totalprice") < low) | (F.col("o_totalprice") > high)).select("o_orderkey")  # q has one row


@register("target_corr", "select round(corr(l_quantity, l_extendedprice), 6) as pearson from lineitem")
def target_corr(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"))


@register("rank_corr", "select round(corr(a, b), 6) as spearman from (select rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0 as a, rank() over (order by c_nationkey) + (count(*) over (partition by c_nationkey) - 1) / 2.0 as b from customer) t")
def rank_corr(spark, sf_dir):
    rank = lambda c: F.rank().over(W.partitionBy(F.lit(0)).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / 2
    c = table(spark, sf_dir, "customer").select(rank("c_acctbal").alias("a"), rank("c_nationkey").alias("b"))
    return c.agg(F.round(F.corr("a", "b"), 6).alias("spearman"))


@register(
    "mutual_information",
    "with j as (select o_orderstatus as a, o_orderpriority as b, count(*) * 1.0 / sum(count(*)) over () as p from orders group by 1, 2), m as (select p, sum(p) over (partition by a) as pa, sum(p) over (partition by b) as pb from j) select round(sum(p * ln(p / (pa * pb))), 8) as mi from m",
)
def mutual_information(spark, sf_dir):
    j = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").count()
    p = j.select("o_orderstatus", "o_orderpriority", (F.col("count") / F.sum("count").over(W.partitionBy(F.lit(0)))).alias("p"))
    m = p.select("p", F.sum("p").over(W.partitionBy("o_orderstatus")).alias("pa"), F.sum("p").over(W.partitionBy("o_orderpriority")).alias("pb"))
    return m.agg(F.round(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))), 8).alias("mi"))


@register(
    "jarque_bera",
    "with m as (select avg(o_totalprice) as mu from orders), c as (select avg(power(o_totalprice - mu, 2)) as m2, avg(power(o_totalprice - mu, 3)) as m3, avg(power(o_totalprice - mu, 4)) as m4, count(*) as n from orders, m) select round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 4) as jb from c",
)
def jarque_bera(spark, sf_dir):
    got = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.skewness("o_totalprice").alias("s"), F.kurtosis("o_totalprice").alias("k"))
    return got.select(F.round(F.col("n") / 6 * (F.pow("s", F.lit(2)) + F.pow("k", F.lit(2)) / 4), 4).alias("jb"))


#: Days without an order above this price are the gaps of a calendar of days.
CUT = 337_000
_DAYS = f"(select distinct date_trunc('day', o_orderdate) as d from orders where o_totalprice > {CUT})"


@register("datetime_gaps", f"select strftime(g.d, '%Y-%m-%d') as missing from (select unnest(generate_series((select min(d) from {_DAYS} a), (select max(d) from {_DAYS} b), interval 1 day)) as d) g left join {_DAYS} t on g.d = t.d where t.d is null")
def datetime_gaps(spark, sf_dir):
    days = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > CUT).select(F.date_trunc("day", "o_orderdate").alias("d")).distinct()
    return ts.calendar(days, "d", 86400).join(days, "d", "left_anti").select(F.date_format("d", "yyyy-MM-dd").alias("missing"))


@register("datetime_dups", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as n from events group by 1 having count(*) > 1")
def datetime_dups(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return e.where("n > 1")


@register("series_length", "with s as (select user_id, count(*) as n from events group by 1), m as (select n from s group by 1 order by count(*) desc, n desc limit 1) select user_id, s.n, m.n as majority from s, m where s.n <> m.n")
def series_length(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    major = s.groupBy(F.col("n").alias("majority")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("majority")).limit(1).select("majority")
    return s.crossJoin(F.broadcast(major)).where("n != majority")  # one row


@register("invalid_target", "select count(*) as n, count(o_orderstatus) as n_known, count(distinct o_orderstatus) as n_classes, (select count(*) from (select o_orderstatus from orders group by 1 having count(*) < 2) s) as n_single from orders")
def invalid_target(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    by_class = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("c"))
    return by_class.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("o_orderstatus").isNotNull(), F.col("c"))), F.lit(0)).alias("n_known"), F.count("o_orderstatus").alias("n_classes"), F.count(F.when(F.col("c") < 2, 1)).alias("n_single"))


@register("ts_split_classes", "with r as (select event_type, row_number() over (order by ts) as i, count(*) over () as n from events) select s as split, count(distinct event_type) as n_classes from r, generate_series(0, 2) g(s) where i <= n - (3 - s) * 50 group by 1")
def ts_split_classes(spark, sf_dir):
    from quarry.operators.split import time_series_split

    e = table(spark, sf_dir, "events").select("ts", "event_type")
    return time_series_split(e, "ts", 3, 50).where("not is_test").groupBy(F.col("split").cast("bigint").alias("split")).agg(F.count_distinct("event_type").alias("n_classes"))


@register("check_messages")
def check_messages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return profile.as_table(spark, profile.default_checks(o, "o_orderstatus", "multiclass"))
