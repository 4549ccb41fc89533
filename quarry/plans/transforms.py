"""Queries over feature transforms, samplers, series operators and splitters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.catalog import register
from quarry.operators import columns, encode, featurize, impute, sample, series, split
from quarry.plans.checks import CUT, HOLED
from quarry.sources.tables import holed_events, table


@register("impute_mean", f"select event_id, round(coalesce(value, avg(value) over ()), 6) as value from {HOLED} e")
def impute_mean(spark, sf_dir):
    out = impute.SimpleImputer(impute_strategy="mean").fit_transform(holed_events(spark, sf_dir).select("event_id", "value"))
    return out.select("event_id", F.round("value", 6).alias("value"))


@register("impute_median", f"select event_id, round(coalesce(value, (select quantile_cont(value, 0.5) from {HOLED} m)), 6) as value from {HOLED} e")
def impute_median(spark, sf_dir):
    out = impute.SimpleImputer(impute_strategy="median").fit_transform(holed_events(spark, sf_dir).select("event_id", "value"))
    return out.select("event_id", F.round("value", 6).alias("value"))


@register("impute_mode", f"select event_id, coalesce(event_type, (select event_type from {HOLED} m where event_type is not null group by 1 order by count(*) desc, event_type limit 1)) as event_type from {HOLED} e")
def impute_mode(spark, sf_dir):
    return impute.Imputer().fit_transform(holed_events(spark, sf_dir).select("event_id", "event_type"))


@register("impute_constant", f"select event_id, coalesce(event_type, 'none') as event_type, coalesce(value, 0) as value from {HOLED} e")
def impute_constant(spark, sf_dir):
    e = holed_events(spark, sf_dir).select("event_id", "event_type", "value")
    return impute.PerColumnImputer(impute_strategies={"event_type": {"impute_strategy": "constant", "fill_value": "none"}, "value": {"impute_strategy": "constant", "fill_value": 0.0}, "event_id": {"impute_strategy": "constant", "fill_value": 0}}).fit_transform(e)


_BACK = "last_value(value ignore nulls) over (partition by user_id order by ts rows between unbounded preceding and current row)"
_AHEAD = "first_value(value ignore nulls) over (partition by user_id order by ts rows between current row and unbounded following)"


def _filled(spark, sf_dir, how):
    e = holed_events(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    p = {"time_index": "ts", "series_id": "user_id", "numeric_impute_strategy": how}
    held = e.withColumn("event_id", F.col("event_id").cast("string"))
    return impute.TimeSeriesImputer(**p).fit(held).transform(held).select(F.col("event_id").cast("bigint").alias("event_id"), F.round("value", 6).alias("value"))


@register("impute_ffill", f"select event_id, round(coalesce({_BACK}, {_AHEAD}), 6) as value from {HOLED} e")
def impute_ffill(spark, sf_dir):
    return _filled(spark, sf_dir, "forwards_fill")


@register("impute_bfill", f"select event_id, round(coalesce({_AHEAD}, {_BACK}), 6) as value from {HOLED} e")
def impute_bfill(spark, sf_dir):
    return _filled(spark, sf_dir, "backwards_fill")


@register(
    "impute_interpolate",
    f"with r as (select *, row_number() over (partition by user_id order by ts) as i from {HOLED} e), w as (select *, {_BACK} as x0, {_AHEAD} as x1, {_BACK.replace('value ignore', 'p ignore')} as p0, {_AHEAD.replace('value ignore', 'p ignore')} as p1 from (select *, case when value is not null then i end as p from r) q) select event_id, round(coalesce(value, x0 + (x1 - x0) * (i - p0) / nullif(p1 - p0, 0), x0, x1), 6) as value from w",
)
def impute_interpolate(spark, sf_dir):
    return _filled(spark, sf_dir, "interpolate")


@register("impute_target", f"select event_id, coalesce(event_type, (select event_type from {HOLED} m where event_type is not null group by 1 order by count(*) desc, event_type limit 1)) as event_type from {HOLED} e")
def impute_target(spark, sf_dir):
    e = holed_events(spark, sf_dir)
    return impute.TargetImputer().fit(e, "event_type").transform(e).select("event_id", "event_type")


_KNN = "(select l_quantity, case when l_returnflag <> 'R' then l_extendedprice end as p, l_discount from lineitem)"


@register("impute_knn", f"with q as (select distinct l_quantity, l_discount from {_KNN} a where p is null), r as (select q.l_quantity, q.l_discount, k.p, row_number() over (partition by q.l_quantity, q.l_discount order by ((q.l_quantity - k.l_quantity) * (q.l_quantity - k.l_quantity) + (q.l_discount - k.l_discount) * (q.l_discount - k.l_discount)) / 2, k.p) as i from q, {_KNN} k where k.p is not null), m as (select l_quantity, l_discount, avg(p) as m from r where i <= 3 group by 1, 2) select a.l_quantity, round(coalesce(a.p, m.m), 3) as l_extendedprice, a.l_discount from {_KNN} a left join m using (l_quantity, l_discount)")
def impute_knn(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("l_extendedprice"), "l_discount")
    return impute.KNNImputer().fit(li).transform(li).withColumn("l_extendedprice", F.round("l_extendedprice", 3))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@register("onehot_topn", "with t as (select c_mktsegment as v, row_number() over (order by count(*) desc, c_mktsegment) as r from customer group by 1) select v as category, r <= 3 as encoded, (select count(*) from customer c where c.c_mktsegment = t.v and t.r <= 3) as n from t")
def onehot_topn(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment")
    e = encode.OneHotEncoder(top_n=3).fit(c)
    kept = e.categories("c_mktsegment")
    return e.transform(c.withColumn("category", F.col("c_mktsegment"))).groupBy("category").agg(F.sum(sum([F.col(f"`{n}`").cast("bigint") for n in e.get_feature_names()])).alias("n")).select("category", F.col("category").isin(kept).alias("encoded"), "n")


@register("onehot_binary", "with b as (select p_partkey, case when p_size <= 15 then 'small' else 'large' end as size from part), m as (select size from b group by 1 order by count(*) desc, size limit 1 offset 1) select p_partkey, size = (select size from m) as minority from b")
def onehot_binary(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") <= 15, "small").otherwise("large").alias("size"))
    e = encode.OneHotEncoder(features_to_encode=["size"]).fit(p)
    return e.transform(p).withColumnRenamed(e.get_feature_names()[0], "minority")


@register("ordinal_encode", "select o_orderkey, case substr(o_orderpriority, 1, 1) when '1' then 0.0 when '2' then 1.0 when '3' then 2.0 when '4' then 3.0 else 4.0 end::double as o_orderpriority_ordinal_encoding from orders")
def ordinal_encode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return encode.OrdinalEncoder(features_to_encode=["o_orderpriority"]).fit(o).transform(o)


@register("label_encode", "select o_orderkey, cast(dense_rank() over (order by o_orderstatus) - 1 as integer) as o_orderstatus from orders")
def label_encode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return encode.LabelEncoder().fit(o, "o_orderstatus").transform(o)


@register("target_encode", "with g as (select o_orderpriority as k, avg(o_totalprice) as m, count(*) as n from orders group by 1), p as (select avg(o_totalprice) as prior from orders) select k as category, round(prior * (1 - 1 / (1 + exp(-(n - 20.0)))) + m * (1 / (1 + exp(-(n - 20.0)))), 4) as encoding from g, p")
def target_encode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice").withColumn("category", F.col("o_orderpriority"))
    e = encode.TargetEncoder(cols=["o_orderpriority"]).fit(o, "o_totalprice")
    return e.transform(o).groupBy("category").agg(F.round(F.max("o_orderpriority"), 4).alias("encoding"))


@register("scale_standard", "select l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over (), 6) as l_quantity from lineitem")
def scale_standard(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = encode.StandardScaler().fit(li.select("l_quantity"))
    return s.transform(li).select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"))


@register("pca_variance", "with m as (select avg(l_quantity) as a, avg(l_discount * 100) as b from lineitem), c as (select var_pop(l_quantity) as v1, var_pop(l_discount * 100) as v2, covar_pop(l_quantity, l_discount * 100) as c from lineitem) select round(((v1 + v2) / 2 + sqrt(power((v1 - v2) / 2, 2) + c * c)) / (v1 + v2), 6) as explained from c")
def pca_variance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("discount"))
    p = encode.PCA(n_components=1).fit(li)
    return spark.createDataFrame([(round(p.state["explained"][0], 6),)], "explained double")


@register("lda_projection")
def lda_projection(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    return encode.LinearDiscriminantAnalysis().fit(li, "l_returnflag").transform(li)


@register("date_features", "select o_orderkey, year(o_orderdate)::integer as o_orderdate_year, (month(o_orderdate) - 1)::integer as o_orderdate_month, dayofweek(o_orderdate)::integer as o_orderdate_day_of_week, hour(o_orderdate)::integer as o_orderdate_hour from orders")
def date_features(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return featurize.DateTimeFeaturizer().fit_transform(o)


@register("url_features", r"select page_id, nullif(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1), '') as protocol, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:www\.)?([^/?#:]+)', 1), '') as domain, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#:]*\.([a-zA-Z]+)(?:[/?#:]|$)', 1), '') as tld from pages")
def url_features(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", featurize.url_protocol(u).alias("protocol"), featurize.url_domain(u).alias("domain"), featurize.url_tld(u).alias("tld"))


@register("email_features", "select c_custkey, case c_custkey % 3 when 0 then 'gmail.com' when 1 then 'example.com' end as domain, case c_custkey % 3 when 0 then true when 1 then false end as is_free from customer")
def email_features(spark, sf_dir):
    k = F.col("c_custkey") % 3
    address = F.when(k == 0, F.concat(F.lower("c_name"), F.lit("@gmail.com"))).when(k == 1, F.concat(F.lower("c_name"), F.lit("@example.com"))).otherwise("nobody")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(address, "#", ".").alias("a"))
    domain = featurize.email_domain(F.col("a"))
    return c.select("c_custkey", domain.alias("domain"), domain.isin(*featurize.FREE_DOMAINS).alias("is_free"))


_PUNCTUATION = featurize.PUNCTUATION.replace("'", "''")
_WORDS = f"list_filter(string_split_regex(lower(translate(text, '{_PUNCTUATION}', '')), '\\s+'), lambda w: w <> '')"


@register("text_features", f"select doc_id, len({_WORDS})::integer as num_words, round(len(list_distinct({_WORDS})) * 1.0 / nullif(len({_WORDS}), 0), 6) as diversity, length(lower(translate(text, '{_PUNCTUATION}', '')))::integer as num_characters, round(length(array_to_string({_WORDS}, '')) * 1.0 / nullif(len({_WORDS}), 0), 6) as word_length from documents")
def text_features(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", featurize.text_features(F.col("text")).alias("t"))
    return d.select("doc_id", "t.num_words", F.round("t.diversity_score", 6).alias("diversity"), "t.num_characters", F.round("t.mean_characters_per_word", 6).alias("word_length"))


@register("lsa")
def lsa(spark, sf_dir):
    from quarry import schema

    c = schema.tagged(table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": "text"})
    return featurize.LSA(num_features=256).fit(c).transform(c)


@register("log_target", "with m as (select min(c_acctbal) as lo from customer) select c_custkey, round(ln(c_acctbal + case when lo <= 0 then abs(lo) + 1 else 0 end), 6) as c_acctbal from customer, m")
def log_target(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return featurize.LogTransformer().fit(c, "c_acctbal").transform(c).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@register("log_inverse", "select c_custkey, round(c_acctbal, 2) as c_acctbal from customer")
def log_inverse(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    t = featurize.LogTransformer().fit(c, "c_acctbal")
    return t.inverse_transform(t.transform(c)).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@register("drop_rows", "select event_id from events where event_id not in (1, 5, 7)")
def drop_rows(spark, sf_dir):
    return columns.drop_keys(table(spark, sf_dir, "events").select("event_id"), "event_id", [1, 5, 7])


@register("drop_null_rows", f"select event_id, event_type, value from {HOLED} e where event_type is not null and value is not null")
def drop_null_rows(spark, sf_dir):
    return columns.DropNaNRowsTransformer().fit_transform(holed_events(spark, sf_dir).select("event_id", "event_type", "value"))


@register("drop_null_columns", f"select event_id, event_type from {HOLED} e")
def drop_null_columns(spark, sf_dir):
    return columns.DropNullColumns(pct_null_threshold=0.3).fit_transform(holed_events(spark, sf_dir).select("event_id", "event_type", "value"))


@register("select_by_type", "select event_id, user_id, value from events")
def select_by_type(spark, sf_dir):
    return columns.SelectByType(column_types=("integer", "double")).fit_transform(table(spark, sf_dir, "events"))


_SKEWED = "(select o_orderkey, case when o_totalprice > 480000 then 'dear' else 'plain' end as o_orderstatus from orders)"
_QUOTA = f"(select greatest(cast(floor(min(n) / 0.25) as bigint), 100) as q, min(n) as least from (select count(*) as n from {_SKEWED} s group by o_orderstatus) c)"


@register("undersample", f"select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by ((o_orderkey % 2147483647) * 48271) % 2147483647, o_orderkey) as r, count(*) over (partition by o_orderstatus) as n from {_SKEWED} s) t, {_QUOTA} q where r <= q or n <= q or least * 1.0 / n > 0.25")
def undersample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 480000, "dear").otherwise("plain").alias("o_orderstatus"))
    return sample.Undersampler(key="o_orderkey", min_percentage=0.0).fit(o, "o_orderstatus").transform(o)


@register("smote")
def smote(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").select(F.col("n_chars").cast("double").alias("n_chars"), (F.length("text") * 0.5).alias("half"), "lang", "toxic")
    return sample.Oversampler().fit(d, "toxic").transform(d)


@register("lag_features", "select event_id, lag(value, 2) over w as target_delay_2, lag(value, 3) over w as target_delay_3 from events window w as (partition by user_id order by ts)")
def lag_features(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return series.lags(e, ["value"], [2, 3], "ts", "user_id", {"value": "target"}).select("event_id", "target_delay_2", "target_delay_3")


@register("rolling_gap_mean", "select event_id, case when count(value) over w = 3 then round(avg(value) over w, 6) end as value_rolling_mean from events window w as (partition by user_id order by ts rows between 4 preceding and 2 preceding)")
def rolling_gap_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(series.gapped_mean(F.col("value"), 3, 2, series.series_window("ts", "user_id")), 6).alias("value_rolling_mean"))


_DAILY = "(select date_trunc('day', o_orderdate) as d, sum(o_totalprice) as y from orders group by 1)"


@register("acf", f"with r as (select row_number() over (order by d) as i, y - avg(y) over () as e from {_DAILY} t), v as (select sum(e * e) as s from r) select k::integer as lag, round(sum(a.e * b.e) / max(s), 6) as r from v, generate_series(0, 5) g(k), r a, r b where a.i = b.i - k group by 1")
def acf(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("y"))
    rows = daily.select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("d")).alias("i"), "y")
    values = series.autocorrelations(rows, "y", "i", 5)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(values)], "lag int, r double")


@register("regularize", f"with h as (select distinct date_trunc('day', o_orderdate) as d from orders where o_totalprice > {CUT}) select strftime(g.d, '%Y-%m-%d') as day, h.d is not null as present from (select unnest(generate_series((select min(d) from h), (select max(d) from h), interval 1 day)) as d) g left join h on g.d = h.d")
def regularize(spark, sf_dir):
    days = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > CUT).select(F.date_trunc("day", "o_orderdate").alias("d")).distinct().withColumn("present", F.lit(True))
    out = series.TimeSeriesRegularizer(time_index="d", threshold=0.9).fit(days).transform(days)
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("present", F.lit(False)).alias("present"))


@register("misaligned", "with e as (select date_trunc('hour', ts) + case when event_id % 50 = 0 then interval 20 minute else interval 0 minute end as t from events), h as (select t, count(*) as n from e group by 1), b as (select min(t) as lo, max(t) as hi from e), c as (select unnest(generate_series(lo, hi, interval 1 hour)) as t from b), odd as (select t from h where t not in (select t from c) union select t from h where n > 1), gap as (select t from c where t not in (select t from h)) select strftime(o.t, '%Y-%m-%d %H:%M') as at from odd o where exists (select 1 from gap g where abs(epoch(g.t) - epoch(o.t)) <= 3600)")
def misaligned(spark, sf_dir):
    shift = F.when(F.col("event_id") % 50 == 0, F.expr("interval 20 minutes")).otherwise(F.expr("interval 0 minutes"))
    e = table(spark, sf_dir, "events").select((F.date_trunc("hour", "ts") + shift).alias("t"))
    found = series.classified_timestamps(e, "t", 3600).where("issue = 'misaligned'")
    return found.select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"))


_TYPES = ["click", "login", "logout", "purchase", "view"]


@register("unstack", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, " + ", ".join(f"round(sum(case when user_id = {u} then value end), 4) as \"value|{u}\"" for u in (1, 2, 3)) + " from events group by 1")
def unstack(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.round(F.sum("value"), 4).alias("value"))
    return series.unstack(daily, ["value"], "user_id", "day", [1, 2, 3])


@register("stack", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, u.u as user_id, round(sum(case when user_id = u.u then value end), 4) as value from events, (values (1), (2), (3)) u(u) group by 1, 2")
def stack(spark, sf_dir):
    return series.stack(unstack(spark, sf_dir), "day", "user_id").select("day", F.col("user_id").cast("int").alias("user_id"), "value")


@register("forecast_period", "select user_id, strftime((select max(ts) from events) + interval 1 day * (1 + k), '%Y-%m-%d %H:%M:%S') as at from (select distinct user_id from events) u, generate_series(1, 3) g(k)")
def forecast_period(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    return series.forecast_period(e, "ts", 3, 1, 86400, "user_id").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@register("naive_forecast", "select event_id, lag(value, 3) over (partition by user_id order by ts) as prediction from events")
def naive_forecast(spark, sf_dir):
    return series.naive_forecast(table(spark, sf_dir, "events"), "value", "ts", 1, 2, "user_id").select("event_id", "prediction")


@register("gap_padding", "with d as (select date_trunc('day', o_orderdate) as d, round(sum(o_totalprice), 2) as y from orders group by 1), t as (select * from d where d < (select max(d) from d) - interval 10 day), l as (select * from t order by d desc limit 4), m as (select max(d) as d, arg_max(y, d) as y from t) select strftime(d, '%Y-%m-%d') as day, y from l union all select strftime(m.d + interval 1 day * k, '%Y-%m-%d'), m.y from m, generate_series(1, 2) g(k)")
def gap_padding(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
    last = daily.agg(F.max("d")).first()[0]
    train = daily.where(F.col("d") < F.lit(last) - F.expr("interval 10 days"))
    out = series.with_training_tail(train, daily.where("false"), "d", 4, 2, 86400)
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "y")


_ORDER = "order by ((o_orderkey % 2147483647) * 48271) % 2147483647, o_orderkey"


@register("kfold", f"select o_orderkey, (row_number() over ({_ORDER}) - 1) % 3 as fold from orders")
def kfold(spark, sf_dir):
    return split.kfold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3)


@register("stratified_kfold", f"select o_orderkey, (row_number() over (partition by o_orderstatus {_ORDER}) - 1) % 3 as fold from orders")
def stratified_kfold(spark, sf_dir):
    return split.kfold(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 3, "o_orderstatus").select("o_orderkey", "fold")


@register("train_test", f"select o_orderkey, row_number() over (partition by o_orderstatus {_ORDER}) <= ceil(count(*) over (partition by o_orderstatus) * 0.2::double) as is_test from orders")
def train_test(spark, sf_dir):
    return split.train_test(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 0.2, "o_orderstatus").select("o_orderkey", "is_test")


@register("ts_split", "with r as (select event_id, row_number() over (order by ts) as i, count(*) over () as n from events) select s as split, event_id, i > n - (3 - s) * 50 as is_test from r, generate_series(0, 2) g(s) where i <= n - (2 - s) * 50")
def ts_split(spark, sf_dir):
    out = split.time_series_split(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 3, 50)
    return out.select(F.col("split").cast("bigint").alias("split"), "event_id", "is_test")


@register("stl")
def stl(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("d"), "o_orderpriority").agg(F.sum("o_totalprice").alias("y"))
    return series.decompose(daily, "y", "d", 7, "o_orderpriority")


@register("polynomial_trend", f"with r as (select row_number() over (order by d) as i, y from {_DAILY} t) select round(regr_intercept(y, i), 3) as c0, round(regr_slope(y, i), 4) as c1 from r")
def polynomial_trend(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("y"))
    rows = daily.select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("d")).alias("i"), "y")
    c = series.polynomial_trend(rows, "y", "i", 1)
    return spark.createDataFrame([(round(c[0], 3), round(c[1], 4))], "c0 double, c1 double")
