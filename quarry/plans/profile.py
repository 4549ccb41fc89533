"""Data checks: aggregations that return messages with repair actions."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import columns as cols
from quarry.operators import series as ts
from quarry.operators.base import features_of
from quarry.operators.sample import class_counts
from quarry.operators.split import time_series_split

ACTIONS = ("drop_col", "drop_rows", "impute_col", "transform_target", "regularize_and_impute_dataset", "set_first_col_id")


@dataclass
class Action:
    code: str
    check: str
    metadata: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)


@dataclass
class Message:
    """A finding: its level (warning or error), code, details, and actions that would repair it."""

    check: str
    level: str
    code: str
    message: str
    details: dict = field(default_factory=dict)
    actions: list[Action] = field(default_factory=list)


def as_table(spark, messages: list[Message]) -> DataFrame:
    rows = [(m.check, m.level, m.code, m.message, {k: str(v) for k, v in m.details.items()}, [(a.code, {k: str(v) for k, v in a.metadata.items()}) for a in m.actions]) for m in messages]
    return spark.createDataFrame(rows, "check string, level string, code string, message string, details map<string,string>, actions array<struct<code:string,metadata:map<string,string>>>")


def null_check(df: DataFrame, y: str | None = None, key: str | None = None, pct_null_col: float = 0.95, pct_moderate: float = 0.2, pct_null_row: float = 0.95) -> list[Message]:
    features = [c for c in features_of(df, y) if c != key]
    shares = cols.null_shares(df, features)
    high = [c for c, s in shares.items() if s > 0 and s >= pct_null_col]
    some = [c for c, s in shares.items() if pct_moderate <= s < pct_null_col and s > 0]
    rows = null_rows(df, features, pct_null_row).count() if features else 0
    out = []
    if rows:
        out.append(Message("NullDataCheck", "warning", "HIGHLY_NULL_ROWS", f"{rows} rows are at least {pct_null_row:.0%} null", {"rows": rows}, [Action("drop_rows", "NullDataCheck", {"pct_null_row_threshold": pct_null_row})]))
    if high:
        out.append(Message("NullDataCheck", "warning", "HIGHLY_NULL_COLS", f"columns {high} are at least {pct_null_col:.0%} null", {"columns": high, "pct_null": shares}, [Action("drop_col", "NullDataCheck", {"columns": high})]))
    if some:
        out.append(Message("NullDataCheck", "warning", "COLS_WITH_NULL", f"columns {some} hold nulls", {"columns": some}, [Action("impute_col", "NullDataCheck", {"columns": some, "is_target": False})]))
    return out


def null_rows(df: DataFrame, features: list[str], threshold: float) -> DataFrame:
    """Rows whose share of nulls reaches the threshold, with that share."""
    nulls = sum([F.col(f"`{c}`").isNull().cast("int") for c in features], F.lit(0))
    return df.withColumn("pct_null", nulls / len(features)).where(F.col("pct_null") >= threshold)


def distinct_counts(df: DataFrame, names: list[str]) -> dict[str, tuple[int, int, int]]:
    """(distinct values, non-null rows, rows) of each column."""
    got = df.agg(F.count(F.lit(1)).alias("n"), *[f for i, c in enumerate(names) for f in (F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}"), F.count(F.col(f"`{c}`")).alias(f"c{i}"))]).first()
    return {c: (got[f"d{i}"], got[f"c{i}"], got["n"]) for i, c in enumerate(names)}


def id_check(df: DataFrame, y: str | None = None, threshold: float = 1.0) -> list[Message]:
    features = features_of(df, y)
    types = schema.logical_types(df)
    candidates = [c for c in features if types[c] in ("integer", "category", "unknown", "text", "double")]
    stats = distinct_counts(df, candidates)
    whole = {c for c in candidates if types[c] == "double"}
    if whole:
        got = df.agg(*[F.every(F.coalesce(F.col(f"`{c}`") == F.floor(F.col(f"`{c}`")), F.lit(True))).alias(c) for c in whole]).first()
        whole = {c for c in whole if not got[c]}
    score: dict[str, float] = {}
    for c in features:
        named = c.lower() == "id" or c.lower().endswith("_id")
        unique = c in stats and c not in whole and stats[c][0] == stats[c][2] and stats[c][2] > 0
        if named or unique:
            score[c] = 1.0 if named and unique else 0.95
    found = {c: s for c, s in score.items() if s >= threshold}
    out = []
    if features and features[0] in found and stats.get(features[0], (0, 0, 1))[0] == stats.get(features[0], (0, 0, 1))[2]:
        first = features[0]
        out.append(Message("IDColumnsDataCheck", "warning", "HAS_ID_FIRST_COLUMN", f"the first column {first} is likely the primary key", {"columns": [first]}, [Action("set_first_col_id", "IDColumnsDataCheck", {"columns": [first]})]))
        found.pop(first)
    if found:
        out.append(Message("IDColumnsDataCheck", "warning", "HAS_ID_COLUMN", f"columns {list(found)} are likely ids", {"columns": list(found)}, [Action("drop_col", "IDColumnsDataCheck", {"columns": list(found)})]))
    return out


def no_variance_check(df: DataFrame, y: str | None = None, count_nan_as_value: bool = False) -> list[Message]:
    groups: dict[str, list[str]] = {}
    for c, (d, n, total) in distinct_counts(df, df.columns).items():
        nulls = n < total
        code = "NO_VARIANCE_ZERO_UNIQUE" if d == 0 else "NO_VARIANCE" if d == 1 and not (nulls and count_nan_as_value) else "NO_VARIANCE_WITH_NULL" if d == 1 else None
        if code:
            groups.setdefault(code, []).append(c)
    out = []
    for code, names in groups.items():
        features = [c for c in names if c != y]
        if features:
            out.append(Message("NoVarianceDataCheck", "warning", code, f"columns {features} do not vary", {"columns": features}, [Action("drop_col", "NoVarianceDataCheck", {"columns": features})]))
        if y in names:
            out.append(Message("NoVarianceDataCheck", "warning", code, f"the target {y} does not vary", {"columns": [y]}))
    return out


def class_imbalance_check(df: DataFrame, y: str, threshold: float = 0.1, min_samples: int = 100, num_cv_folds: int = 3, test_size: float = 1.0) -> list[Message]:
    counts = {k: math.floor(n * test_size) for k, n in class_counts(df, y).items()}
    out, most = [], max(counts.values(), default=0)
    few = [k for k, n in counts.items() if num_cv_folds and n < 2 * num_cv_folds]
    if few:
        out.append(Message("ClassImbalanceDataCheck", "error", "CLASS_IMBALANCE_BELOW_FOLDS", f"classes {few} have fewer rows than twice the folds", {"target_values": few}))
    low = [k for k, n in counts.items() if most and n / (n + most) < threshold]
    if low:
        out.append(Message("ClassImbalanceDataCheck", "warning", "CLASS_IMBALANCE_BELOW_THRESHOLD", f"classes {low} are below {threshold:.0%} of the target", {"target_values": low}))
        severe = [k for k in low if counts[k] < min_samples]
        if severe:
            out.append(Message("ClassImbalanceDataCheck", "warning", "CLASS_IMBALANCE_SEVERE", f"classes {severe} have fewer than {min_samples} rows besides", {"target_values": severe}))
    return out


def mutual_information(df: DataFrame, a: str, b: str) -> float:
    """Normalised mutual information of two columns of few values: over the mean of their entropies."""
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n").over(W.partitionBy(F.lit(0)))
    p = joint.select((F.col("n") / n).alias("p"), (F.sum("n").over(W.partitionBy("a")) / n).alias("pa"), (F.sum("n").over(W.partitionBy("b")) / n).alias("pb"))
    got = p.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"), F.sum(-F.col("p") * F.ln("pa")).alias("ha"), F.sum(-F.col("p") * F.ln("pb")).alias("hb")).first()
    mean = ((got["ha"] or 0) + (got["hb"] or 0)) / 2
    return max(got["mi"] or 0.0, 0.0) / mean if mean else 0.0


def binned(df: DataFrame, names: list[str], bins: int = 10) -> DataFrame:
    """Numbers of many values as numbers of equal-frequency bins, from quantiles of all columns at once."""
    numeric = [c for c in names if schema.logical_types(df)[c] in schema.NUMERIC]
    if not numeric:
        return df
    edges = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), [i / bins for i in range(1, bins)], 10000).alias(str(i)) for i, c in enumerate(numeric)]).first()
    new = {}
    for i, c in enumerate(numeric):
        col = F.col(f"`{c}`").cast("double")
        new[c] = F.when(col.isNotNull(), sum([(col > F.lit(float(e))).cast("int") for e in sorted(set(edges[str(i)] or []))], F.lit(0)))
    return df.withColumns(new)


def correlation(a, b):
    """Pearson correlation of the rows where both have values; null where one does not vary."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, a: str, b: str) -> float:
    """Correlation of average ranks; ranks come from the table of distinct values."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    rank = lambda c: F.rank().over(W.partitionBy(F.lit(0)).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / 2
    return rows.select(rank("a").alias("ra"), rank("b").alias("rb")).agg(correlation(F.col("ra"), F.col("rb"))).first()[0] or 0.0


def leakage_check(df: DataFrame, y: str, threshold: float = 0.95, method: str = "all") -> list[Message]:
    types, found = schema.logical_types(df), []
    features = [c for c in features_of(df, y) if types[c] not in ("text", "datetime")]
    numeric = [c for c in features if types[c] in schema.NUMERIC] if types[y] in schema.NUMERIC else []
    got = df.agg(*[correlation(F.col(f"`{c}`").cast("double"), F.col(f"`{y}`").cast("double")).alias(str(i)) for i, c in enumerate(numeric)]).first() if numeric else None
    for c in features:
        values = [abs(got[str(numeric.index(c))] or 0.0)] if c in numeric and method in ("all", "max", "pearson") else []
        if c in numeric and method in ("all", "max", "spearman"):
            values.append(abs(spearman(df, c, y)))
        if method in ("all", "max", "mutual_info"):
            values.append(mutual_information(binned(df, [c, y]), c, y))
        if values and max(values) >= threshold:
            found.append(c)
    return [Message("TargetLeakageDataCheck", "warning", "TARGET_LEAKAGE", f"columns {found} depend on the target", {"columns": found}, [Action("drop_col", "TargetLeakageDataCheck", {"columns": found})])] if found else []


def multicollinearity_check(df: DataFrame, y: str | None = None, threshold: float = 0.9) -> list[Message]:
    types = schema.logical_types(df)
    features = [c for c in features_of(df, y) if types[c] not in ("text", "datetime", "unknown")]
    table = binned(df, features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :] if mutual_information(table, a, b) >= threshold]
    return [Message("MulticollinearityDataCheck", "warning", "IS_MULTICOLLINEAR", f"columns are collinear: {pairs}", {"columns": pairs})] if pairs else []


def gamma_cdf(x: float, shape: float) -> float:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 0.0
    log = shape * math.log(x) - x - math.lgamma(shape)
    if x < shape + 1:
        term = total = 1 / shape
        k = shape
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(log)
    b, c, d = x + 1 - shape, 1e300, 1 / (x + 1 - shape)
    h = d
    for i in range(1, 500):
        a = -i * (i - shape)
        b += 2
        d, c = 1 / (a * d + b), b + a / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - h * math.exp(log)


def boxplots(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Quartiles and fences of numbers, exact, in one aggregation."""
    if not names:
        return {}
    got = df.agg(*[F.percentile(F.col(f"`{c}`").cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(str(i)) for i, c in enumerate(names)]).first()
    out = {}
    for i, c in enumerate(names):
        if got[str(i)]:
            q1, q2, q3 = got[str(i)]
            out[c] = {"q1": q1, "median": q2, "q3": q3, "low_bound": q1 - 1.5 * (q3 - q1), "high_bound": q3 + 1.5 * (q3 - q1)}
    return out


# Coefficients of the powers 0 to 7 of ln(n) that give the logarithms of the shape and of the scale of the
# gamma distribution of the share of points beyond the fences in samples of n rows without outliers.
LOG_SHAPE = (25.8218734380722, -29.2320460088643, 14.8228030299864, -4.08052512660036, 0.641429075842177, -0.0571252717322226, 0.00268694343911156, -5.19415149920567e-05)
LOG_SCALE = (-19.8196822259052, 18.5359212447622, -8.80487628113388, 2.27711870991327, -0.344443407676357, 0.029820831994345, -0.00136611527293756, 2.56727158170901e-05)


def no_outlier_probability(n: int, share: float) -> float:
    """How likely a share of points beyond the fences is among n rows that hold no outliers."""
    if n < 2:
        return 1.0
    shape, scale = (math.exp(sum(c * math.log(n) ** k for k, c in enumerate(cs))) for cs in (LOG_SHAPE, LOG_SCALE))
    return 1 - gamma_cdf(share / scale, shape)


def outlier_check(df: DataFrame, y: str | None = None, least: float = 0.9) -> list[Message]:
    """Columns with points beyond the fences that rows without outliers would hardly have."""
    names = [c for c in features_of(df, y) if schema.logical_types(df)[c] in schema.NUMERIC]
    boxes = boxplots(df, names)
    if not boxes:
        return []
    beyond = lambda c, b: F.count(F.when((F.col(f"`{c}`") < b["low_bound"]) | (F.col(f"`{c}`") > b["high_bound"]), 1))
    got = df.agg(*[f for i, (c, b) in enumerate(boxes.items()) for f in (beyond(c, b).alias(f"o{i}"), F.count(F.col(f"`{c}`")).alias(f"n{i}"))]).first()
    found = {c: got[f"o{i}"] for i, c in enumerate(boxes) if got[f"o{i}"] and no_outlier_probability(got[f"n{i}"], got[f"o{i}"] / got[f"n{i}"]) <= least}
    return [Message("OutliersDataCheck", "warning", "HAS_OUTLIERS", f"columns {list(found)} have outliers", {"columns": list(found), "rows": found}, [Action("drop_rows", "OutliersDataCheck", {"columns": list(found)})])] if found else []


def uniqueness(df: DataFrame, names: list[str]) -> dict[str, float]:
    """1 - sum of squared shares of each column's values, in one shuffle."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in names])).alias("x")).select("x.*").where("v is not null")
    n = cells.groupBy("c", "v").count()
    got = n.groupBy("c").agg((1 - F.sum(F.pow("count", F.lit(2.0))) / F.pow(F.sum("count"), F.lit(2.0))).alias("u")).collect()
    return {r.c: r.u for r in got}


def uniqueness_check(df: DataFrame, y: str | None, problem: str, threshold: float = 0.5) -> list[Message]:
    scores = uniqueness(df, features_of(df, y))
    multi = "multiclass" in problem
    found = [c for c, u in scores.items() if (u > threshold if multi else u < threshold)]
    code = "TOO_UNIQUE" if multi else "NOT_UNIQUE_ENOUGH"
    return [Message("UniquenessDataCheck", "warning", code, f"columns {found}: {code.lower()}", {"columns": found, "score": scores}, [Action("drop_col", "UniquenessDataCheck", {"columns": found})])] if found else []


def sparsity(df: DataFrame, names: list[str], count_threshold: int = 10) -> dict[str, float]:
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in names])).alias("x")).select("x.*").where("v is not null")
    got = cells.groupBy("c", "v").count().groupBy("c").agg(F.avg((F.col("count") > count_threshold).cast("double")).alias("s")).collect()
    return {r.c: r.s for r in got}


def sparsity_check(df: DataFrame, y: str | None, problem: str, threshold: float = 0.5, count_threshold: int = 10) -> list[Message]:
    if "multiclass" not in problem:
        return []
    found = [c for c, s in sparsity(df, features_of(df, y), count_threshold).items() if s < threshold]
    return [Message("SparsityDataCheck", "warning", "TOO_SPARSE", f"columns {found} are too sparse", {"columns": found}, [Action("drop_col", "SparsityDataCheck", {"columns": found})])] if found else []


def invalid_target_check(df: DataFrame, y: str, problem: str, objective_positive_only: bool = False, n_unique: int = 100, null_strategy: str = "drop") -> list[Message]:
    name, col, kind = "InvalidTargetDataCheck", F.col(f"`{y}`"), schema.logical_types(df)[y]
    numeric = kind in schema.NUMERIC
    aggs = [F.count(F.lit(1)).alias("n"), F.count(col).alias("c"), F.count_distinct(col).alias("d")]
    got = df.agg(*aggs, *([F.min(col).alias("low")] if numeric else [])).first()
    if not got["c"]:
        return [Message(name, "error", "TARGET_IS_EMPTY_OR_FULLY_NULL", "the target is empty or fully null")]
    out = []
    if kind in ("text", "datetime", "unknown"):
        out.append(Message(name, "error", "TARGET_UNSUPPORTED_TYPE", f"the target is of type {kind}"))
    if got["c"] < got["n"]:
        action = Action("drop_rows", name) if null_strategy == "drop" else Action("impute_col", name, {"is_target": True, "strategy": "mean" if "regression" in problem else "most_frequent"})
        out.append(Message(name, "error", "TARGET_HAS_NULL", f"{got['n'] - got['c']} target values are null", {"num_null_rows": got["n"] - got["c"]}, [action]))
    if "regression" in problem and not numeric:
        out.append(Message(name, "error", "TARGET_UNSUPPORTED_TYPE_REGRESSION", "a regression target must be numeric"))
    if objective_positive_only and numeric and got["low"] <= 0:
        out.append(Message(name, "error", "TARGET_INCOMPATIBLE_OBJECTIVE", "the objective needs positive target values"))
    if "binary" in problem and got["d"] != 2:
        out.append(Message(name, "error", "TARGET_BINARY_NOT_TWO_UNIQUE_VALUES", f"a binary target has {got['d']} values", {"target_values": got["d"]}))
    if "multiclass" in problem:
        single = df.where(col.isNotNull()).groupBy(col).count().where("count < 2").count()
        if single:
            out.append(Message(name, "error", "TARGET_MULTICLASS_NOT_TWO_EXAMPLES_PER_CLASS", f"{single} classes have one row"))
        if got["d"] <= 2:
            out.append(Message(name, "error", "TARGET_MULTICLASS_NOT_ENOUGH_CLASSES", "a multiclass target needs three classes"))
        if got["d"] > n_unique:
            out.append(Message(name, "warning", "TARGET_MULTICLASS_HIGH_UNIQUE_CLASS", f"{got['d']} classes"))
    return out


def jarque_bera(df: DataFrame, c: str) -> float:
    """p-value of normality from skewness and kurtosis."""
    got = df.agg(F.count(c).alias("n"), F.skewness(c).alias("s"), F.kurtosis(c).alias("k")).first()
    return math.exp(-got["n"] / 6 * ((got["s"] or 0) ** 2 + (got["k"] or 0) ** 2 / 4) / 2)


def target_distribution_check(df: DataFrame, y: str) -> list[Message]:
    """Whether the logarithm of a positive, trimmed target is closer to normal than the target."""
    c = F.col(f"`{y}`").cast("double")
    got = df.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.min(c).alias("low")).first()
    if got["m"] is None or got["low"] < 0:
        return []
    rows = df.select(c.alias("v")).where(F.abs(F.col("v") - got["m"]) <= 3 * (got["s"] or 0)).where("v > 0")
    if jarque_bera(rows.withColumn("l", F.ln("v")), "l") > jarque_bera(rows, "v"):
        return [Message("TargetDistributionDataCheck", "warning", "TARGET_LOGNORMAL_DISTRIBUTION", "the target may be log-normal", {}, [Action("transform_target", "TargetDistributionDataCheck", {"transformation_strategy": "lognormal"})])]
    return []


def datetime_check(df: DataFrame, time_index: str, series_id: str | None = None, threshold: float = 0.75) -> list[Message]:
    name = "DateTimeFormatDataCheck"
    if time_index not in df.columns or schema.logical_types(df)[time_index] != "datetime":
        return [Message(name, "error", "DATETIME_INFORMATION_NOT_FOUND", "there is no datetime column of that name")]
    out = []
    if df.where(F.col(time_index).isNull()).limit(1).count():
        out.append(Message(name, "error", "DATETIME_HAS_NAN", "timestamps are null"))
    step, share = ts.modal_step(df, time_index, series_id)
    if not step or share < 1 - threshold:
        return [*out, Message(name, "error", "DATETIME_NO_FREQUENCY_INFERRED", "no frequency can be inferred")]
    codes = {"duplicate": "DATETIME_HAS_REDUNDANT_ROW", "missing": "DATETIME_IS_MISSING_VALUES", "misaligned": "DATETIME_HAS_MISALIGNED_VALUES"}
    counts = {r.issue: r["count"] for r in ts.classified_timestamps(df, time_index, step, series_id).groupBy("issue").count().collect()}
    for issue, code in codes.items():
        if counts.get(issue):
            out.append(Message(name, "error", code, f"{counts[issue]} timestamps are {issue}", {"count": counts[issue]}))
    if counts:
        out.append(Message(name, "error", "DATETIME_HAS_UNEVEN_INTERVALS", "intervals are uneven", {"frequency": step}, [Action("regularize_and_impute_dataset", name, {"time_index": time_index})]))
    return out


def ts_parameters_check(n_obs: int, gap: int, max_delay: int, forecast_horizon: int, n_splits: int) -> list[Message]:
    if ts.valid_for_split(gap, max_delay, forecast_horizon, n_obs, n_splits):
        return []
    return [Message("TimeSeriesParametersDataCheck", "error", "TIMESERIES_PARAMETERS_NOT_COMPATIBLE_WITH_SPLIT", "the splits are too short for gap, delay and horizon")]


def ts_splitting_check(df: DataFrame, y: str, time_index: str, n_splits: int = 3, horizon: int = 1) -> list[Message]:
    n = df.agg(F.count_distinct(y)).first()[0]
    splits = time_series_split(df, time_index, n_splits, horizon).where("not is_test").groupBy("split").agg(F.count_distinct(y).alias("d")).where(F.col("d") < n)
    bad = [r.split for r in splits.collect()]
    return [Message("TimeSeriesSplittingDataCheck", "error", "TIMESERIES_TARGET_NOT_COMPATIBLE_WITH_SPLIT", f"splits {bad} miss classes", {"splits": bad})] if bad else []


def series_length_check(df: DataFrame, series_id: str, max_named: int = 1000) -> list[Message]:
    """Series of another length than most: their number, and the names of the first ``max_named``."""
    name = "MismatchedSeriesLengthDataCheck"
    if series_id not in df.columns:
        return [Message(name, "error", "INVALID_SERIES_ID_COL", "there is no column of the series id")]
    sizes = df.groupBy(series_id).count()
    major = sizes.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("count")).first()
    odd = sizes.where(F.col("count") != major["count"]) if major else sizes
    n = odd.count() if major else 0
    shown = [r[0] for r in odd.orderBy(series_id).select(series_id).limit(max_named).collect()] if n else []
    return [Message(name, "warning", "MISMATCHED_SERIES_LENGTH", f"{n} series differ from the majority length {major['count']}", {"series": shown, "n_series": n, "majority_length": major["count"]})] if n else []


def default_checks(df: DataFrame, y: str, problem: str, config: dict | None = None) -> list[Message]:
    """The checks that suit a problem, in order."""
    config = config or {}
    out = invalid_target_check(df, y, problem) + null_check(df, y) + id_check(df, y) + leakage_check(df, y) + no_variance_check(df, y)
    if "regression" in problem:
        out += target_distribution_check(df, y)
    else:
        out += class_imbalance_check(df, y)
    if "time_series" in problem:
        out += datetime_check(df, config["time_index"], config.get("series_id"))
        out += ts_parameters_check(df.count(), config.get("gap", 0), config.get("max_delay", 0), config.get("forecast_horizon", 1), config.get("n_splits", 3))
        if config.get("series_id"):
            out += series_length_check(df, config["series_id"])
    elif problem in ("multiclass", "regression"):
        out += uniqueness_check(df, y, problem) + sparsity_check(df, y, problem)
    return out


def actions_of(messages: list[Message]) -> list[Action]:
    return [a for m in messages for a in m.actions]


def message_dicts(messages: list[Message]) -> list[dict]:
    return [asdict(m) for m in messages]
