"""Model understanding over prediction tables: curves, dependence, importance, contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import metrics
from quarry.functions.ordered import numbered
from quarry.operators.sample import hash_order


def boundary_bins(df: DataFrame, y: str, score: str, n_bins: int) -> DataFrame:
    """Confusion counts with the upper edge of each bin of scores as threshold; the table of bins is all that is windowed."""
    b = F.least(F.floor(F.col(score) * n_bins).cast("int"), F.lit(n_bins - 1))
    t = df.groupBy(b.alias("bin")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("pos"), F.sum((F.col(y) != 1).cast("bigint")).alias("neg"))
    up, whole = W.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(F.lit(0))
    t = t.select("bin", F.sum("pos").over(up).alias("fn"), F.sum("neg").over(up).alias("tn"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    return t.select("bin", ((F.col("bin") + 1) / n_bins).alias("threshold"), "fn", "tn", (F.col("p") - F.col("fn")).alias("tp"), (F.col("n") - F.col("tn")).alias("fp"))


def best_bins(bins: DataFrame, objectives: tuple[str, ...] = ("F1", "AccuracyBinary", "BalancedAccuracyBinary", "Precision")) -> DataFrame:
    """For each objective the threshold with its best value."""
    parts = {k: F.col(k) for k in ("tp", "tn", "fp", "fn")}
    cells = bins.select("threshold", F.inline(F.array(*[F.struct(F.lit(o).alias("objective"), metrics.BINARY[o](parts).alias("value")) for o in objectives])))
    return cells.groupBy("objective").agg(F.max_by("threshold", F.struct("value", -F.col("threshold"))).alias("threshold"), F.max("value").alias("value"))


def bin_samples(df: DataFrame, y: str, score: str, key: str, n_bins: int, top_k: int = 5) -> DataFrame:
    """Up to ``top_k`` keys of each class in each bin of scores."""
    b = F.least(F.floor(F.col(score) * n_bins).cast("int"), F.lit(n_bins - 1))
    return _smallest(df.select(b.alias("bin"), F.col(y).alias("label"), F.col(key).alias("key")), top_k)


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("bin", "label").orderBy("key")))
    return ranked.where(F.col("r") <= k).groupBy("bin", "label").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def objective_vs_threshold(df: DataFrame, y: str, score: str, objective: str = "F1", steps: int = 100) -> DataFrame:
    """The objective at steps + 1 thresholds, from the counts of the intervals between them: one pass over the rows."""
    # a score counts as predicted at thresholds below it; equal ones are not above
    above = F.ceil(F.round(F.col(score) * steps, 12)) - 1
    t = df.groupBy(F.greatest(above, F.lit(-1)).cast("int").alias("k")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("pos"), F.sum((F.col(y) != 1).cast("bigint")).alias("neg"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("t"))
    got = grid.crossJoin(F.broadcast(t)).groupBy("t").agg(  # a row for each interval
        F.sum(F.when(F.col("k") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") >= F.col("t"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("k") < F.col("t"), F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(F.col("k") < F.col("t"), F.col("neg")).otherwise(0)).alias("tn"))
    parts = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    return got.select((F.col("t") / steps).alias("threshold"), metrics.BINARY[objective](parts).alias("score"))


def grid(df: DataFrame, feature: str, resolution: int = 100, percentiles: tuple[float, float] = (0.05, 0.95)) -> list[float]:
    """All values if there are fewer than the resolution, else even steps between two percentiles."""
    values = [r[0] for r in df.select(feature).where(F.col(feature).isNotNull()).distinct().limit(resolution).collect()]
    if len(values) < resolution:
        return sorted(float(v) for v in values)
    low, high = df.agg(F.percentile(feature, F.array(*[F.lit(p) for p in percentiles]))).first()[0]
    return [low + (high - low) * i / (resolution - 1) for i in range(resolution)]


def _grid_frame(df: DataFrame, values: list[float], name: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(float(v),) for v in values], f"`{name}` double"))  # at most the resolution


def ice(df: DataFrame, feature: str, predict, values: list[float]) -> DataFrame:
    """Every row's prediction with the feature set to each value. ``predict`` maps columns to a prediction."""
    columns = {c: F.col(f"`{c}`") for c in df.columns} | {feature: F.col("value")}
    return df.crossJoin(_grid_frame(df, values, "value")).withColumn("prediction", predict(columns))


def partial_dependence(df: DataFrame, feature: str, predict, resolution: int = 100, values: list[float] | None = None) -> DataFrame:
    """Mean prediction at each grid value: averages of an expression for every value, in one pass and without copies of rows."""
    values = values or grid(df, feature, resolution)
    mean = lambda v: F.avg(predict({c: F.col(f"`{c}`") for c in df.columns} | {feature: F.lit(v)}))
    one = df.agg(*[mean(v).alias(str(i)) for i, v in enumerate(values)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.col(str(i)).alias("average")) for i, v in enumerate(values)])))


def partial_dependence_two_way(df: DataFrame, first_feature: str, second_feature: str, predict, resolution: int = 20, first: list[float] | None = None, second: list[float] | None = None) -> DataFrame:
    pairs = [(a, b) for a in first or grid(df, first_feature, resolution) for b in second or grid(df, second_feature, resolution)]
    mean = lambda a, b: F.avg(predict({c: F.col(f"`{c}`") for c in df.columns} | {first_feature: F.lit(a), second_feature: F.lit(b)}))
    one = df.agg(*[mean(a, b).alias(str(i)) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("value_1"), F.lit(b).alias("value_2"), F.col(str(i)).alias("average")) for i, (a, b) in enumerate(pairs)])))


def mostly_one_value(df: DataFrame, feature: str, percentile: float) -> bool:
    """Whether one value's share, plus 0.01, reaches the percentile, so that a grid would be a point."""
    counts = df.groupBy(feature).count()
    got = counts.agg(F.max("count").alias("m"), F.sum("count").alias("n")).first()
    return got["n"] is not None and got["m"] / got["n"] + 0.01 >= percentile


def shuffled(df: DataFrame, key: str, column: str, seed: int = 0) -> DataFrame:
    """The table with one column's values dealt to other rows: ranks by key meet ranks by a hash of the key."""
    left = numbered(df, "_i", key)
    right = numbered(df.select(key, F.col(f"`{column}`").alias("_v")), "_j", hash_order(F.col(key), seed), key).select("_j", "_v")
    return left.join(right, F.col("_i") == F.col("_j")).drop("_i", "_j")


def permutation_importance(df: DataFrame, key: str, column: str, error, seed: int = 0) -> DataFrame:
    """How much the error grows when the column is shuffled; ``error`` maps columns to an aggregate. One pass gives both."""
    both = shuffled(df, key, column, seed)
    own = {c: F.col(f"`{c}`") for c in df.columns}
    got = both.agg(error(own).alias("base"), error(own | {column: F.col("_v")}).alias("shuffled"))
    return got.select(F.lit(column).alias("feature"), (F.col("shuffled") - F.col("base")).alias("importance"))


def linear_contributions(df: DataFrame, coefficients: dict[str, float], keys: list[str], top_k: int = 3, provenance: dict[str, str] | None = None) -> DataFrame:
    """Exact contributions coefficient * (x - mean) of a linear model, the largest of each row; derived features are summed
    into what they derive from. Rows are exploded and ranked without a shuffle beyond that of the mean."""
    names = list(coefficients)
    means = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m_{c}") for c in names])
    parents: dict[str, list[str]] = {}
    for c in names:
        parents.setdefault((provenance or {}).get(c, c), []).append(c)
    value = lambda cs: F.round(sum([coefficients[c] * (F.col(f"`{c}`") - F.col(f"`m_{c}`")) for c in cs], F.lit(0.0)), 9)
    cells = F.array(*[F.struct((-F.abs(value(cs))).alias("o"), F.lit(p).alias("feature"), value(cs).alias("contribution")) for p, cs in parents.items()])
    top = F.slice(F.array_sort(cells), 1, top_k)
    return df.crossJoin(F.broadcast(means)).select(*keys, F.inline(top)).drop("o")  # means are one row


def normalised_contributions(contributions: DataFrame, keys: list[str]) -> DataFrame:
    total = F.sum(F.abs("contribution")).over(W.partitionBy(*keys))
    return contributions.withColumn("share", F.when(total > 0, F.col("contribution") / total).otherwise(0.0))


def bars(share) -> Column:
    """One to five signs that show a contribution's share."""
    n = F.least(F.floor(F.abs(share) * 5).cast("int") + 1, F.lit(5))
    return F.when(share == 0, "").otherwise(F.repeat(F.when(share > 0, "+").otherwise("-"), n))


def abs_error(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def cross_entropy(p_of_label: Column) -> Column:
    return -F.ln(F.greatest(p_of_label, F.lit(metrics.EPS)))


def best_worst(df: DataFrame, error: str, key: str, k: int = 5) -> DataFrame:
    """The rows with the smallest and with the largest errors."""
    best = df.orderBy(F.asc(error), key).limit(k).withColumn("kind", F.lit("best"))
    return best.unionByName(df.orderBy(F.desc(error), key).limit(k).withColumn("kind", F.lit("worst")))


def rows_of_interest(df: DataFrame, y: str, score: str, threshold: float = 0.5, epsilon: float = 0.1, kinds: str = "all") -> DataFrame:
    """Rows whose score lies near the threshold, with their distance; kinds: all, correct, incorrect and the four outcomes."""
    p = (F.col(score) >= threshold).cast("int")
    right = F.col(y) == p
    chosen = {"all": F.lit(True), "correct": right, "incorrect": ~right, "true_positive": right & (p == 1), "true_negative": right & (p == 0), "false_positive": ~right & (p == 1), "false_negative": ~right & (p == 0)}[kinds]
    return df.withColumn("distance", F.abs(F.col(score) - threshold)).where((F.col("distance") <= epsilon) & chosen)


def influential_features(importance: DataFrame, max_features: int = 5, least: float = 0.05, linear: bool = False) -> DataFrame:
    """Heavy (a fifth of all importance or more) and somewhat influential features, and detrimental ones."""
    size = F.abs("importance") if linear else F.greatest(F.col("importance"), F.lit(0.0))
    total = F.sum(F.abs("importance")).over(W.partitionBy(F.lit(0)))
    share = size / total
    kind = F.when((F.col("importance") < 0) & F.lit(not linear), "detrimental").when(share >= 0.2, "heavy").when(share >= least, "somewhat")
    return importance.withColumn("influence", kind).where("influence is not null").orderBy(F.desc(F.abs("importance"))).limit(max_features)


def readable(features: DataFrame, target: str) -> str:
    """A sentence or two on the most influential features; the table has at most a few rows."""
    found: dict[str, list[str]] = {}
    for r in features.collect():
        found.setdefault(r.influence, []).append(r.feature)
    parts = [f"{target} is heavily influenced by {', '.join(found['heavy'])}" if "heavy" in found else "", f"somewhat influenced by {', '.join(found['somewhat'])}" if "somewhat" in found else ""]
    text = "; ".join(p for p in parts if p) or f"no feature stands out for {target}"
    return text + (f". Detrimental: {', '.join(found['detrimental'])}." if "detrimental" in found else ".")


def prediction_vs_actual(df: DataFrame, y: str, pred: str, outlier_threshold: float | None = None) -> DataFrame:
    out = df.select(F.col(pred).alias("prediction"), F.col(y).alias("actual"))
    far = F.abs(F.col("prediction") - F.col("actual")) >= F.lit(outlier_threshold) if outlier_threshold is not None else F.lit(False)
    return out.withColumn("outlier", far)


def chi_square(df: DataFrame, y: str, pred: str) -> tuple[float, float]:
    """Statistic and p-value of predicted class counts against the labels'; one row a class is collected."""
    from quarry.plans.profile import gamma_cdf

    cells = df.select(F.inline(F.array(F.struct(F.col(y).cast("string").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).cast("string").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))))
    rows = cells.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p")).collect()
    stat = sum((r.p - r.t) ** 2 / r.t if r.t else float("inf") for r in rows)
    return stat, 0.0 if stat == float("inf") else 1 - gamma_cdf(stat / 2, max(len(rows) - 1, 1) / 2)


def kolmogorov_smirnov(df: DataFrame, y: str, pred: str) -> tuple[float, float]:
    """Largest distance of the two distribution functions, and its p-value; windows hold distinct values."""
    import math

    values = df.select(F.inline(F.array(F.struct(F.col(y).cast("double").alias("v"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).cast("double").alias("v"), F.lit(0).alias("t"), F.lit(1).alias("p")))))
    each = values.groupBy("v").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    up, whole = W.partitionBy(F.lit(0)).orderBy("v").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(F.lit(0))
    gap = F.abs(F.sum("t").over(up) / F.sum("t").over(whole) - F.sum("p").over(up) / F.sum("p").over(whole))
    got = each.select(gap.alias("d"), F.sum("t").over(whole).alias("n")).agg(F.max("d").alias("d"), F.max("n").alias("n")).first()
    x = got["d"] * math.sqrt(got["n"] / 2)
    p = 1.0 if x < 0.2 else min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))
    return got["d"], p


def same_distribution(df: DataFrame, y: str, pred: str, problem: str, threshold: float = 0.1) -> int:
    """1 if predictions may have the labels' distribution."""
    test = kolmogorov_smirnov if "regression" in problem else chi_square
    return int(test(df, y, pred)[1] >= threshold)


def coefficients(spark, estimator) -> DataFrame:
    """(feature, coefficient) of a linear model, the intercept first, then by value."""
    m = estimator.model
    rows = sorted(zip(estimator.features, map(float, m.coefficients.toArray()), strict=False), key=lambda x: x[1])
    return spark.createDataFrame([("Intercept", float(m.intercept)), *rows], "feature string, coefficient double")


def tree(estimator) -> dict:
    """A decision tree as nested dictionaries of feature, threshold, left and right, or value at leaves."""
    import re

    lines = [x for x in estimator.model.toDebugString.splitlines() if x.strip()][1:]

    def read(at: int) -> tuple[dict, int]:
        text = lines[at].strip()
        if text.startswith("Predict:"):
            return {"value": float(text.split(":")[1])}, at + 1
        m = re.match(r"If \(feature (\d+) (?:<=|in) (.*)\)", text)
        left, at = read(at + 1)
        right, at = read(at + 1)
        limit = m[2]
        return {"feature": estimator.features[int(m[1])], "threshold": float(limit) if not limit.startswith("{") else limit, "left": left, "right": right}, at

    return read(0)[0]


def t_sne(df: DataFrame, features: list[str], n_components: int = 2, perplexity: float = 30.0, max_rows: int = 1000, steps: int = 300) -> DataFrame:
    """An embedding of a sample of bounded size (the rows with the least hashes), by gradient descent on the driver."""
    import numpy as np

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features]).dropna().orderBy(F.xxhash64(*features), *features).limit(max_rows).collect()
    x = np.array([list(r) for r in rows], dtype=float)
    n = len(x)
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    p = np.zeros((n, n))
    for i in range(n):  # the width of each row's kernel by bisection on the entropy
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(40):
            w = np.exp(-(d2[i] - np.delete(d2[i], i).min()) * beta)
            w[i] = 0
            q = w / w.sum()
            h = -(q[q > 0] * np.log(q[q > 0])).sum()
            if abs(h - np.log(perplexity)) < 1e-4:
                break
            low, high = (beta, high) if h > np.log(perplexity) else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(0).standard_normal((n, n_components)) * 1e-4
    move = np.zeros_like(y)
    for step in range(steps):
        k = 1 / (1 + ((y[:, None, :] - y[None, :, :]) ** 2).sum(2))
        np.fill_diagonal(k, 0)
        g = ((4 if step < 100 else 1) * p - k / k.sum()) * k
        move = (0.5 if step < 100 else 0.8) * move - 200 * 4 * (np.diag(g.sum(1)) - g) @ y
        y = y + move
    return df.sparkSession.createDataFrame([tuple(map(float, r)) for r in y], ", ".join(f"component_{i} double" for i in range(n_components)))
