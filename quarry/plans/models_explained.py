"""Explanations of fitted pipelines: dependence, permutation importance, Shapley values, local linear models, force data.

A fitted pipeline is a plan, so each of these is a table: copies of rows with one column set or shuffled go through the
pipeline once, however many values or columns there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import metrics
from quarry.plans.explain import grid, mostly_one_value, shuffled


def _value(predicted: DataFrame, label: int = 1) -> Column:
    """What is explained: the probability of a class, or the prediction."""
    return F.get("probability", F.lit(label)) if "probability" in predicted.columns else F.col("prediction").cast("double")


def _checked(df: DataFrame, feature: str) -> None:
    if df.agg(F.count(F.col(f"`{feature}`"))).first()[0] == 0:
        raise ValueError(f"all values of {feature} are null")
    if mostly_one_value(df, feature, 0.95):
        raise ValueError(f"{feature} has one value in nearly all rows")


def dates(df: DataFrame, feature: str, resolution: int) -> list:
    """Even steps from the first to the last timestamp."""
    low, high = df.agg(F.min(feature), F.max(feature)).first()
    return [low + (high - low) * i / max(resolution - 1, 1) for i in range(resolution)]


def values_of(df: DataFrame, feature: str, resolution: int = 20, percentiles: tuple[float, float] = (0.05, 0.95), max_categories: int = 1000) -> list:
    """The grid of a feature of any type: categories, steps of time, or numbers."""
    kind = df.schema[feature].dataType.typeName()
    if kind in ("string", "boolean"):
        return sorted(r[0] for r in df.select(feature).where(F.col(feature).isNotNull()).distinct().limit(max_categories).collect())
    return dates(df, feature, resolution) if kind.startswith(("timestamp", "date")) else grid(df, feature, resolution, percentiles)


def dependence(pipeline, df: DataFrame, features: str | list[str], resolution: int = 20, values: dict[str, list] | None = None, label: int = 1) -> DataFrame:
    """Mean prediction of a fitted pipeline at each grid value (or pair of values) of one or two features."""
    names = [features] if isinstance(features, str) else list(features)
    for n in names:
        _checked(df, n)
    out = df
    for i, n in enumerate(names):
        steps = (values or {}).get(n) or values_of(df, n, resolution)
        table = df.sparkSession.createDataFrame([(v,) for v in steps], f"_grid{i} {df.schema[n].dataType.simpleString() if not isinstance(steps[0], float) else 'double'}")
        out = out.crossJoin(F.broadcast(table))  # at most the resolution
    moved = out.withColumns({n: F.col(f"_grid{i}").cast(df.schema[n].dataType) for i, n in enumerate(names)})
    got = pipeline.predict_proba(moved)
    keys = [F.col(f"_grid{i}").alias("value" if len(names) == 1 else f"value_{i + 1}") for i in range(len(names))]
    return got.groupBy(*keys).agg(F.avg(_value(got, label)).alias("average"))


def importance(pipeline, df: DataFrame, key: str, objective: str, columns: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(feature, importance): how much worse the objective gets when a column is shuffled, largest first."""
    base = pipeline.score(df, [objective]).values[objective]
    sign = 1 if metrics.objective(objective).greater_is_better else -1
    rows = []
    for c in columns or [c for c in df.columns if c not in (pipeline.y, key)]:
        mixed = shuffled(df.withColumn("_mixed", F.abs(F.xxhash64(key))), "_mixed", c, seed).withColumn(c, F.col("_v")).drop("_v", "_mixed")
        rows.append((c, float(sign * (base - pipeline.score(mixed, [objective]).values[objective]))))
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[1]), "feature string, importance double")


def shapley(pipeline, df: DataFrame, key: str, background: DataFrame, features: list[str] | None = None, samples: int = 20, label: int = 1, seed: int = 0) -> DataFrame:
    """(key, feature, contribution): Shapley values of the raw columns by random orders against one background row.

    The background is the mean (or most frequent value) of each column of ``background``. For each of ``samples`` orders a
    row's copies take over the row's own values one feature after the other; differences of neighbouring copies'
    predictions are averaged over the orders. They sum to the row's prediction less the background's.
    """
    names = features or [c for c in df.columns if c not in (key, pipeline.y)]
    numeric = [f.name for f in background.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    base = background.agg(*[(F.avg(f"`{c}`") if c in numeric else F.mode(f"`{c}`")).cast(df.schema[c].dataType).alias(c) for c in names]).first()
    rng = np.random.default_rng(seed)
    orders = df.sparkSession.createDataFrame([(o, [int(x) for x in rng.permutation(len(names))]) for o in range(samples)], "_o int, _order array<int>")
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(names)))).alias("_k")
    rows = df.crossJoin(F.broadcast(orders)).select("*", steps)  # samples times (features + 1) copies
    own = lambda j: F.array_contains(F.slice("_order", F.lit(1), F.col("_k")), j)
    copies = rows.withColumns({c: F.when(own(j), F.col(f"`{c}`")).otherwise(F.lit(base[c]).cast(df.schema[c].dataType)) for j, c in enumerate(names)})
    got = pipeline.predict_proba(copies)
    path = got.select(key, "_o", "_order", "_k", _value(got, label).alias("_p")).groupBy(key, "_o", "_order").agg(F.array_sort(F.collect_list(F.struct("_k", "_p"))).alias("_path"))
    one = F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda k: F.struct(F.get("_order", k - 1).alias("j"), (F.get("_path", k)["_p"] - F.get("_path", k - 1)["_p"]).alias("d")))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("j") + 1)
    return path.select(key, F.inline(one)).groupBy(key, name.alias("feature")).agg(F.avg("d").alias("contribution"))


def local_linear(pipeline, df: DataFrame, key: str, background: DataFrame, features: list[str], samples: int = 200, label: int = 1, seed: int = 0) -> DataFrame:
    """(key, feature, contribution): weights of a ridge regression on predictions for random neighbours of each row.

    Neighbours are the row plus normal noise of each feature's deviation, weighted by their distance; a task holds the
    ``samples`` neighbours of some rows.
    """
    sd = background.agg(*[F.coalesce(F.stddev_samp(f"`{c}`"), F.lit(1.0)).alias(c) for c in features]).first()
    noise = np.random.default_rng(seed).standard_normal((samples, len(features)))
    table = df.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(noise)], "_s int, _z array<double>")
    moved = df.crossJoin(F.broadcast(table)).withColumns({c: (F.col(f"`{c}`") + F.get("_z", F.lit(j)) * F.lit(float(sd[c] or 1.0))).cast("double") for j, c in enumerate(features)})
    got = pipeline.predict_proba(moved)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        z, p = np.stack(rows["_z"]), rows["_p"].to_numpy(dtype=float)
        w = np.exp(-(z**2).sum(1) / (0.75**2 * z.shape[1]))
        x = np.column_stack([z, np.ones(len(z))])
        a = (x * w[:, None]).T @ x + 1e-6 * np.eye(x.shape[1])
        weights = np.linalg.solve(a, (x * w[:, None]).T @ p)[:-1]
        return pd.DataFrame({key: rows[key].iloc[0], "feature": features, "contribution": weights})

    kind = df.schema[key].dataType.simpleString()
    return got.select(key, "_z", _value(got, label).alias("_p")).groupBy(key).applyInPandas(fit, f"`{key}` {kind}, feature string, contribution double")


def explained(pipeline, df: DataFrame, key: str, background: DataFrame, top_k: int = 3, method: str = "shapley", **options) -> DataFrame:
    """(key, feature, contribution, value): the largest contributions of each row, with the value that the row has there."""
    features = options.pop("features", None) or [c for c in df.columns if c not in (key, pipeline.y)]
    work = {"shapley": shapley, "linear": local_linear}[method]
    got = work(pipeline, df, key, background, features=features, **options)
    rows = got.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("contribution")).alias("o"), "feature", "contribution"))), 1, top_k).alias("x"))  # one for each feature
    values = df.select(key, F.create_map(*[v for c in features for v in (F.lit(c), F.col(f"`{c}`").cast("string"))]).alias("_m"))
    return rows.join(values, key).select(key, F.inline("x"), "_m").select(key, "feature", "contribution", F.col("_m")[F.col("feature")].alias("value"))


def force(contributions: DataFrame, key: str, base: float) -> DataFrame:
    """(key, base, prediction, features): what a force plot draws, with features from the largest effect."""
    cells = F.array_sort(F.collect_list(F.struct((-F.abs("contribution")).alias("o"), "feature", "contribution")))
    return contributions.groupBy(key).agg(F.sum("contribution").alias("s"), cells.alias("features")).select(key, F.lit(base).alias("base"), (F.col("s") + base).alias("prediction"), F.transform("features", lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("effect"))).alias("features"))
