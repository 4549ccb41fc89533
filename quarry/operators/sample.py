"""Class-balance samplers, exact and reproducible: rows are ranked within their class by a hash of their key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.base import Component, features_of


def class_counts(df: DataFrame, y: str) -> dict:
    return {r[0]: r[1] for r in df.where(F.col(f"`{y}`").isNotNull()).groupBy(y).count().collect()}


def undersample_quotas(counts: dict, sampling_ratio: float = 0.25, min_samples: int = 100, min_percentage: float = 0.1, ratios: dict | None = None) -> dict:
    """Rows to keep of each class that has too many; empty when balanced, or when a class is small in number and one in share."""
    if not counts:
        return {}
    least, total = min(counts.values()), sum(counts.values())
    if ratios:
        return {k: int(max(least / v, 0)) for k, v in ratios.items() if k in counts and counts[k] > least / v}
    if all(least / n >= sampling_ratio for n in counts.values()):
        return {}
    if any(n < min_samples for n in counts.values()) and any(n / total < min_percentage for n in counts.values()):
        return {}
    goal = max(int(least / sampling_ratio), min_samples)
    return {k: goal for k, n in counts.items() if n > goal and least / n <= sampling_ratio}


def hash_order(key: Column, seed: int = 0) -> Column:
    """A pseudorandom number below 2**31 - 1 of an integer key, by plain arithmetic that any SQL engine has."""
    return F.pmod(F.pmod(key.cast("bigint"), F.lit(2147483647)) * 48271 + F.lit(seed % 2147483647), F.lit(2147483647))


def keep_quota(df: DataFrame, y: str, key: str, quotas: dict, seed: int = 0) -> DataFrame:
    """At most the quota of rows of each class. Only classes with a quota are ranked; others pass without a sort."""
    if not quotas:
        return df
    limit = None
    for k, n in quotas.items():
        limit = F.when(F.col(f"`{y}`") == F.lit(k), n) if limit is None else limit.when(F.col(f"`{y}`") == F.lit(k), n)
    ranked = df.where(limit.isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(y).orderBy(hash_order(F.col(key), seed), key)))
    return df.where(limit.isNull()).unionByName(ranked.where(F.col("_r") <= limit).drop("_r"))


class Undersampler(Component):
    training_only = True

    def fit_state(self, df, y=None, key=None, sampling_ratio=0.25, sampling_ratio_dict=None, min_samples=100, min_percentage=0.1, random_seed=0):
        quotas = undersample_quotas(class_counts(df, y), sampling_ratio, min_samples, min_percentage, sampling_ratio_dict)
        return {"quotas": list(quotas.items())}

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.learnt()
        return keep_quota(df, s["y"], self.parameters["key"], dict(s["quotas"]), self.parameters["random_seed"])


def oversample_targets(counts: dict, sampling_ratio: float = 0.25) -> dict:
    """Rows that each class is to have at least."""
    most = max(counts.values(), default=0)
    return {k: max(n, int(most * sampling_ratio)) if n / most < sampling_ratio else n for k, n in counts.items()}


class Oversampler(Component):
    """Synthetic minority rows between near neighbours; categories are taken from either of the two.

    Neighbours are searched within blocks of ``block`` rows of a class, dealt by hash, so that no task holds a class.
    """

    training_only = True

    def fit_state(self, df, y=None, sampling_ratio=0.25, k_neighbors_default=5, block=2000, random_seed=0):
        counts = class_counts(df, y)
        return {"counts": list(counts.items()), "targets": list(oversample_targets(counts, sampling_ratio).items())}

    def transform(self, df: DataFrame) -> DataFrame:
        s, p = self.learnt(), self.parameters
        y, counts, goal = s["y"], dict(s["counts"]), dict(s["targets"])
        short = {k: goal[k] / counts[k] - 1 for k in counts if goal[k] > counts[k]}
        if not short:
            return df
        features = features_of(df, y)
        numeric = [c for c in features if df.schema[c].dataType.typeName() in ("double", "float", "decimal")]
        few = df.where(F.col(f"`{y}`").isin(list(short)))
        blocks = None
        for k, n in counts.items():
            b = F.pmod(F.xxhash64(*[f"`{c}`" for c in features]), F.lit(max(1, n // p["block"])))
            blocks = F.when(F.col(f"`{y}`") == F.lit(k), b) if blocks is None else blocks.when(F.col(f"`{y}`") == F.lit(k), b)

        names, seed, wanted = df.columns, p["random_seed"], p["k_neighbors_default"]

        def synthetic(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(features).reset_index(drop=True)
            rng = np.random.default_rng(seed + int(rows["_b"].iloc[0]))
            n = int(np.ceil(short[rows[y].iloc[0]] * len(rows)))
            x = rows[numeric].fillna(0.0).to_numpy(float)
            at = rng.integers(0, len(rows), n)
            d = ((x[at][:, None, :] - x[None, :, :]) ** 2).sum(2) if len(numeric) else np.zeros((n, len(rows)))
            d[np.arange(n), at] = np.inf
            k = min(wanted, max(len(rows) - 1, 1))
            near = np.argsort(d, axis=1, kind="stable")[np.arange(n), rng.integers(0, k, n)] if len(rows) > 1 else at
            out = rows.iloc[at].reset_index(drop=True)
            if numeric:
                out[numeric] = x[at] + rng.random((n, 1)) * (x[near] - x[at])
            return out[names]

        made = few.withColumn("_b", blocks.cast("bigint")).groupBy(y, "_b").applyInPandas(synthetic, df.schema)
        return df.unionByName(made)


def best_sampler(n_rows: int, counts: dict, method: str = "auto", ratio: float = 0.25) -> str | None:
    """No sampler for balanced classes, an undersampler from 20 000 rows on, an oversampler below."""
    if not counts or all(min(counts.values()) / n >= ratio for n in counts.values()):
        return None
    if method != "auto":
        return method
    return "Undersampler" if n_rows >= 20_000 else "Oversampler"
