"""Imputers: statistics of all columns come from one aggregation, values from one projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators.base import Component, features_of


def most_frequent(df: DataFrame, columns: list[str]) -> dict:
    """The most frequent value of each column, the smallest of equally frequent ones; one shuffle for all columns."""
    if not columns:
        return {}
    out = {}
    for c in columns:  # a plan for each type of column, lazily united
        counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        first = counts.orderBy(F.desc("n"), F.asc("v")).first()
        out[c] = first["v"] if first else None
    return out


def statistics(df: DataFrame, strategies: dict[str, str], fill: dict | None = None) -> dict:
    """The value that replaces nulls in each column; None where a column holds nothing."""
    aggs = {"mean": F.avg, "median": F.median, "count": F.count}
    numeric = {c: s for c, s in strategies.items() if s in ("mean", "median")}
    out = {c: (fill or {}).get(c) for c, s in strategies.items() if s == "constant"}
    if numeric:
        got = df.agg(*[aggs[s](F.col(f"`{c}`").cast("double")).alias(str(i)) for i, (c, s) in enumerate(numeric.items())]).first()
        out |= {c: got[str(i)] for i, c in enumerate(numeric)}
    return out | most_frequent(df, [c for c, s in strategies.items() if s == "most_frequent"])


def filled(df: DataFrame, values: dict) -> DataFrame:
    """Nulls replaced; whole numbers become doubles where the value has a fraction."""
    new = {}
    for c, v in values.items():
        if c not in df.columns or v is None:
            continue
        kind = df.schema[c].dataType.simpleString()
        if isinstance(v, float) and kind in ("tinyint", "smallint", "int", "bigint"):
            kind = "double"
        new[c] = F.coalesce(F.col(f"`{c}`").cast(kind), F.lit(v).cast(kind))
    return df.withColumns(new) if new else df


class SimpleImputer(Component):
    """One strategy for all columns; columns without any value are dropped and texts are left alone."""

    def fit_state(self, df, y=None, impute_strategy="most_frequent", fill_value=None):
        types = schema.logical_types(df)
        columns = [c for c in features_of(df, y) if types[c] != "text"]
        if impute_strategy in ("mean", "median"):
            columns = [c for c in columns if types[c] in schema.NUMERIC]
        values = statistics(df, dict.fromkeys(columns, impute_strategy), dict.fromkeys(columns, 0 if fill_value is None else fill_value))
        if impute_strategy == "constant":
            counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)]).first() if columns else ()
            empty = [c for i, c in enumerate(columns) if not counts[str(i)]]
        else:
            empty = [c for c, v in values.items() if v is None]
        return {"values": {c: v for c, v in values.items() if c not in empty}, "empty": empty}

    def transform(self, df: DataFrame) -> DataFrame:
        return filled(df.drop(*self.learnt()["empty"]), self.learnt()["values"])


class Imputer(Component):
    """A strategy for each group of columns: numbers, categories, booleans."""

    hyperparameters = {"numeric_impute_strategy": ["mean", "median", "most_frequent", "knn"], "categorical_impute_strategy": ["most_frequent"], "boolean_impute_strategy": ["most_frequent"]}

    def fit_state(self, df, y=None, categorical_impute_strategy="most_frequent", categorical_fill_value=None, numeric_impute_strategy="mean", numeric_fill_value=None, boolean_impute_strategy="most_frequent", boolean_fill_value=None):
        types = schema.logical_types(df)
        groups = {"integer": "numeric", "double": "numeric", "boolean": "boolean", "text": None, "datetime": None}
        chosen = {"numeric": (numeric_impute_strategy, 0 if numeric_fill_value is None else numeric_fill_value), "boolean": (boolean_impute_strategy, boolean_fill_value), "categorical": (categorical_impute_strategy, "missing_value" if categorical_fill_value is None else categorical_fill_value)}
        strategies, fill = {}, {}
        for c in features_of(df, y):
            group = groups.get(types[c], "categorical")
            if group:
                strategies[c], fill[c] = chosen[group]
        near = [c for c, s in strategies.items() if s == "knn"]
        values = statistics(df, {c: "mean" if s == "knn" else s for c, s in strategies.items()}, fill)
        return {"values": {c: v for c, v in values.items() if v is not None}, "empty": [c for c, v in values.items() if v is None], "knn": near}

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.learnt()
        return filled(df.drop(*s["empty"]), s["values"])


class PerColumnImputer(Component):
    def fit_state(self, df, y=None, impute_strategies=None):
        chosen = impute_strategies or {}
        strategies = {c: chosen.get(c, {}).get("impute_strategy", "most_frequent") for c in features_of(df, y)}
        values = statistics(df, strategies, {c: chosen.get(c, {}).get("fill_value") for c in strategies})
        return {"values": {c: v for c, v in values.items() if v is not None}, "empty": [c for c, v in values.items() if v is None]}

    transform = SimpleImputer.transform


class TargetImputer(Component):
    """Nulls of the label; raises if it holds nothing else."""

    modifies_target = True

    def fit_state(self, df, y=None, impute_strategy="most_frequent", fill_value=None):
        value = statistics(df, {y: impute_strategy}, {y: fill_value})[y]
        if value is None:
            raise ValueError("the target is fully null")
        return {"value": value}

    def transform(self, df: DataFrame) -> DataFrame:
        return filled(df, {self.learnt()["y"]: self.learnt()["value"]})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df


def forward_fill(c: Column, w) -> Column:
    """The last value before, then the first one after for the head."""
    return F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(c, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))


def backward_fill(c: Column, w) -> Column:
    return F.coalesce(F.first(c, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)), F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))


def interpolated(c: Column, row: Column, w) -> Column:
    """Linear between the neighbours with values, by row number; the head is filled back, the tail holds the last value."""
    past, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(c.isNotNull(), row)
    x0, x1 = F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(ahead)
    p0, p1 = F.last(at, ignorenulls=True).over(past), F.first(at, ignorenulls=True).over(ahead)
    line = x0 + (x1 - x0) * (row - p0) / F.nullif(p1 - p0, F.lit(0))
    return F.coalesce(c, line, x0, x1)


class TimeSeriesImputer(Component):
    """Fills along time within a series: numbers, categories and the label each by their strategy."""

    def fit_state(self, df, y=None, time_index=None, series_id=None, categorical_impute_strategy="forwards_fill", numeric_impute_strategy="interpolate", target_impute_strategy="forwards_fill"):
        return {}

    def transform(self, df: DataFrame) -> DataFrame:
        p, y = self.parameters, self.learnt()["y"]
        types = schema.logical_types(df)
        keys = [k for k in (p["time_index"], p["series_id"]) if k]
        w = (W.partitionBy(p["series_id"]) if p["series_id"] else W.partitionBy(F.lit(0))).orderBy(p["time_index"])
        row = F.row_number().over(w)
        new = {}
        for c in df.columns:
            if c in keys or types[c] in ("text", "datetime"):
                continue
            how = p["target_impute_strategy"] if c == y else p["numeric_impute_strategy"] if types[c] in schema.NUMERIC else p["categorical_impute_strategy"]
            col = F.col(f"`{c}`")
            new[c] = {"forwards_fill": lambda: forward_fill(col, w), "backwards_fill": lambda: backward_fill(col, w), "interpolate": lambda: interpolated(col.cast("double"), F.col("_row"), w)}[how]()
        return df.withColumn("_row", row).withColumns(new).drop("_row")


class KNNImputer(Component):
    """Nulls of numbers by the mean of the nearest rows that have a value, exactly, over all rows of the fitted table.

    Both sides are distinct tuples of values with their counts. Blocks of tuples with nulls meet blocks of the fitted ones;
    each pair of blocks gives the nearest few for each null, and these are merged. Distances skip coordinates that either
    side lacks; ties go to the smaller value. The fitted tuples are a table: below ``storage`` if that is given (needed to
    store the component), else the plan that makes them.
    """

    QUERIES, ROWS = 2000, 20_000

    def fit_state(self, df, y=None, number_neighbors=3, storage=None):
        columns = [c for c in features_of(df, y) if schema.logical_types(df)[c] in schema.NUMERIC]
        table = self._tuples(df, columns).where(" or ".join(f"c{i} is not null" for i in range(len(columns))) or "false")
        if storage:
            table.write.mode("overwrite").parquet(storage)
        self.reference = None if storage else table
        return {"columns": columns}

    @staticmethod
    def _tuples(df: DataFrame, columns: list[str]) -> DataFrame:
        cast = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
        return df.select(*cast).groupBy(*[f"c{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"))

    def transform(self, df: DataFrame) -> DataFrame:
        columns, k = self.learnt()["columns"], self.parameters["number_neighbors"]
        names = [f"c{i}" for i in range(len(columns))]
        if not columns:
            return df
        held = getattr(self, "reference", None)
        held = held if held is not None else df.sparkSession.read.parquet(self.parameters["storage"])
        asked = self._tuples(df, columns).where(" or ".join(f"{c} is null" for c in names)).drop("n")
        left = [-(-asked.count() // self.QUERIES) or 1, -(-held.count() // self.ROWS) or 1]
        deal = lambda d, n, other, own, rest: d.withColumn(own, F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")).withColumn(rest, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        queries, rows = deal(asked, left[0], left[1], "a", "b"), deal(held, left[1], left[0], "b", "a")

        def nearest(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            x, z, n = q[names].to_numpy(dtype=float), r[names].to_numpy(dtype=float), r["n"].to_numpy()
            has_x, has_z = ~np.isnan(x), ~np.isnan(z)
            x0, z0 = np.where(has_x, x, 0.0), np.where(has_z, z, 0.0)
            out = []
            for at in range(0, len(x), 200):
                part = slice(at, at + 200)
                shared = has_x[part].astype(float) @ has_z.T.astype(float)
                d = sum((has_x[part, j, None] & has_z[None, :, j]) * (x0[part, j, None] - z0[None, :, j]) ** 2 for j in range(len(names)))
                d = np.where(shared > 0, d / np.maximum(shared, 1), np.inf)
                for j in range(len(names)):
                    (have,) = np.nonzero(has_z[:, j])
                    order = have[np.lexsort((n[have], z[have, j]))]
                    for i in np.flatnonzero(~has_x[part, j]):
                        near = d[i, order]
                        keep = np.argsort(near, kind="stable")[:k] if len(near) <= 4 * k else np.sort(np.flatnonzero(near <= np.partition(near, k - 1)[k - 1]))
                        keep = keep[np.argsort(near[keep], kind="stable")][:k]
                        out += [(*x[at + i], j, near[m], z[order[m], j], int(n[order[m]])) for m in keep]
            return pd.DataFrame(out, columns=[*names, "j", "d", "v", "w"])

        kinds = ", ".join(f"{c} double" for c in names)
        found = queries.groupBy("a", "b").cogroup(rows.groupBy("a", "b")).applyInPandas(nearest, f"{kinds}, j int, d double, v double, w bigint")
        keys = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in names]
        merged = found.select(*keys, "j", "d", "v", "w").groupBy(*names, "j").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "v", "w"))), 1, k).alias("near"))  # k for each block of rows
        take = F.aggregate("near", F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n")), lambda acc, e: F.struct((acc["s"] + e["v"] * F.least(e["w"], k - acc["n"])).alias("s"), (acc["n"] + F.least(e["w"], k - acc["n"])).alias("n")))
        means = merged.select(*names, "j", take.alias("t")).groupBy(*names).agg(*[F.max(F.when(F.col("j") == j, F.col("t.s") / F.col("t.n"))).alias(f"m{j}") for j in range(len(names))])
        own = [F.col(f"`{c}`").cast("double") for c in columns]
        same = F.lit(True)
        for c, o in zip(names, own, strict=True):
            same = same & o.eqNullSafe(F.col(c))
        joined = df.join(means, same, "left")
        return joined.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"m{columns.index(c)}")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
