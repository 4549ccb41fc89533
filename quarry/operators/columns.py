"""Column selection and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import schema
from quarry.operators.base import Component, features_of


def null_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of nulls in each column, in one aggregation."""
    if not columns:
        return {}
    got = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(str(i)) for i, c in enumerate(columns)]).first()
    return {c: got[str(i)] or 0.0 for i, c in enumerate(columns)}


def complete(columns: list[str]) -> Column:
    """Whether a row has no null among the columns."""
    return reduce(lambda a, c: a & F.col(f"`{c}`").isNotNull(), columns, F.lit(True))


class DropColumns(Component):
    def fit_state(self, df, y=None, columns=()):
        return {}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.parameters["columns"])


class SelectColumns(Component):
    """Columns in the order asked for; absent ones are skipped."""

    def fit_state(self, df, y=None, columns=()):
        return {}

    def transform(self, df: DataFrame) -> DataFrame:
        y = (self.state or {}).get("y")
        wanted = [c for c in self.parameters["columns"] if c in df.columns]
        return df.select(*[f"`{c}`" for c in wanted], *([f"`{y}`"] if y in df.columns and y not in wanted else []))


class SelectByType(Component):
    def fit_state(self, df, y=None, column_types=(), exclude=False):
        return {}

    def transform(self, df: DataFrame) -> DataFrame:
        kinds, y = self.parameters["column_types"], (self.state or {}).get("y")
        types = schema.logical_types(df)
        return df.select(*[f"`{c}`" for c in df.columns if c == y or (types[c] in kinds) != self.parameters["exclude"]])


class DropNullColumns(Component):
    """Drop columns whose share of nulls reaches the threshold; with threshold 0 those with any null."""

    def fit_state(self, df, y=None, pct_null_threshold=1.0):
        shares = null_shares(df, features_of(df, y))
        return {"drop": [c for c, s in shares.items() if (s > 0 if pct_null_threshold == 0 else s >= pct_null_threshold)]}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.learnt()["drop"])


class DropNaNRowsTransformer(Component):
    def transform(self, df: DataFrame) -> DataFrame:
        return df.where(complete(df.columns))


class DropRowsTransformer(Component):
    """Drop the rows with the listed keys; fitting raises if a key is absent."""

    training_only = True

    def fit_state(self, df, y=None, key=None, keys_to_drop=()):
        if keys_to_drop:
            listed = df.sparkSession.createDataFrame([(k,) for k in set(keys_to_drop)], T.StructType([T.StructField("k", df.schema[key].dataType)]))
            absent = listed.join(df.select(F.col(key).alias("k")), "k", "left_anti").count()
            if absent:
                raise ValueError(f"{absent} of the rows to drop are not in the table")
        return {}

    def transform(self, df: DataFrame) -> DataFrame:
        return drop_keys(df, self.parameters["key"], self.parameters["keys_to_drop"])


def drop_keys(df: DataFrame, key: str, keys) -> DataFrame:
    """Anti join with a list of keys."""
    if not keys:
        return df
    listed = df.sparkSession.createDataFrame([(k,) for k in set(keys)], T.StructType([T.StructField(key, df.schema[key].dataType)]))
    return df.join(listed, key, "left_anti")


class ReplaceNullableTypes(Component):
    """Whole numbers that may be null become doubles, booleans that may be null categories."""

    def fit_state(self, df, y=None):
        types, shares = schema.logical_types(df), null_shares(df, df.columns)
        return {"double": [c for c in df.columns if types[c] == "integer" and shares[c]], "string": [c for c in df.columns if types[c] == "boolean" and shares[c]]}

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.learnt()
        return df.withColumns({c: F.col(f"`{c}`").cast(kind) for kind in ("double", "string") for c in s[kind] if c in df.columns})


def bool_to_double(df: DataFrame, include_ints: bool = False) -> DataFrame:
    kinds = ("boolean", "integer") if include_ints else ("boolean",)
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in schema.of_type(df, *kinds)})


def float_category(c: Column) -> Column:
    """A category held as floating-point number as text: whole numbers without a fraction."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def pad_with_nulls(df: DataFrame, n: int, order: str) -> DataFrame:
    """n null rows before the table, with ``order`` counting down from -1."""
    if n <= 0:
        return df
    pad = df.sparkSession.range(n).select((-F.col("id") - 1).cast(df.schema[order].dataType).alias(order))
    return pad.unionByName(df, allowMissingColumns=True).select(*df.columns)


def is_all_numeric(df: DataFrame) -> bool:
    types = schema.logical_types(df)
    return all(types[c] in schema.NUMERIC for c in df.columns) and not any(null_shares(df, df.columns).values())
