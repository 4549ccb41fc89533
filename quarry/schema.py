"""Logical column types, kept in field metadata, and rules that infer them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
NUMERIC = ("integer", "double")


def tagged(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The table with logical types written into the metadata of its fields."""
    for name, kind in types.items():
        df = df.withMetadata(name, df.schema[name].metadata | {"logical_type": kind})
    return df


def plain_type(field: T.StructField) -> str | None:
    """The logical type that a Spark type alone decides; None for strings."""
    kind = field.dataType
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "double"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return None if isinstance(kind, T.StringType) else "unknown"


def logical_types(df: DataFrame) -> dict[str, str]:
    """The logical type of each column: from metadata if it has one, else from the Spark type; strings are categories."""
    return {f.name: f.metadata.get("logical_type") or plain_type(f) or "category" for f in df.schema.fields}


def infer(df: DataFrame, given: dict[str, str] | None = None, max_categories: int = 1000, share: float = 0.95) -> DataFrame:
    """Attach logical types; one aggregation tells strings that are emails, URLs, texts, categories or empty apart."""
    given = dict(given or {})
    strings = [f.name for f in df.schema.fields if plain_type(f) is None and f.name not in given and "logical_type" not in f.metadata]
    types = {f.name: plain_type(f) for f in df.schema.fields if plain_type(f) and "logical_type" not in f.metadata} | given
    if strings:
        aggs = []
        for i, name in enumerate(strings):
            c = F.col(f"`{name}`")
            aggs += [
                F.count(c).alias(f"n{i}"),
                F.count(F.when(c.rlike(EMAIL), 1)).alias(f"e{i}"),
                F.count(F.when(c.rlike(URL), 1)).alias(f"u{i}"),
                F.approx_count_distinct(c).alias(f"d{i}"),
                F.avg(F.size(F.split(F.trim(c), r"\s+"))).alias(f"w{i}"),
            ]
        got = df.agg(*aggs).first()
        for i, name in enumerate(strings):
            n, emails, urls, distinct, words = (got[f"{k}{i}"] for k in "neudw")
            if not n:
                types[name] = "unknown"
            elif emails >= share * n:
                types[name] = "email"
            elif urls >= share * n:
                types[name] = "url"
            elif distinct <= min(max_categories, max(10, 0.5 * n)) and (words or 0) <= 4:
                types[name] = "category"
            else:
                types[name] = "text" if (words or 0) > 2 else "unknown"
    return tagged(df, {k: v for k, v in types.items() if v})


def of_type(df: DataFrame, *kinds: str) -> list[str]:
    return [name for name, kind in logical_types(df).items() if kind in kinds]


def schema_equal(first: T.StructType, other: T.StructType) -> bool:
    """Loose equality: same names in order, with integers and doubles taken as one type."""
    loose = lambda f: "number" if plain_type(f) in NUMERIC else plain_type(f) or "string"
    return [(f.name, loose(f)) for f in first] == [(f.name, loose(f)) for f in other]
