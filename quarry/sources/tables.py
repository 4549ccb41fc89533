"""Access to the supplied parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, read by Spark whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def holed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with nulls in fixed places: every fifth type and every third value."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))


def load_data(spark: SparkSession, path: str, index: str, target: str, n_rows: int | None = None, drop: list[str] | None = None, schema: str | None = None) -> tuple[DataFrame, str]:
    """A CSV file as one table that keeps its index as a key column, and the name of the target."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df = df.limit(n_rows) if n_rows else df
    df = df.drop(*(drop or []))
    for name in (index, target):
        if name and name not in df.columns:
            raise ValueError(f"no column {name!r}")
    return df, target


def number_of_features(df: DataFrame) -> DataFrame:
    """Columns of each coarse type."""
    from quarry.schema import logical_types

    coarse = {"boolean": "Boolean", "integer": "Numeric", "double": "Numeric", "datetime": "DateTime"}
    counts: dict[str, int] = {}
    for kind in logical_types(df).values():
        counts[coarse.get(kind, "Categorical")] = counts.get(coarse.get(kind, "Categorical"), 0) + 1
    return df.sparkSession.createDataFrame(list(counts.items()), "type string, n_features int")


def target_distribution(df: DataFrame, y: str) -> DataFrame:
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(y, F.format_string("%.2f%%", 100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).alias("share"))
