"""Row-set partitioning: folds and cuts in the order of a hash of the key, or of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.ordered import numbered
from quarry.operators.sample import hash_order
from quarry.operators.series import valid_for_split


def kfold(df: DataFrame, key: str, k: int = 3, label: str | None = None, seed: int = 0) -> DataFrame:
    """Add ``fold``: rows in hash order, within their label if one is given, dealt in turn."""
    order = (hash_order(F.col(key), seed), F.col(key))
    placed = df.withColumn("fold", F.row_number().over(W.partitionBy(label).orderBy(*order))) if label else numbered(df, "fold", *order)
    return placed.withColumn("fold", F.pmod(F.col("fold") - 1, F.lit(k)).cast("int"))


def hashed_folds(df: DataFrame, key: str, k: int = 3, seed: int = 0) -> DataFrame:
    """Add ``fold`` by the hash alone: no shuffle, sizes equal on average; for tables too large to rank."""
    return df.withColumn("fold", F.pmod(hash_order(F.col(key), seed), F.lit(k)))


def train_test(df: DataFrame, key: str, test_size: float = 0.2, label: str | None = None, seed: int = 0) -> DataFrame:
    """Add ``is_test``: the first rows in hash order, the same share of every label if one is given."""
    order = (hash_order(F.col(key), seed), F.col(key))
    if not label:
        n = df.count()
        return numbered(df, "is_test", *order).withColumn("is_test", F.col("is_test") <= F.ceil(F.lit(n) * test_size))
    parts = W.partitionBy(label)
    return df.withColumn("is_test", F.row_number().over(parts.orderBy(*order)) <= F.ceil(F.count(F.lit(1)).over(parts) * test_size))


def tail_split(df: DataFrame, time_index: str, test_size: float = 0.1, horizon: int | None = None) -> DataFrame:
    """Add ``is_test``: the latest timestamps, at least the horizon's number of them; all series are cut at one time."""
    place = F.dense_rank().over(W.orderBy(F.desc(time_index)))
    n = df.select(time_index).distinct().count()
    return df.withColumn("is_test", place <= max(int(n * test_size), horizon or 1))


def time_series_split(df: DataFrame, time_index: str, n_splits: int = 3, horizon: int = 1, gap: int = 0, max_delay: int = 0, n_series: int = 1) -> DataFrame:
    """(split, is_test, row): rolling-origin splits whose test sets are the horizon's rows; raises if there are too few."""
    n = df.count()
    if not valid_for_split(gap, max_delay, horizon, n // n_series, n_splits):
        raise ValueError("too few rows for these splits")
    size = horizon * n_series
    rows = numbered(df, "_i", time_index)
    start = F.lit(n) - (F.lit(n_splits) - F.col("split")) * size
    spread = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return spread.where(F.col("_i") <= start + size).withColumn("is_test", F.col("_i") > start).drop("_i")


def make_splitter(n_rows: int, problem_type: str, n_splits: int = 3, **config) -> dict:
    """Which split to use: rolling origin for time series, one of 75 % validation above 100 000 rows, else folds."""
    if problem_type.startswith("time_series") or problem_type.startswith("multiseries"):
        return {"kind": "time_series", "n_splits": n_splits, **config}
    if n_rows > 100_000:
        return {"kind": "single", "test_size": 0.75, "stratify": problem_type != "regression"}
    return {"kind": "stratified" if problem_type != "regression" else "kfold", "n_splits": n_splits}


def no_split(df: DataFrame) -> DataFrame:
    """Add ``is_test``, false everywhere: all rows train."""
    return df.withColumn("is_test", F.lit(False))


def resplit(train: DataFrame, key: str, test_size: float = 0.1, label: str | None = None, time_index: str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training rows anew as training and validation rows: the last ones where there is a time, else by hash."""
    cut = tail_split(train, time_index, test_size) if time_index else train_test(train, key, test_size, label, seed)
    return cut.where("not is_test").drop("is_test"), cut.where("is_test").drop("is_test")


def detect_problem_type(df: DataFrame, y: str) -> str:
    """By the number of distinct labels, and whether they are numbers."""
    n = df.agg(F.count_distinct(F.col(f"`{y}`"))).first()[0]
    if n < 2:
        raise ValueError("the target has fewer than two classes")
    if n == 2:
        return "binary"
    return "regression" if n > 10 and df.schema[y].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") else "multiclass"
