"""Ranks, running sums and neighbours of large tables, without bringing the rows into one task.

Rows are dealt to ranges of the order. What is gathered over all ranges is a row for each of them; the rest is done
within ranges. Rows that tie in the whole order are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows by ranges of the order, with ``_part``; cached, as ranges are drawn from a sample and must stay."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).persist()


def _before(ranges: DataFrame, total: Column) -> DataFrame:
    """(_p, _start): what the ranges before each one sum to; a row for each range."""
    sums = ranges.groupBy(F.col("_part").alias("_p")).agg(total.alias("_t"))
    return sums.select("_p", (F.sum("_t").over(W.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_t")).alias("_start"))


def numbered(df: DataFrame, out: str, *order: Column | str) -> DataFrame:
    """Add 1, 2, 3, ... in the given order."""
    ranges = _ranges(df, *order)
    inner = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    joined = ranges.withColumn(out, inner).join(F.broadcast(_before(ranges, F.count(F.lit(1)))), F.col("_part") == F.col("_p"))
    return joined.withColumn(out, F.col(out) + F.col("_start")).drop("_part", "_p", "_start")


def running(df: DataFrame, sums: dict[str, str], *order: Column | str) -> DataFrame:
    """Add running sums, up to and with each row, of the columns named: {new name: column}."""
    ranges = _ranges(df, *order)
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = ranges.groupBy(F.col("_part").alias("_p")).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    over = W.partitionBy(F.lit(0)).orderBy("_p")
    starts = totals.select("_p", *[(F.sum(f"_t{i}").over(over) - F.col(f"_t{i}")).alias(f"_s{i}") for i in range(len(sums))])  # a row for each range
    joined = ranges.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return joined.withColumns({n: F.col(n) + F.col(f"_s{i}") for i, n in enumerate(sums)}).drop("_part", "_p", *[f"_s{i}" for i in range(len(sums))])


def with_previous(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Add the value of the row before; the first of each range takes it from the last of the ranges before."""
    ranges = _ranges(df, order)
    ends = ranges.groupBy(F.col("_part").alias("_p")).agg(F.max_by(value, order).alias("_last"))
    last = ends.select("_p", F.lag("_last").over(W.partitionBy(F.lit(0)).orderBy("_p")).alias("_last"))  # a row for each range
    joined = ranges.join(F.broadcast(last), F.col("_part") == F.col("_p"))
    own = F.lag(value).over(W.partitionBy("_part").orderBy(order))
    first = F.row_number().over(W.partitionBy("_part").orderBy(order)) == 1
    return joined.withColumn(out, F.when(first, F.col("_last")).otherwise(own)).drop("_part", "_p", "_last")
