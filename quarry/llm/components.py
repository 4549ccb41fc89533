"""Connected components of links, by rounds of smallest neighbours and pointer jumps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, label): for every end of a link (a, b) of longs, the smallest number that links reach from it.

    A round lowers each label to the least among its neighbours', then to its label's label. What a task gathers for a
    vertex is a minimum, so a vertex with very many links is no larger than others. Links may repeat.
    """
    both = common.written(links.select("a", "b").union(links.select("b", "a")).toDF("v", "u").where("v != u"), "links")
    labels = common.written(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("v", "w"), F.col("u") == F.col("w")).groupBy("v").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("v", "w"), F.col("v") == F.col("w"), "left").select("v", F.least("label", F.coalesce("near", "label")).alias("low"), F.col("label").alias("was"))
        jump = labels.select(F.col("v").alias("w"), F.col("label").alias("far"))
        nxt = lower.join(jump, F.col("low") == F.col("w"), "left").select("v", F.least("low", F.coalesce("far", "low")).alias("label"), "was")
        nxt = common.written(nxt, "labels")
        changed = nxt.where("label != was").limit(1).count()
        common.release(labels)
        labels = nxt.drop("was")
        labels.quarry_path = nxt.quarry_path
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
