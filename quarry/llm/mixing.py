"""Mixing sources to target weights.

Every source's documents, in an order that depends on their ids alone, form one stream of words that is packed into
blocks of ``block`` words; the stream's rest is a short last block. Targets share out the mix by weight and stop at
``most`` times a source's size. A source's target is a number of slots: whole passes over its blocks, then part of one
more pass. How many slots of each source an output shard takes is drawn from a multinomial distribution (over the shards
for each source, so that the draws keep every source's total); shards take their slots in the order of the source's
slots. Each pass maps its slots to blocks by a pseudorandom permutation of its own, the short block last, and the last
slot is cut where the target is reached, so that a source gives its target to the word. Slots meet the documents' pieces
by joining on source and block index, so a hot source is spread over its blocks.

Null sources form one source, ordered last; null and empty texts have size 0 and are not taken. Documents that share an
id are ordered by size; identical rows are interchangeable. Empty tables give empty results. Texts are read whole, and
a long one is as many pieces as it has blocks. Other columns may have any names; the results have their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.common import SPACE

#: Words in a block, slots in an output shard on average, documents in a bucket whose prefix sums one task computes.
BLOCK, SHARD_SLOTS, BUCKET_DOCS = 256, 4096, 4000
#: Multipliers of the permutations; one that does not divide the number of blocks is coprime to it.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(common.words_of(text.cast("string"))), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source its size, number of documents and target, from (source, n_docs, source_size).

    Weights repeat over the sources in code-point order. What a source's cap leaves is shared out again by weight until
    no target is above its cap; that is the largest common level at which no cap is exceeded, found in a few sums.
    """
    sizes, rank = common.numbered(sizes, "rank", F.col("source").asc_nulls_last()), F.col("rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    table = common.written(sizes.withColumn("weight", pick).drop("rank").withColumn("cap", most * F.col("source_size")), "sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while total:
        full = F.col("weight") * F.lit(level) >= F.col("cap") if capped >= 0 else F.lit(False)
        got = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).first()
        if got[2] == capped or not got[1]:
            break
        capped, level = got[2], (total - got[0]) / got[1]
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap"))).drop("cap")


def offsets(rows: DataFrame) -> DataFrame:
    """Add each document's first word's place in its source's stream, from (uid, doc_id, source, size, n_docs).

    A source's documents are dealt over buckets by a hash of their ids; sums run within buckets and over buckets' totals.
    """
    place = F.xxhash64("doc_id")
    dealt = rows.withColumn("bucket", F.pmod(place, F.greatest(F.ceil(F.col("n_docs") / BUCKET_DOCS), F.lit(1))))
    in_bucket = W.partitionBy("source", "bucket").orderBy(place, "doc_id", "size", "uid").rowsBetween(W.unboundedPreceding, -1)
    inner = dealt.withColumn("inner", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), F.coalesce(F.sum("s").over(before.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    joined = inner.join(starts, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_")))
    return joined.withColumn("at", F.col("outer") + F.col("inner")).drop("s_", "b_", "outer", "inner", "bucket")


def permuted(i: Column, n: Column, key: Column) -> Column:
    """Place i of a pseudorandom permutation of 0..n-1; the key chooses the permutation."""
    first = F.pmod(key, F.lit(len(PRIMES)))
    p = None
    for k in range(len(PRIMES)):
        prime = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(first + k, F.lit(len(PRIMES))) + 1).cast("int")).cast("bigint")
        p = F.when(n % prime != 0, prime) if p is None else p.when(n % prime != 0, prime)
    wide = lambda c: c.cast("decimal(19,0)")
    return F.pmod(wide(F.pmod(p, n)) * wide(i) + wide(F.pmod(F.shiftright(key, 8), n)), wide(n)).cast("bigint")


def shard_counts(plan: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(source, shard, first, n): how many slots of each source each shard draws, and the first one's number.

    A source's counts over the shards are multinomial, every shard as likely as another; shards that draw none have no row.
    """
    common.worker_imports(plan.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (key, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                drawn = np.random.default_rng([seed, key & 0xFFFFFFFFFFFFFFFF]).multinomial(n, np.full(shards, 1 / shards))
                first = np.cumsum(drawn) - drawn
                (some,) = np.nonzero(drawn)
                for at in range(0, len(some), 100_000):
                    part = some[at : at + 100_000]
                    source = pa.repeat(batch.column(0)[k], len(part)) if batch.column(0)[k].is_valid else pa.nulls(len(part), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([source, pa.array(part.astype(np.int64)), pa.array(first[part]), pa.array(drawn[part])], names=["source", "shard", "first", "n"])

    rows = plan.select("source", F.xxhash64(F.lit("shards"), "source").alias("key"), "n_slots")
    return rows.mapInArrow(run, f"source {plan.schema['source'].dataType.simpleString()}, shard bigint, first bigint, n bigint")


def slots(by_source: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """One row for each slot of the mix: source, slot, pass, shard, index of its block, and how many words it takes."""
    size, goal = F.col("source_size"), F.round(F.col("target")).cast("bigint")
    plan = by_source.where((size > 0) & (goal > 0)).select(
        "source", "source_size",
        F.expr(f"source_size div {block}").alias("whole"),
        (size % block).alias("rest"),
        goal.alias("goal"),
        (F.expr(f"source_size div {block}") + F.when(size % block > 0, 1).otherwise(0)).alias("n_blocks"),
    )
    plan = plan.withColumn("passes", F.expr("goal div source_size")).withColumn("left", F.expr("goal % source_size"))
    plan = common.written(plan.withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("left") / block)), "plan")
    shards = -(-(plan.agg(F.sum("n_slots")).first()[0] or 0) // shard_slots) or 1
    counts = common.written(shard_counts(plan, shards, seed), "shards")  # a row for each source and shard
    dealt = counts.repartition(_tasks(counts, shards), "source", "shard")
    each = dealt.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).drop("first", "n")
    each = common.bounded_join(each, plan, ["source"])
    one_pass = each.withColumn("pass", F.expr("slot div n_blocks")).withColumn("i", F.expr("slot % n_blocks"))
    key = F.xxhash64(F.lit(seed), F.col("source"), F.col("pass"))
    index = F.when(F.col("i") < F.col("whole"), permuted(F.col("i"), F.greatest(F.col("whole"), F.lit(1)), key)).otherwise(F.col("whole"))
    length = F.when(F.col("i") < F.col("whole"), F.lit(block).cast("bigint")).otherwise(F.col("rest"))
    room = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("left") - F.col("i") * block))
    return one_pass.select("source", "slot", "pass", "shard", index.alias("index"), room.alias("words"))


def _tasks(df: DataFrame, shards: int) -> int:
    """As many tasks as the session has for shuffles, or one for 16 shards if these are more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(shards // 16, 100_000))


def pieces(placed: DataFrame, slot_rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Parts of documents that slots of the mix take: uid, pass and shard of the slot, first and end word."""
    end = F.col("at") + F.col("size") - 1
    parts = placed.where("size > 0").select("uid", "source", "at", "size", F.explode(F.sequence(F.expr(f"at div {block}"), F.floor(end / block))).alias("index"))
    first = F.greatest(F.col("at"), F.col("index") * block)
    last = F.least(F.col("at") + F.col("size"), (F.col("index") + 1) * block)
    parts = parts.select("uid", F.col("source").alias("s_"), F.col("index").alias("i_"), (first - F.col("at")).alias("a"), (last - F.col("at")).alias("end"), (first - F.col("index") * block).alias("in_block"))
    joined = parts.hint("merge").join(slot_rows, F.col("s_").eqNullSafe(F.col("source")) & (F.col("i_") == F.col("index")))
    return joined.select("uid", "pass", "shard", "a", F.least(F.col("end"), F.col("a") + F.col("words") - F.col("in_block")).alias("b")).where("b > a")


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", block: int = BLOCK, seed: int = 0, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with uid, size, source_size, target and at; pieces taken; slots). ``keep``: with all their columns."""
    cols = {"doc_id": F.col(doc_id), "source": F.col(source), "size": n_words(F.col(text)), "uid": F.monotonically_increasing_id()}
    own = F.struct(*[F.col(c) for c in df.columns]).alias("row") if keep else F.lit(None).cast("string").alias("row")
    rows = common.written(df.select(*[c.alias(k) for k, c in cols.items()], own), "mix")
    by_source = common.written(targets(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))), "targets")
    facts = by_source.select("source", "n_docs", "source_size", "target")
    known = common.bounded_join(rows.drop("row"), facts, ["source"])
    placed = offsets(known)
    slot_rows = slots(by_source, block, seed=seed)
    return known if not keep else rows, pieces(placed, slot_rows, block), slot_rows


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, taken, _ = mix(common.documents(spark, sf_dir).select("doc_id", "source", "text"))
    sums = taken.groupBy(F.col("uid").alias("u_")).agg(F.sum(F.col("b") - F.col("a")).alias("t"), F.min_by("shard", F.struct("pass", "a")).alias("shard"))
    out = docs.join(sums, F.col("uid") == F.col("u_"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("t", F.lit(0)).cast("bigint").alias("taken"), "shard")


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 0, shard: str | None = None) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, with those words as text.

    A copy that takes all words has the whole text; others have their words with the white space after each. ``n_chars``,
    where there is such a column, is that of the new text. ``shard`` names a column to add: the output shard that takes
    the copy's first words.
    """
    rows, taken, _ = mix(docs, block=block, seed=seed, keep=True)
    spans = taken.groupBy(F.col("uid").alias("u_"), F.col("pass").alias("copy")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"), F.min_by("shard", "a").alias("shard"))
    joined = rows.join(spans, F.col("uid") == F.col("u_"))
    words = F.split(F.regexp_replace(F.col("row.text"), f"^[{SPACE}]+", ""), f"(?<=[{SPACE}])(?=[^{SPACE}])")
    n = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["b"] - s["a"])
    cut = common.let(words, lambda w: F.array_join(F.flatten(F.transform(F.col("spans"), lambda s: F.slice(w, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))), ""))
    text = F.when(n == F.col("size"), F.col("row.text")).otherwise(cut)
    kept = [(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != shard]
    out = joined.select(*kept, *([F.col("shard").alias(shard)] if shard else []))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
