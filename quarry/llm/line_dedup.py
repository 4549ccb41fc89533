"""Line dedup: a suffix array over the lines of all documents finds runs of lines that occur before, and deletes them.

Lines with a word are the alphabet; blank lines are passed over. Prefix doubling sorts suffixes by their first 1, 2, 4, ...
lines: a round pairs each suffix' rank with the rank of the suffix that follows its prefix, sorts the distinct pairs over
all partitions, and ranks them in that order. Suffixes whose prefix occurs once leave the array, so a round holds only
what still repeats. Equal ranks are intervals of the suffix array with a common prefix of that many lines; the interval at
any depth between two rounds is given by two overlapping ranks.

A run counts as repeated from ``min_words`` words on. At each line that gives the shortest run of whole lines that
begins there and holds as many, and the shortest one that ends there; a maximal repeated run is the union of these. In
an interval the first run by (doc_id, line) stays and the lines of the others are deleted.

Null texts count as empty. Null ids are ordered last. Rows that repeat an id and its text are one document: all are
treated alike. Ties and overlaps within a text follow the same order, so the first of two equal runs in a text stays.
Texts are read whole, however long; an empty table gives an empty result. Other columns stay, but for ``n_lines`` and
``gone``, which are replaced. Lines and rows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

#: Least number of words of a run that is deleted where it occurs again.
MIN_WORDS = 50
#: Intervals of more members than this, and than one part in MOST_HOT of all, get their rank by a broadcast of theirs.
HOT, MOST_HOT = 2000, 20_000


def content_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")))


def line_table(df: DataFrame, min_words: int) -> DataFrame:
    """(rk, doc_id, pos, h, ahead, back) for each line with a word of texts of ``min_words`` words or more.

    ``ahead`` and ``back`` are the lengths of the shortest runs with enough words that begin or end at the line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for rk, doc_id, text in zip(batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                lines = [(x, n) for x in (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n") if (n := len(x.split()))]
                total = np.cumsum([0] + [n for _, n in lines])
                if total[-1] < min_words:
                    continue
                m = len(lines)
                at = np.arange(m)
                end = np.searchsorted(total, total[:-1] + min_words)  # first end with enough words
                start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
                ahead = np.where(end <= m, end - at, 0)
                back = np.where(total[1:] >= min_words, at - start + 1, 0)
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x, _ in lines), dtype=np.uint64, count=m).view(np.int64)
                for k, v in enumerate((np.full(m, rk), np.full(m, -1 if doc_id is None else doc_id), at, hashes, ahead, back)):
                    out[k].append(v.astype(np.int64))

                if doc_id is None:
                    out[1][-1][:] = np.iinfo(np.int64).max
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["rk", "doc_id", "pos", "h", "ahead", "back"])

    return df.mapInArrow(run, "rk bigint, doc_id bigint, pos bigint, h bigint, ahead bigint, back bigint")


def ranked(members: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """(rk, pos, r) of the members whose keys occur twice or more; r has the order of the keys over all partitions.

    Members of hot keys take their rank from a broadcast table of MOST_HOT rows at most, and pass the join for the others
    spread over all of its tasks.
    """
    classes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = common.written(classes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), f"{tag}-order")
    least = max(HOT, (order.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    named = lambda df, k: df.select(*[F.col(c).alias(f"{k}_{c}") for c in keys], F.col("rank").alias(k))
    hot, cold = named(order.where(F.col("n") > least), "hot"), named(order.where(F.col("n") <= least), "cold")
    same = lambda k: [F.col(c) == F.col(f"{k}_{c}") for c in keys]
    known = members.join(F.broadcast(hot), same("hot"), "left")  # at most MOST_HOT rows
    dealt = known.withColumn("s", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("rk", "pos"), F.lit(1 << 20)) + 1).otherwise(0))
    joined = dealt.join(cold.withColumn("s_", F.lit(0)).hint("merge"), [*same("cold"), F.col("s") == F.col("s_")], "left")
    out = joined.select("rk", "pos", F.coalesce("hot", "cold").alias("r")).where("r is not null")
    out = common.written(out, tag)
    common.release(order)
    return out


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(rk, pos, len): the runs that occur before, from the table of lines."""
    windows = lines.where("ahead > 0").select("rk", "doc_id", "pos", F.col("ahead").alias("len"))
    windows = windows.union(lines.where("back > 0").select("rk", "doc_id", F.col("pos") - F.col("back") + 1, "back")).distinct()
    windows = common.written(windows, "windows")
    longest = windows.agg(F.max("len")).first()[0] or 0
    level, step, found = ranked(lines.select("rk", "pos", "h"), ["h"], "suffixes"), 1, None
    while step <= longest:
        tail = level.select(F.col("rk").alias("t_rk"), F.col("pos").alias("t_pos"), F.col("r").alias("nxt"))
        here = windows.where(f"len >= {step} and len < {2 * step}").join(level, ["rk", "pos"])
        both = here.join(tail, (F.col("rk") == F.col("t_rk")) & (F.col("pos") + F.col("len") - step == F.col("t_pos")))
        both = common.written(both.select("rk", "doc_id", "pos", "len", "r", "nxt"), "intervals")
        firsts = both.groupBy("r", "nxt", "len").agg(F.min(F.struct("doc_id", "rk", "pos")).alias("f"))
        later = both.select("rk", "pos", "len").join(firsts.select(F.col("f.rk").alias("rk"), F.col("f.pos").alias("pos"), "len"), ["rk", "pos", "len"], "left_anti")
        later = common.written(later, "later")
        common.release(both)
        found = later if found is None else found.union(later)
        if 2 * step <= longest:
            pairs = level.join(tail, (F.col("rk") == F.col("t_rk")) & (F.col("pos") + step == F.col("t_pos"))).select("rk", "pos", "r", "nxt")
            following = ranked(pairs, ["r", "nxt"], "suffixes")
            common.release(level)
            level = following
        step *= 2
    common.release(level, windows)
    return lines.select("rk", "pos", F.lit(1).cast("bigint").alias("len")).where("false") if found is None else found


def deletions(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(rk, gone): for each content key with deleted lines their numbers among the text's lines with a word."""
    common.worker_imports(df.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = df.select(content_key(doc_id, text).alias("rk"), F.col(doc_id).cast("bigint").alias("doc_id"), t.alias("text"))
    lines = common.written(line_table(base, min_words).distinct(), "lines")
    runs = repeated_runs(lines)
    each = runs.select("rk", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)).alias("pos"))
    out = common.written(each.groupBy("rk").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")
    common.release(lines)
    return out


def cleaned(text: str, gone: list[int]) -> tuple[str, int]:
    """The text without some of its lines with a word, and how many such lines it had; empty if none are left."""
    drop, kept, n = set(gone), [], 0
    for line in text.split("\n"):
        if line.encode("utf-8", "surrogatepass").split():
            n += 1
            if n - 1 in drop:
                continue
        kept.append(line)
    return ("" if drop and n == len(drop) else "\n".join(kept)), n


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with their text cleaned, and columns ``n_lines`` and ``gone`` (numbers of deleted lines, else null)."""
    gone = deletions(df, text, doc_id, min_words)
    (key,) = common.fresh(df, "_rk")
    base = df.drop(*[c for c in ("n_lines", "gone") if c != text])
    may, right = common.fresh(base, "_may", "_gone_of")
    keyed = common.marked(base.withColumn(key, content_key(doc_id, text)), key, gone.select("rk"), may)
    touched = keyed.where(may).join(gone.withColumnRenamed("rk", right).hint("merge"), F.col(key) == F.col(right), "left")
    joined = touched.unionByName(keyed.where(~F.col(may)), allowMissingColumns=True)
    names = [*base.columns]
    at, mark = names.index(text), len(names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", n_lines bigint, gone array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t, g in zip(batch.column(at), batch.column(mark), strict=True):
                new, n = cleaned(t.as_py() or "", g.as_py() or [])
                texts.append(new if g.is_valid else t.as_py())
                counts.append(n)
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(mark)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), batch.column(mark)], names=[*names, "n_lines", "gone"])

    return joined.select(*names, "gone").mapInArrow(run, schema)


def keep_new(docs: DataFrame) -> DataFrame:
    """The documents without repeated runs; those that consist of nothing else go. ``n_chars`` follows the text."""
    out = dedup(docs.select(*docs.columns))
    out = out.where(F.col("gone").isNull() | (F.size("gone") < F.col("n_lines")))
    out = out.withColumn("n_chars", F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.length("text"))) if "n_chars" in docs.columns else out
    return out.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = dedup(docs)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_deleted"), F.coalesce("gone", F.array().cast("array<bigint>")).alias("deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
