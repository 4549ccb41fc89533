"""Quality rules with thresholds that adapt to each language and source.

Four measures of a text are compared with fences that come from quantile sketches of its (lang, source) group. A sketch
is a table of counts over logarithmic buckets (relative error 1 %): sketches merge by adding counts, whatever the order,
so results do not depend on how rows were dealt out, and a group's sketch, its language's and the whole corpus' come from
one aggregation. A language's sketch is merged with the corpus' as if that were ``prior`` texts, and a group's with its
language's likewise, so a small group follows its language and a large one its own texts, without a step between. Fences lie
beyond the 95th percentile by a multiple of its distance from the median, so that a clean group loses nothing by them.
That percentile is not read off, as junk may hold it, but carried on from the quartile, which junk of up to a quarter of
a group does not reach.

Null texts count as texts without words; they fail the base rule like all texts of under 20 words. Null languages and
sources form groups of their own. Repeated rows are judged each for itself. An empty table gives an empty result. Texts
are read whole, however long. Other columns stay; where they clash, the added ones get another name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.common import SPACE, let

#: Relative width of a sketch's buckets.
GAMMA = 1.02
#: Windows of so many words are compared within a text.
WINDOW = 8
#: Distance of the 95th percentile from the median over that of the upper quartile, in a normal distribution.
TAIL = 1.6449 / 0.6745
#: For each measure: whether it has a lower fence, and the least distance of a fence from the 95th (5th) percentile so found.
MEASURES = {"mean_word": (True, 1.0), "symbol_share": (False, 0.05), "dup_line_share": (False, 0.4), "repeat_share": (False, 0.3)}


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words that lie in n-word windows found twice or more."""

    def covered(at: Column) -> Column:  # at: sorted starts of such windows
        gaps = F.transform(at, lambda p, j: F.least(F.lit(n), F.coalesce(F.get(at, j + 1) - p, F.lit(n))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def twice(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        starts = F.transform(pairs, lambda x, j: F.when(((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))) | same(x, j + 1), x["p"]))
        return let(F.sort_array(F.filter(starts, lambda p: p.isNotNull())), covered)

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, j: F.struct(x.alias("h"), j.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(pairs, twice))

    def of_words(w: Column) -> Column:
        windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda hw: F.transform(F.sequence(F.lit(1), F.size(hw) - (n - 1)), lambda i: F.xxhash64(F.slice(hw, i, n))))
        return F.when(F.size(w) <= n, F.lit(0).cast("bigint")).otherwise(let(windows, of_hashes))

    return let(words, of_words)


def features(text: Column) -> Column:
    """A struct of the text's counts; null texts count as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
        return let(
            F.struct(common.words_of(t).alias("w"), lines.alias("l")),
            lambda s: F.struct(
                F.size(s["w"]).cast("bigint").alias("n_words"),
                F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
                F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
                F.size(s["l"]).cast("bigint").alias("n_lines"),
                (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("bigint").alias("n_dup_lines"),
                repeat_words(s["w"]).alias("n_repeat_words"),
            ),
        )

    return let(text, of_text)


def base_failed(f: str) -> Column:
    """Too few words, or more than 30 % of them in repeated windows."""
    return (F.col(f"{f}.n_words") < 20) | (100 * F.col(f"{f}.n_repeat_words") > 30 * F.col(f"{f}.n_words"))


def measures(f: str) -> dict[str, Column]:
    words = F.greatest(F.col(f"{f}.n_words"), F.lit(1))
    return {
        "mean_word": F.col(f"{f}.word_chars") / words,
        "symbol_share": F.col(f"{f}.n_symbols") / words,
        "dup_line_share": F.col(f"{f}.n_dup_lines") / F.greatest(F.col(f"{f}.n_lines"), F.lit(1)),
        "repeat_share": F.col(f"{f}.n_repeat_words") / words,
    }


def sketches(df: DataFrame, f: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts by (lang, source, measure, bucket) of the texts that pass the base rule; bucket null holds zeros."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), F.when(v > 0, F.floor(F.log(v) / F.log(F.lit(GAMMA)))).cast("int").alias("bucket")) for k, v in measures(f).items()])
    rows = df.where(~base_failed(f)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(each))
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles of each group and measure; a window holds a sketch's buckets, whose number is bounded."""
    run = W.partitionBy(*keys, "measure").orderBy(F.col("bucket").asc_nulls_first())
    whole = W.partitionBy(*keys, "measure")
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket") + 0.5), F.lit(0.0))
    cum = sketch.select(*keys, "measure", value.alias("v"), F.sum("n").over(run).alias("c"), F.sum("n").over(whole).alias("n"))
    return cum.groupBy(*keys, "measure").agg(*[F.min(F.when(F.col("c") >= F.lit(s * (1 - 1e-9)) * F.col("n"), F.col("v"))).alias(k) for k, s in shares.items()])


def fences(sketch: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """One row for each group: (low, high) of each measure."""
    q = quantiles(sketch, keys, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    above, below = TAIL * (F.col("q75") - F.col("q50")), TAIL * (F.col("q50") - F.col("q25"))
    pad = F.create_map(*[x for k, (_, p) in MEASURES.items() for x in (F.lit(k), F.lit(p))])[F.col("measure")]
    lower = F.col("measure").isin([k for k, (low, _) in MEASURES.items() if low])
    high = F.col("q50") + above + F.greatest(reach * above, pad)
    low = F.when(lower, F.col("q50") - below - F.greatest(reach * below, pad)).otherwise(F.lit(-1.0))
    pair = F.struct(low.alias("low"), high.alias("high"))
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == k, pair)).alias(k) for k in MEASURES])


def shrunk(fine: DataFrame, coarse: DataFrame, keys: list[str], coarse_keys: list[str], prior: float) -> DataFrame:
    """The finer groups' sketches, each merged with its coarser group's as if that had ``prior`` texts."""
    packed = coarse.groupBy(*coarse_keys, "measure").agg(F.collect_list(F.struct("bucket", "n")).alias("all"), F.sum("n").alias("total"))  # a sketch's buckets are bounded
    groups = fine.select(*keys, "measure").distinct()
    joined = common.bounded_join(groups, common.written(packed, "coarse"), [*coarse_keys, "measure"])
    share = F.transform("all", lambda x: F.struct(x["bucket"], (F.lit(prior) * x["n"] / F.col("total")).alias("n")))
    both = fine.select(*keys, "measure", "bucket", F.col("n").cast("double")).unionByName(joined.select(*keys, "measure", F.inline(share)))
    return both.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, prior: float = 100.0, reach: float = 4.0) -> DataFrame:
    """Fences for each (lang, source); one row for each pair."""
    of_lang = shrunk(merged(sketch, "lang"), merged(sketch), ["lang"], [], prior)
    own = fences(shrunk(sketch, of_lang, ["lang", "source"], ["lang"], prior), ["lang", "source"], reach)
    return own.select("lang", "source", F.struct(*MEASURES).alias("fence"))


def judged(df: DataFrame, f: str, fences_by_group: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``kept`` to rows that have the struct ``f`` of features."""
    fence, kept = common.fresh(df, "_fence", "kept")
    right = fences_by_group.select(F.col("lang").alias(lang), F.col("source").alias(source), F.col("fence").alias(fence))
    joined = common.bounded_join(df, right, [lang, source])
    inside = F.lit(True)
    for k, v in measures(f).items():
        inside = inside & F.coalesce(v.between(F.col(f"{fence}.{k}.low"), F.col(f"{fence}.{k}.high")), F.lit(True))
    return joined.withColumn(kept, ~base_failed(f) & inside).drop(fence)


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, str, str]:
    """The rows with a struct of features and the verdict, and the names of these two columns.

    The rows and their features are written once, sketched from the columns needed, and joined with the fences.
    """
    (f,) = common.fresh(df, "_features")
    table = common.written(df.withColumn(f, features(F.col(text))), "quality")
    limits = common.written(thresholds(sketches(table, f, lang, source)), "fences")
    out = judged(table, f, limits, lang, source)
    return out, f, [c for c in out.columns if c not in table.columns][0]


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns that they came with."""
    out, _, kept = judge(docs)
    return out.where(F.col(kept)).select(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    table = common.written(docs.select("doc_id", "lang", "source", features(F.col("text")).alias("f")), "quality")
    limits = common.written(thresholds(sketches(table, "f")), "fences")
    out = judged(table, "f", limits)
    return out.select("doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words", base_failed("f").alias("base_failed"), "kept")
