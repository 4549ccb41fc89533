"""Toxicity by class-conditional Kneser-Ney models of words.

Labelled texts are read as pairs of a word and the word before it. A word's count in a class is the number of different
words that it follows there, as in the lower order of Kneser-Ney: a word that a copied phrase repeats counts once for it.
Each class' probabilities are these counts less a discount; what the discount takes goes to the counts that both classes
share, with one weight for both, so that a rare word which neither class knows well says nothing. Pairs, the highest
order, have their occurrences less a discount of their own, and fall back to the words' probabilities with one weight for
both classes. Differences of the two log-likelihoods score words, and pairs beyond their words.

A text's features are the words' difference, normalised by length, over the whole text and over its strongest runs of 1,
4 and 12 words, so that an insult is not diluted by the length of the text around it, and what pairs add, over the whole
text and at the strongest pair. A logistic function of these features gives the score. It is fitted on at most
``MAX_CALIBRATION`` labelled texts that the counts leave out: of the fifth of ids that a hash marks, those with the least
hashes.

Words are hashed to 34 bits, words before them to 28. The table of differences has every word and every pair that a class
has more often than the discount: any other word's difference is exactly zero, any other pair's is its word's, so nothing
is cut. It grows with the corpus. One of up to ``BROADCAST_CODES`` rows is broadcast, and texts are scored in one pass; a larger one is joined with the distinct words and
pairs of blocks of texts. Both ways give the same scores. Texts are read whole, however long; memory holds one Arrow batch, and a
block where there are blocks.

Null and empty texts get the score of texts without words. Labels are joined by id: null ids have none, several labels
of an id count as toxic if one is. Labels, languages, sources and ids are no inputs of scores. Without labels of both
classes every score is the share of the one class there is (0 without any); if the texts left out are of one class, the
function is fitted on counted ones. Repeated rows are scored each for itself. An empty table gives an empty result. Other
columns stay as they are, whatever their names, but for a column named like the result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, shingles

#: Bits of a word's hash and of the one before it, discounts of words and of pairs, added to each shared count.
BITS, BEFORE_BITS, DISCOUNT, PAIR_DISCOUNT, ADDED = 34, 28, 1.0, 4.0, 0.5
#: Lengths of runs, texts that the logistic function is fitted on.
RUNS, MAX_CALIBRATION = (1, 4, 12), 4000
FEATURES = len(RUNS) + 3
#: Tables of differences of up to this many rows (12 bytes each) are broadcast; larger ones are joined by blocks of texts.
BROADCAST_CODES = 2_000_000
#: Characters of texts in a block.
BLOCK = 8_000_000
#: Labels up to this many rows (12 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 500_000

_START = (1 << BEFORE_BITS) - 1
_LETTERS = np.array([32 if b < 128 and not chr(b).isalnum() else b + 32 * (65 <= b <= 90) for b in range(256)], dtype=np.uint8)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word and code of the word with the one before it, for all words of some texts."""
    parts = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    with np.errstate(over="ignore"):
        hashes, start = shingles.word_hashes(_LETTERS[np.frombuffer(b"".join(parts), dtype=np.uint8)])
    doc = np.searchsorted(np.cumsum([len(p) for p in parts]), start, side="right")
    word = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    before = np.concatenate([[_START], word[:-1] % _START])[: len(word)]
    before[np.concatenate([[True], doc[1:] != doc[:-1]])[: len(word)]] = _START
    return doc, word, (word << BEFORE_BITS) | before


def counted(labelled: DataFrame) -> DataFrame:
    """(code, toxic, ordinary): occurrences of each word with the one before it by class, from (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(codes: list, ones: list) -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            both = np.concatenate(ones)
            return code, np.stack([np.bincount(at, both[:, 0], len(code)), np.bincount(at, both[:, 1], len(code))], 1)

        codes, ones, size = [], [], 0
        for batch in batches:
            mark, low = batch.column(0).to_numpy(), 0
            for part in shingles.chunks(batch.column(1)):
                doc, _, pair = tokens(part)
                toxic = mark[low : low + len(part)][doc] == 1
                low += len(part)
                code, n = summed([pair], [np.stack([toxic, ~toxic], 1)])
                codes.append(code)
                ones.append(n)
                size += len(code)
                if size > 2_000_000:
                    code, n = summed(codes, ones)
                    codes, ones, size = [code], [n], 0
        if codes:
            code, n = summed(codes, ones)
            for at in range(0, len(code), 100_000):
                part = n[at : at + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code[at : at + 100_000]), pa.array(part[:, 0]), pa.array(part[:, 1])], names=["code", "toxic", "ordinary"])

    each = labelled.mapInArrow(run, "code bigint, toxic bigint, ordinary bigint")
    return each.groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def lower_order(counts: DataFrame) -> DataFrame:
    """(word, toxic, ordinary, shared): the different words before each word, by class and in all."""
    some = lambda c: F.count(F.when(F.col(c) > 0, 1)).alias(c)
    return counts.groupBy(F.shiftright("code", BEFORE_BITS).alias("word")).agg(some("toxic"), some("ordinary"), F.count(F.lit(1)).alias("shared"))


def kept(c: str, discount: float) -> Column:
    return F.greatest(F.col(c) - discount, F.lit(0.0))


def of_words(words: DataFrame) -> DataFrame:
    """(word, p_toxic, p_ordinary) of all words of :func:`lower_order`. They and one unseen word's sum to 1 in each class."""
    k = lambda c: kept(c, DISCOUNT)
    t, o, kt, ko, n, size = (float(x or 0) for x in words.agg(*[F.sum(x) for x in ("toxic", "ordinary", k("toxic"), k("ordinary"), "shared")], F.count(F.lit(1))).first())
    weight = 1 - min(kt / t, ko / o) if kt and ko else 1.0
    shared = weight * (F.col("shared") + ADDED) / F.lit(n + ADDED * (size + 1))
    p = lambda c, total: (1 - weight) * k(c) / F.lit(max(total, 1.0)) + shared
    return words.select("word", p("toxic", kt).alias("p_toxic"), p("ordinary", ko).alias("p_ordinary"), ((F.col("toxic") > DISCOUNT) | (F.col("ordinary") > DISCOUNT)).alias("tells"))


def of_pairs(counts: DataFrame, words: DataFrame) -> DataFrame:
    """(code, q_toxic, q_ordinary) of the pairs that a class has more often than the discount, from :func:`of_words`."""
    k = lambda c: kept(c, PAIR_DISCOUNT)
    before = F.col("code").bitwiseAND(F.lit(_START))
    share = lambda c: F.sum(k(c)) / F.greatest(F.sum(c), F.lit(1))
    weight = 1 - F.least(share("toxic"), share("ordinary"))  # of the words, one for both classes
    contexts = counts.groupBy(before.alias("before")).agg(weight.alias("weight"), F.sum(k("toxic")).alias("kt"), F.sum(k("ordinary")).alias("ko")).where("weight < 1")
    strong = counts.where((F.col("toxic") > PAIR_DISCOUNT) | (F.col("ordinary") > PAIR_DISCOUNT)).select("code", before.alias("before"), F.shiftright("code", BEFORE_BITS).alias("word"), "toxic", "ordinary")
    joined = strong.join(contexts.hint("merge"), "before").join(words.hint("merge"), "word")
    q = lambda c, total, p: (1 - F.col("weight")) * k(c) / F.greatest(F.col(total), F.lit(1.0)) + F.col("weight") * F.col(p)
    return joined.select("code", q("toxic", "kt", "p_toxic").alias("q_toxic"), q("ordinary", "ko", "p_ordinary").alias("q_ordinary"))


def differences(counts: DataFrame) -> DataFrame:
    """(code, gap): log-likelihood differences of pairs, and of words under codes of -1 - word, written."""
    words = common.written(of_words(common.written(lower_order(counts), "words")), "single")
    pairs = of_pairs(counts, words).select("code", (F.log("q_toxic") - F.log("q_ordinary")).cast("float").alias("gap"))
    single = words.where("tells").select((-1 - F.col("word")).alias("code"), (F.log("p_toxic") - F.log("p_ordinary")).cast("float").alias("gap"))
    out = common.written(single.unionAll(pairs), "differences")
    common.release(words)
    return out


class Model:
    """Log-likelihood differences by sorted code, and the weights of the features."""

    def __init__(self, codes: np.ndarray, gaps: np.ndarray, fit: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.gaps, self.fit = codes[order], gaps[order], fit

    def found(self, code: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return otherwise
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.gaps[at], otherwise)

    def features(self, texts: list[str]) -> np.ndarray:
        doc, word, pair = tokens(texts)
        n = np.bincount(doc, minlength=len(texts))
        out = np.zeros((len(texts), FEATURES))
        if len(word):
            gap = self.found(-1 - word, np.zeros(len(word)))
            more = self.found(pair, gap) - gap
            some, start = n > 0, np.concatenate([[0], np.cumsum(n)[:-1]])
            for k, x in ((0, gap), (1, more)):
                out[:, k] = np.bincount(doc, x, minlength=len(texts)) / np.maximum(n, 1)
            out[some, 2] = np.maximum.reduceat(more, start[some])
            run = np.concatenate([[0.0], np.cumsum(gap)])
            at = np.arange(len(gap))
            for k, width in enumerate(RUNS, 3):
                value = (run[np.minimum(at + width, (start + n)[doc])] - run[at]) / width
                out[some, k] = np.maximum.reduceat(value, start[some])
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.features(texts) @ self.fit[:-1] + self.fit[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, l2: float = 1e-3) -> np.ndarray:
    """Weights and intercept by Newton's method with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + (l2 * len(x) + 1e-9) * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + l2 * len(x) * np.append(w[:-1], 0.0))
    return w


def fold(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


class Trained:
    """The table of differences, and the weights and intercept of the features."""

    def __init__(self, table: DataFrame):
        self.table, self.fit = table, np.zeros(FEATURES + 1)
        self.small = table.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES


def mapped(df: DataFrame, model: Trained, text: str, out: str, kind: str) -> DataFrame:
    """Add the features (array<double>) or the score (double) of each text."""
    common.worker_imports(df.sparkSession)
    at, names, fit = df.columns.index(text), df.columns, model.fit
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out}` {kind}"])

    def values(m: Model, texts: pa.Array) -> pa.Array:
        if kind == "double":
            return pa.array(np.concatenate([m.score(p) for p in shingles.chunks(texts)] or [np.zeros(0)]))
        return pa.array(list(np.concatenate([m.features(p) for p in shingles.chunks(texts)] or [np.zeros((0, FEATURES))])), pa.list_(pa.float64()))

    if model.small:
        got = model.table.toArrow()  # at most BROADCAST_CODES rows
        held = df.sparkSession.sparkContext.broadcast(Model(got["code"].to_numpy(), got["gap"].to_numpy(), fit))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, values(held.value, batch.column(at))], names=[*names, out])

        return df.mapInArrow(run, schema)

    block, b = common.fresh(df, "_block", "_b")
    rows = [F.col(f"`{c}`") for c in names if df.schema[c].dataType.typeName() != "map"]
    blocks = (df.agg(F.sum(F.length(F.col(f"`{text}`").cast("string")))).first()[0] or 0) // BLOCK + 1
    table = common.written(df.withColumn(block, F.pmod(F.xxhash64(*rows), F.lit(blocks))).repartition(block).sortWithinPartitions(block), "blocks")

    def distinct_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, number = 0, batch.column(0).to_numpy()
            for part in shingles.chunks(batch.column(1)):
                doc, word, pair = tokens(part)
                of = number[low : low + len(part)][doc]
                low += len(part)
                for k in np.unique(of):
                    some = np.unique(np.concatenate([pair[of == k], -1 - word[of == k]]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some)], names=[b, "code"])

    asked = table.select(block, F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(distinct_codes, f"{b} bigint, code bigint").distinct()
    found = common.salted_join(asked, model.table, ["code"]).where("gap is not null")

    def scored_block(left: pa.Table, right: pa.Table) -> pa.Table:
        m = Model(right["code"].to_numpy(), right["gap"].to_numpy(), fit)
        left = left.select(names).combine_chunks()
        texts = left.column(at).combine_chunks() if left.num_rows else pa.array([], pa.string())
        return left.append_column(out, values(m, texts))

    return table.groupBy(block).cogroup(found.groupBy(b)).applyInArrow(scored_block, schema)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_calibration: int = MAX_CALIBRATION) -> Trained:
    """A model from all labelled texts of ``labels`` (doc_id, toxic)."""
    common.worker_imports(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    mark = F.xxhash64(F.lit("calibration"), "l_id")
    known = common.written(known.withColumn("mark", mark), "labels")
    few = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    apart = known.where(F.pmod("mark", F.lit(5)) == 0).orderBy("mark", "l_id").limit(max_calibration)
    apart = common.written(apart.select("l_id", F.lit(True).alias("apart")), "calibration")  # at most max_calibration rows
    marked = known.join(F.broadcast(apart), "l_id", "left").select("l_id", "toxic", "mark", F.coalesce("apart", F.lit(False)).alias("apart"))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    rows = lambda side: texts.join(F.broadcast(side) if few else side, F.col("id") == F.col("l_id"))

    counts = common.written(counted(rows(marked.where(~F.col("apart"))).select(F.col("toxic").cast("bigint"), "text")), "counts")
    model = Trained(differences(counts))
    common.release(counts)

    def sample(side: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        few_rows = texts.join(F.broadcast(side.select("l_id", "toxic")), F.col("id") == F.col("l_id")).orderBy(F.xxhash64("id", "text"), "id", "text").limit(max_calibration)
        got = mapped(few_rows.select("toxic", "text"), model, "text", "x", "array<double>").select("toxic", "x").toArrow()
        x, y = np.array(got["x"].to_pylist(), dtype=float).reshape(got.num_rows, FEATURES), got["toxic"].to_numpy().astype(float)
        order = np.lexsort(np.column_stack([x, y]).T) if len(y) else slice(None)
        return x[order], y[order]

    x, y = sample(marked.where("apart"))
    if len(y) == 0 or y.min() == y.max():
        x, y = sample(marked.orderBy("mark", "l_id").limit(max_calibration))
    if len(y) == 0 or y.min() == y.max():
        model.fit = np.append(np.zeros(FEATURES), 30.0 if len(y) and y[0] else -30.0)
    else:
        model.fit = logistic(x, y)
    return model


def scored(df: DataFrame, model: Trained, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each text; it replaces a column of that name."""
    return mapped(df.drop(out), model, text, out, "double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels.where(fold("doc_id") != 0))
    out = scored(docs, model)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
