"""Byte-level BPE encoding and decoding, and token counts.

The text is cut into pieces by the tokenizer's pattern, each piece's UTF-8 bytes become characters of the byte table, and
the BPE model of the tokenizers library merges them. A piece that was met before is taken from a bounded cache. Decoding
turns ids back into bytes by the reversed byte table; a character whose bytes are split over tokens is whole again once
the bytes are joined, and in offsets each such token covers that character.

Nulls count as empty texts (0 tokens); repeated rows are encoded each for itself; extra columns are kept where the
operator returns its input's columns. Output columns that would clash with input columns replace them. Texts are encoded
whole, one at a time, however long. An empty table gives an empty result, and an empty histogram.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import common

#: Pieces kept in a worker's cache; it starts again when full.
CACHE_PIECES = 300_000
#: Only pieces up to this many characters are kept, so that the cache's size is bounded.
CACHE_CHARS = 64

#: Texts of these characters only are cut by the re module, whose classes agree with the pattern's there; others by the
#: tokenizers library.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x7fÀ-ÖØ-öø-ſ]")

_loaded: dict[str, ByteBPE] = {}


def byte_table() -> dict[int, str]:
    """A printable character for each byte, as byte-level BPE vocabularies have them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes this one when only lower ranks merge before it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class _Pieces(dict):
    """For each piece its ids written with spaces and the bytes that they decode to."""

    def __init__(self, encoder: ByteBPE):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        ids = self.encoder.piece_ids(piece)
        got = (" ".join(map(str, ids)), self.encoder.decode_bytes(ids))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = got
        return got


class ByteBPE:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, models, pre_tokenizers

        ranks = read_ranks(path)
        table = byte_table()
        self.to_char = {b: c for b, c in table.items()}
        shown = lambda token: "".join(map(table.__getitem__, token))
        merges = [tuple(map(shown, merge_parts(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        self.model = models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        back = {c: b for b, c in table.items()}
        for token, rank in ranks.items():
            self.bytes_of[rank] = bytes(back[c] for c in shown(token))
        self.any_text = pre_tokenizers.Split(Regex(pattern), "isolated")
        letters, numbers = r"\p{L}", r"\p{N}"
        plain = pattern.replace(f"[^\\s{letters}{numbers}]", r"(?:[^\s\w]|_)").replace(letters, r"[^\W\d_]").replace(numbers, r"\d")
        self.plain_text = None if r"\p" in plain else re.compile(plain)
        self.known = _Pieces(self)

    def pieces(self, text: str) -> list[str]:
        if self.plain_text is None or _PLAIN.search(text):
            return [p for p, _ in self.any_text.pre_tokenize_str(text)]
        return self.plain_text.findall(text)

    def piece_ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.to_char))]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.piece_ids(p)]

    def count(self, text: str) -> int:
        written = " ".join([ids for ids, _ in map(self.known.__getitem__, self.pieces(text))])
        return written.count(" ") + 1 if written else 0

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids written with spaces, and of the bytes that the ids decode to."""
        got = list(map(self.known.__getitem__, self.pieces(text)))
        ids, back = zip(*got, strict=True) if got else ((), ())
        written = " ".join(ids)
        return written.count(" ") + 1 if written else 0, hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(b"".join(back)).hexdigest()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of any run of ids; bytes of characters cut at the run's ends become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Start and end character of each token; tokens that share a character all cover it."""
        char_at = [i for i, c in enumerate(text) for _ in range(len(c.encode()))]
        starts, ends, at = [], [], 0
        for i in ids:
            n = len(self.bytes_of[i])
            starts.append(char_at[at])
            ends.append(char_at[at + n - 1] + 1)
            at += n
        return starts, ends


def loaded(path: str, pattern: str) -> ByteBPE:
    """The encoder, made once in each worker."""
    key = f"{path}\n{pattern}"
    if key not in _loaded:
        _loaded[key] = ByteBPE(path, pattern)
    return _loaded[key]


def _mapped(df: DataFrame, text_col: str, new: list[tuple[str, pa.DataType, str]], rows, path: str, pattern: str) -> DataFrame:
    """Add columns that ``rows(encoder, text)`` gives for each text, one text in memory at a time beside its batch."""
    common.worker_imports(df.sparkSession)
    names = [n for n, _, _ in new]
    base = df.drop(*[c for c in df.columns if c in names and c != text_col])
    fields = [f for f in base.schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{n}` {t}" for n, _, t in new])
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path, pattern)
        for batch in batches:
            texts = batch.column(at)
            got = [rows(encoder, texts[i].as_py() or "") for i in range(batch.num_rows)]
            columns = [pa.array([g[k] for g in got], type=t) for k, (_, t, _) in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return base.mapInArrow(run, schema)


def _files(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers as public

    return path or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """Add ``ids`` (array of int) and, if asked for, ``starts`` and ``ends`` (character offsets) to each row."""
    path, pattern = _files(path, pattern)
    ints, kind = pa.list_(pa.int32()), "array<int>"

    def rows(encoder: ByteBPE, text: str):
        ids = encoder.encode(text)
        return (ids, *encoder.offsets(text, ids)) if offsets else (ids,)

    return _mapped(df, text_col, [(n, ints, kind) for n in (("ids", "starts", "ends") if offsets else ("ids",))], rows, path, pattern)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``decoded``, the text of each row's ids; null ids give an empty text."""
    path, pattern = _files(path, pattern)
    return _mapped(df, ids_col, [("decoded", pa.string(), "string")], lambda e, ids: (e.decode(ids or []),), path, pattern)


def digests(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode each text, adding ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The ids stay in the worker, so that a corpus' ids are never moved only to be hashed.
    """
    path, pattern = _files(path, pattern)
    new = [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _mapped(df, text_col, new, lambda e, text: e.digest(text), path, pattern)


def token_lengths(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``n_tokens``, the encoded length of each text."""
    path, pattern = _files(path, pattern)
    return _mapped(df, text_col, [("n_tokens", pa.int64(), "bigint")], lambda e, text: (e.count(text),), path, pattern)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens", by: Column | None = None) -> DataFrame:
    """Exact histogram of lengths with running and suffix sums, for each scope of ``by`` and over all rows (scope null).

    For a context limit of ``length`` tokens a row says how many documents fit whole (``n_up_to``), how many would be cut
    (``n_above``), and what a truncation to the limit keeps in all (``truncated_tokens``); ``quantile`` is the share of
    documents up to that length. Any limit between two rows follows from the lower row: truncated_tokens + n_above *
    (limit - length). A scope has one row for each distinct length, so windows hold at most as many rows as the longest
    text has tokens, however many documents there are.
    """
    scoped = lengths.select(F.col(length_col).cast("bigint").alias("length"), (by if by is not None else F.lit(None)).cast("string").alias("scope"))
    each = scoped.groupBy("scope", "length").agg(F.count(F.lit(1)).alias("n_docs"))
    if by is not None:
        each = each.withColumn("whole", F.lit(False))
        each = each.unionByName(each.groupBy("length").agg(F.sum("n_docs").alias("n_docs")).select(F.lit(None).cast("string").alias("scope"), "length", "n_docs", F.lit(True).alias("whole")))
    else:
        each = each.withColumn("whole", F.lit(True))
    w = W.partitionBy("whole", "scope").orderBy("length").rowsBetween(W.unboundedPreceding, W.currentRow)
    all_rows = W.partitionBy("whole", "scope")
    out = each.select(
        "whole", "scope", "length", "n_docs",
        F.sum("n_docs").over(w).alias("n_up_to"),
        F.sum("n_docs").over(all_rows).alias("n_all"),
        F.sum(F.col("n_docs") * F.col("length")).over(w).alias("tokens_up_to"),
        F.sum(F.col("n_docs") * F.col("length")).over(all_rows).alias("total_tokens"),
    )
    return out.select(
        "whole", "scope", "length", "n_docs", "n_up_to",
        (F.col("n_all") - F.col("n_up_to")).alias("n_above"),
        "tokens_up_to", "total_tokens",
        (F.col("tokens_up_to") + (F.col("n_all") - F.col("n_up_to")) * F.col("length")).alias("truncated_tokens"),
        (F.col("n_up_to") / F.col("n_all")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Truncated totals, documents above and quantiles of the whole corpus for the given context limits."""
    spark = histogram.sparkSession
    rows = histogram.where("whole")
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit bigint")
    joined = rows.join(F.broadcast(asked), F.col("length") <= F.col("context_limit"))
    last = joined.groupBy("context_limit").agg(F.max_by(F.struct("length", "n_above", "truncated_tokens", "quantile"), "length").alias("r"))
    total = rows.agg(F.sum("n_docs").alias("n"))
    return asked.join(last, "context_limit", "left").crossJoin(total).select(
        "context_limit",
        F.coalesce(F.col("r.truncated_tokens") + F.col("r.n_above") * (F.col("context_limit") - F.col("r.length")), F.col("context_limit") * F.col("n"), F.lit(0)).alias("truncated_tokens"),
        F.coalesce(F.col("r.n_above"), F.col("n"), F.lit(0)).alias("n_above"),
        F.coalesce(F.col("r.quantile"), F.lit(0.0)).alias("quantile"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return digests(docs).drop("text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("source", "text")
    return length_histogram(token_lengths(docs).drop("text"), by=F.col("source"))
