"""From raw documents to encoded training text in five stages, each over all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame that is stored as Parquet and read again as the next one's
``docs``. When a stage begins, what the ones before it wrote between their passes is deleted, as their results are stored;
tables that anything else has written stay.

Null, empty and very long texts, repeated rows and ids, ties and extra columns have the results that each stage's operator
states; a text without words fails the quality rules, so later stages see none in a run. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import byte_bpe, common, line_dedup, minhash, mixing, quality


_between: set[str] = set()


def stage(work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stages before it wrote between their passes."""

    @functools.wraps(work)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release_paths(_between)
        _between.clear()
        before = common.paths()
        out = work(docs)
        _between.update(common.paths() - before)
        return out

    return begin


@stage
def quality_rules(docs: DataFrame) -> DataFrame:
    """Documents that pass the base rule and their group's thresholds."""
    return quality.keep_good(docs)


@stage
def line_runs(docs: DataFrame) -> DataFrame:
    """Documents without runs of lines that occur before; those that consist of such runs only go."""
    return line_dedup.keep_new(docs)


@stage
def near_duplicates(docs: DataFrame) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    return minhash.keep_first(docs)


@stage
def source_mix(docs: DataFrame) -> DataFrame:
    """The words that the mix takes, a row for each time over that a document gives some."""
    return mixing.mixed_documents(docs)


@stage
def encoding(docs: DataFrame) -> DataFrame:
    """Number of tokens, and digests of the ids and of the text that they decode to."""
    return byte_bpe.digests(docs).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_runs),
    ("minhash_dedup", near_duplicates),
    ("source_mixing", source_mix),
    ("byte_bpe", encoding),
]

#: SQL has no byte-level BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's result is computed from the stored result of the one before."""
    docs = common.documents(spark, sf_dir)
    base = f"{common.shared_dir(spark)}/quarry-pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (_, work) in enumerate(STAGES):
        out = work(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/{k}"
        out.write.parquet(path)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    raise ValueError("STAGES is empty")
