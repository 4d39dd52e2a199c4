"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and is written as Parquet in the shared folder and read again, so a lost
executor costs one stage's work at most. All stages but the last return the
columns of documents; the last returns the pieces of the packed sequences.

Defined cases, stage by stage: null and empty texts have no words and fail the base
rules; where a stage is given them by itself, line dedup and PII pass them
unchanged, the n-gram join keeps each, and packing gives a null or empty text its
closing id. Of equal lines or documents, and in ties, that of the smaller doc_id
stays; rows that repeat a doc_id with the same text are one document after the
n-gram join; a null doc_id comes first in line dedup and stays in the join. Null
lang and source form groups of their own. Extra columns pass through all stages but
the last. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bytespan.llm import linededup, ngramjoin, packing, rules, surrogates
from bytespan.llm.common import saved
from bytespan.llm.queries import SURROGATE_KEY, WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds."""
    return rules.keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are similar to an earlier one."""
    return linededup.dedup_lines(docs, k=1)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of 5-word shingles; texts without words stay."""
    return ngramjoin.keep_one(docs, k=5, num=80, den=100)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every detected entity replaced."""
    return surrogates.replace_pii(docs, SURROGATE_KEY)


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("pii_surrogates", pii_surrogates),
    ("retrieval_packing", retrieval_packing),
]

#: Sketches, surrogates and packing are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
