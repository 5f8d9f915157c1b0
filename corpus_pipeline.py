"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, suffix-array dedup, best-fit packing, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracegrid.llm import lines, neardup, packing, suffixes, toxicity
from tracegrid.session import discard, materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below 0.3."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the runs of lines that an earlier document has."""
    return lines.dedup_lines(docs).drop("n_removed_lines")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a Jaccard similarity of 0.8 of five-word shingles."""
    return neardup.keep_one(docs, width=5, threshold_percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of over 50 words, or of 400 bytes, that occur more than once."""
    return suffixes.dedup_text(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("suffix_dedup", drop_repeated_passages), ("packing", pack),
]

#: SQL cannot express the classifier, the tokenizer or the passages; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        spent, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if k:
            discard(spent)
    return STAGES[-1][1](spark, docs, sf_dir)
