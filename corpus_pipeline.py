"""From raw documents to token ids: quality, near copies, benchmark passages, secrets, byte-level BPE.

Each stage reads what the one before kept, from a table of its own, and all but the last return the columns of
documents. SQL can't express the stages (a language of finite automata, a fitted forest, component search), so
there is no ORACLE_SQL; tests/llm compares near copies and decontamination with brute-force versions, and run() with
the stages taken one by one.

In all stages a null text counts as empty (so quality rules reject it), rows are judged by their own texts where ids
are null or repeated, an empty table gives an empty one, texts of any length are whole, and further columns pass
through, whatever their names (the last stage leaves out text and own columns of its results' names).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import bpe_transducer, jaccard_join, positional_index, quality_rules, secret_scan
from lexispark.llm.common import read, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of their 5-word shingles."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    return positional_index.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secret_scan.mask_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents."""
    return bpe_transducer.tokenized(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("decontamination", decontaminate), ("secrets", mask_secrets), ("token ids", tokenize)]

#: The stages are beyond SQL; see the module's text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
