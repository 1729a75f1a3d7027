"""Training-data pipeline: documents of quality, one of each group of near copies, without benchmark passages and
secrets, packed into sequences.

Each stage reads what its predecessor kept.  All but the last return the
columns of the documents they are given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import materialize, table
from corpusloom.llm.decontamination import keep_clean
from corpusloom.llm.jaccard import Rule, keep_first
from corpusloom.llm.packing import pack
from corpusloom.llm.quality import fit_quality, keep_good
from corpusloom.llm.secrets import forest_by_form, mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality, learned from the labels that are not held out, is at least 0.3."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of its 5-word shingles."""
    return keep_first(docs, Rule(n=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which less than one in 20 words is of a benchmark passage."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return mask_secrets(docs, forest_by_form(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packing),
]

# Learned models and tokenisers are beyond SQL; tests compare the stages with plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, from the documents on; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
