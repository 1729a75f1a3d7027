"""Vocabulary counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_counts(words: DataFrame, min_count: int = 5) -> DataFrame:
    """Vocabulary ``(word, cn)`` of the words that occur ``min_count`` times or more."""
    counted = words.groupBy("word").agg(F.count("*").alias("cn"))
    return counted.where(F.col("cn") >= min_count)


def vocabulary_metrics(vocab: DataFrame) -> DataFrame:
    """One row: number of words and number of the tokens they cover."""
    return vocab.agg(
        F.count("*").alias("vocab_size"),
        F.coalesce(F.sum("cn"), F.lit(0)).alias("words_in_corpus"),
    )


def top_words(vocab: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most frequent words; ties in word order."""
    return by_count(vocab).limit(n)


def by_count(vocab: DataFrame) -> DataFrame:
    """Vocabulary sorted by falling count; ties in word order."""
    return vocab.orderBy(F.col("cn").desc(), "word")
