"""Vectors of words and documents.

A vector table is ``(word string, vector array<double>)``, unique on ``word``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.skew import HOT_SHARE, lookup_join, most_frequent

# Vector components that are broadcast at most (128 MB of doubles).
BROADCAST_VALUES = 16_000_000


def dimension(vectors: DataFrame) -> int:
    """Length of the vectors."""
    row = vectors.select(F.size("vector")).head()
    if row is None:
        raise ValueError("the vector table is empty")
    return row[0]


def pair_words(pairs: DataFrame) -> DataFrame:
    """Distinct words ``(word)`` of either side of the pairs."""
    side1 = pairs.select(F.col("word1").alias("word"))
    return side1.union(pairs.select(F.col("word2").alias("word"))).distinct()


def known_vectors(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Non-zero vectors of the words.

    The word list is the small side, so the vector table is not shuffled while
    the list stays below the broadcast threshold.
    """
    hits = vectors.join(words.select("word"), "word", "left_semi")
    return hits.where(V.is_nonzero(F.col("vector")))


def pair_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with columns ``vector1`` and ``vector2``; null for an unknown word."""
    known = known_vectors(pair_words(pairs), vectors)
    for side in ("1", "2"):
        side_vectors = known.select(
            F.col("word").alias(f"word{side}"), F.col("vector").alias(f"vector{side}")
        )
        pairs = pairs.join(side_vectors, f"word{side}", "left")
    return pairs


def fill_zero(pairs: DataFrame, dim: int) -> DataFrame:
    """Zero vectors in place of the null ones of `pair_vectors`."""
    return pairs.withColumns(
        {c: F.coalesce(F.col(c), V.zeros(dim)) for c in ("vector1", "vector2")}
    )


def known_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs of which both words have a vector."""
    both = F.col("vector1").isNotNull() & F.col("vector2").isNotNull()
    return pair_vectors(pairs, vectors).where(both)


def mean_vectors(
    tokens: DataFrame,
    counts: DataFrame,
    vectors: DataFrame,
    key: str = "doc_id",
    broadcast_values: int = BROADCAST_VALUES,
) -> DataFrame:
    """Mean word vector ``(key, n_tokens, vector)`` of the documents.

    ``tokens`` has one row ``(key, word)`` per token, together for each
    document, and ``counts`` the number ``cn`` of every word.  Unknown words
    count as zero vectors.

    Tokens that meet a broadcast vector stay where they are, so their sums
    combine before the shuffle.  Of a vector table too large to broadcast, the
    vectors of as many of the most frequent words are, and only tokens of the others are shuffled.
    """
    dim = dimension(vectors)
    rows = max(1, broadcast_values // dim)
    # fewer than HOT_SHARE words are hot
    frequent = most_frequent(counts, "cn", max(rows, HOT_SHARE))
    joined = lookup_join(
        tokens.select(key, "word"), vectors, ["word"], frequent, "left", broadcast_rows=rows
    )
    parts = [F.expr(f"sum(double(vector[{i}])) AS s{i}") for i in range(dim)]
    summed = joined.groupBy(key).agg(F.count("*").alias("n_tokens"), *parts)
    means = [F.expr(f"coalesce(s{i} / n_tokens, 0.0D)") for i in range(dim)]
    return summed.select(key, "n_tokens", F.array(*means).alias("vector"))
