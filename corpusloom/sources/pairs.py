"""Word pairs for analogies and word pairs rated by people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.rows import small_table

# Country and capital pairs; the first pair is the base analogy.
COUNTRY_CAPITALS = {
    "en": [
        ("china", "beijing"),
        ("russia", "moscow"),
        ("japan", "tokyo"),
        ("turkey", "ankara"),
        ("poland", "warsaw"),
        ("germany", "berlin"),
        ("france", "paris"),
        ("italy", "rome"),
        ("greece", "athens"),
        ("spain", "madrid"),
        ("portugal", "lisbon"),
    ],
    "de": [
        ("china", "peking"),
        ("russland", "moskau"),
        ("japan", "tokio"),
        ("türkei", "ankara"),
        ("polen", "warschau"),
        ("deutschland", "berlin"),
        ("frankreich", "paris"),
        ("italien", "rom"),
        ("griechenland", "athen"),
        ("spanien", "madrid"),
        ("portugal", "lissabon"),
    ],
    "de-example": [
        ("österreich", "wien"),
        ("deutschland", "berlin"),
        ("frankreich", "paris"),
        ("spanien", "madrid"),
        ("großbritannien", "london"),
        ("finnland", "helsinki"),
    ],
}


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Analogy pairs ``(pair_id, word1, word2)`` of one headerless comma-separated file.

    Words are lower-cased; ``pair_id`` rises in file order, and the lowest is
    the base pair.
    """
    rows = spark.read.schema("word1 string, word2 string").csv(path, header=False)
    return rows.select(
        F.monotonically_increasing_id().alias("pair_id"),
        F.lower("word1").alias("word1"),
        F.lower("word2").alias("word2"),
    )


def read_rated_pairs(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Rated pairs ``(dataset, line_no, word1, word2, score)`` of one tab-separated file with header.

    Words are lower-cased; ``line_no`` rises in file order.
    """
    rows = (
        spark.read.schema("word1 string, word2 string, score double")
        .option("sep", "\t")
        .option("mode", "FAILFAST")
        .csv(path, header=True)
    )
    return rows.select(
        F.lit(dataset).alias("dataset"),
        F.monotonically_increasing_id().alias("line_no"),
        F.lower("word1").alias("word1"),
        F.lower("word2").alias("word2"),
        "score",
    )


def pairs_from_list(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Analogy pairs given as a list."""
    return small_table(
        spark,
        pair_id=list(range(len(pairs))),
        word1=[a.lower() for a, _ in pairs],
        word2=[b.lower() for _, b in pairs],
    )
