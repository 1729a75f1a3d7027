"""Rank correlation of human ratings with vector distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.lookup import known_pairs
from corpusloom.operators.ordering import group_prefix_sum
from corpusloom.scratch import materialize

PAIR = ["dataset", "word1", "word2"]


def rated_distances(rated: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rated pairs of known words with the cosine ``distance`` of their vectors."""
    distance = V.cosine_distance(F.col("vector1"), F.col("vector2"))
    return known_pairs(rated, vectors).select(
        *PAIR, "line_no", "score", distance.alias("distance")
    )


def rank_correlation(distances: DataFrame) -> DataFrame:
    """Spearman correlation ``(dataset, rho, coverage)`` of two orders of the pairs.

    One order is by falling score and the other by rising distance; ties keep
    the order of the file, and of the first order.  All copies of a pair take
    the earliest distance position among them, hence a shared average rank.
    The positions by score are a permutation, which fixes their variance, so
    the correlation follows from sums over distinct pairs and no copies of a
    pair are brought together beyond a partial aggregation.
    """
    distances = materialize(distances, "distances")
    sizes = distances.groupBy("dataset").count().agg(F.max("count"), F.sum("count")).head()
    limits = {"by": ["dataset"], "largest": sizes[0] or 0, "rows": sizes[1] or 0}
    one = F.lit(1).cast("long")
    scored = group_prefix_sum(
        distances, one, [F.col("score").desc(), F.col("line_no")], "pos1", **limits
    )
    placed = group_prefix_sum(
        scored, one, [F.col("distance"), F.col("pos1")], "pos2", **limits
    )
    distinct = placed.groupBy(*PAIR).agg(
        F.count("*").alias("copies"),
        F.sum(F.col("pos1") + 1).alias("rank1"),
        F.min("pos2").alias("pos2"),
    )
    ranked = group_prefix_sum(
        distinct, F.col("copies"), [F.col("pos2")], "before", **limits
    ).withColumn("rank2", F.col("before") + (F.col("copies") + 1) / 2)
    sums = ranked.groupBy("dataset").agg(
        F.sum("copies").alias("n"),
        F.sum(F.col("rank1") * F.col("rank2")).alias("s12"),
        F.sum(F.col("copies") * F.col("rank2") * F.col("rank2")).alias("s22"),
    )
    n = F.col("n").cast("double")
    middle = n * (n + 1) * (n + 1) / 4
    spread1 = n * (n * n - 1) / 12
    spread2 = F.col("s22") - middle
    rho = (F.col("s12") - middle) / F.nullif(F.sqrt(spread1 * spread2), F.lit(0.0))
    return sums.select("dataset", F.round(rho, 3).alias("rho"), F.col("n").alias("coverage"))


def similarity_scores(rated: DataFrame, vectors: DataFrame) -> DataFrame:
    """Correlation and coverage ``(dataset, rho, coverage)`` of rated pairs."""
    return rank_correlation(rated_distances(rated, vectors))
