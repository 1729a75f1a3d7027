"""Two-dimensional map of the words of analogy pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.lookup import dimension, fill_zero, pair_vectors
from corpusloom.scratch import materialize


def project(rows: DataFrame) -> DataFrame:
    """Add ``x`` and ``y``: the two main components of the centred ``vector`` column.

    Each component points the way that makes its largest loading positive.
    """
    centred = (
        StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred")
        .fit(rows := rows.withColumn("raw", array_to_vector("vector")))
        .transform(rows)
    )
    model = PCA(k=2, inputCol="centred", outputCol="main").fit(centred)
    loadings = model.pc.toArray()
    flips = [1.0 if max(column, key=abs) >= 0 else -1.0 for column in loadings.T]
    main = vector_to_array("main")
    xy = {name: main[i] * flips[i] for i, name in enumerate(("x", "y"))}
    return model.transform(centred).withColumns(xy).drop("raw", "centred", "main")


def pair_map(pairs: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points ``(pair_id, side, word, x, y)`` and one segment per pair.

    Words that occur in several pairs count once per occurrence; unknown words
    are zero vectors.
    """
    filled = fill_zero(pair_vectors(pairs, vectors), dimension(vectors))
    sides = [
        filled.select(
            "pair_id",
            F.lit(side).cast("long").alias("side"),
            F.col(f"word{side}").alias("word"),
            F.col(f"vector{side}").alias("vector"),
        )
        for side in (1, 2)
    ]
    rows = materialize(reduce(DataFrame.unionByName, sides), "points")
    points = project(rows).drop("vector")
    return points, segments(points)


def segments(points: DataFrame) -> DataFrame:
    """Segments ``(pair_id, word1, x1, y1, word2, x2, y2)`` between the points of a pair."""
    ends = [
        points.where(F.col("side") == side).select(
            "pair_id", *(F.col(c).alias(f"{c}{side}") for c in ("word", "x", "y"))
        )
        for side in (1, 2)
    ]
    return ends[0].join(ends[1], "pair_id")


def write_map(points: DataFrame, lines: DataFrame, path: str) -> None:
    """Write both tables of a map as Parquet below ``path``."""
    points.write.parquet(f"{path}/points")
    lines.write.parquet(f"{path}/segments")
