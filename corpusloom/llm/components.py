"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lookup, materialize


def _pointers(ends: DataFrame, nth: int) -> DataFrame:
    """``node, root``: what each node of ``ends`` (node, to; every link both ways) points at, itself or a neighbour.

    In round 0 that is the smallest, so a star around its smallest node is one
    round.  Later it is a node of many links, by powers of two, and among alike
    ones that of the least hash, which differs by round.
    """
    if nth == 0:
        return ends.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root"))
    degrees = materialize(ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "degrees")
    place = F.struct(
        (-F.floor(F.log2("n"))).alias("links"), F.xxhash64(F.lit(nth), F.col("to")).alias("hash"), F.col("to")
    )
    own = degrees.select("node", F.col("node").alias("to"), "n")
    near = ends.join(degrees.withColumnRenamed("node", "to"), "to").select("node", "to", "n")
    least = near.unionByName(own).select("node", place.alias("place")).groupBy("node").agg(F.min("place").alias("place"))
    return least.select("node", F.col("place.to").alias("root"))


def connected(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``links`` (a, b); a component is named by its smallest node.

    Each round points every node at itself or a neighbour, and replaces nodes by
    what they point at, until no link is left.  Of a chain about half of the
    nodes are left after a round, whatever their order, so rounds grow with the
    logarithm of its length.  Links and labels stay tables; a node with many
    links is an aggregate with partial minima and a join whose other side is
    unique.
    """
    spark = links.sparkSession
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = materialize(both, "links")
    labels = None
    nth = 0
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        to = materialize(_pointers(ends, nth), "pointers")
        moved = left.join(to.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(
            to.withColumnsRenamed({"node": "b", "root": "rb"}), "b"
        )
        fresh = moved.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
        if labels is None:
            labels = to.withColumnRenamed("root", "component")
        else:
            step = to.withColumnsRenamed({"node": "component", "root": "next"})
            labels = materialize(
                lookup(labels, step, ["component"], 16 * step.count()).select(
                    "node", F.coalesce("next", "component").alias("component")
                ),
                "components",
            )
        left = materialize(fresh.distinct(), "links")
        nth += 1
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    if nth == 1:
        return labels
    names = materialize(labels.groupBy("component").agg(F.min("node").alias("name")), "component-names")
    named = lookup(labels, names, ["component"], 16 * names.count())
    return materialize(named.select("node", F.col("name").alias("component")), "components")
