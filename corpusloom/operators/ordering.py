"""Order-dependent operators over a whole table, without an unpartitioned window.

The rows are cut into contiguous slices of the total order by a range
partitioning.  A window then runs inside each slice, and a table with one row
per slice carries values across the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.scratch import materialize

# Rows one task sorts for a plain window; larger groups are cut into slices.
WINDOW_ROWS = 1_000_000
# Rows of a slice, about, where the number of rows is known.
SLICE_ROWS = 200_000


# One row per split is broadcast up to this many of them.
BROADCAST_SPLITS = 1_000_000


def slices_for(rows: int) -> int:
    """Number of slices for a table of ``rows`` rows."""
    return max(1, -(-rows // SLICE_ROWS))


def range_slices(df: DataFrame, order: list[Column], slices: int | None = None) -> DataFrame:
    """Add ``slice``: the number of the contiguous part of the total order a row is in.

    ``order`` must identify a row.  The result is a written table, so the slice
    numbers stay the same however often it is read.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id())
    return materialize(cut, "slices")


def previous_value(
    df: DataFrame, value: str, order: list[str], out: str, slices: int | None = None
) -> DataFrame:
    """Value of the row before, in the total order of the table; null on the first row.

    ``value`` must not be null.
    """
    cut = range_slices(df, [F.col(c) for c in order], slices)
    inside = Window.partitionBy("slice").orderBy(*order)
    tails = cut.groupBy("slice").agg(F.max_by(value, F.struct(*order)).alias("tail"))
    carried = tails.select(
        "slice", F.lag("tail").over(Window.orderBy("slice")).alias("carried")
    )
    # one row per slice, hence never larger than the number of partitions
    return (
        cut.withColumn("inside", F.lag(value).over(inside))
        .join(F.broadcast(carried), "slice")
        .withColumn(out, F.coalesce("inside", "carried"))
        .drop("slice", "inside", "carried")
    )


def prefix_sum(
    df: DataFrame,
    weight: Column,
    order: list[Column],
    out: str,
    by: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Sum of ``weight`` over the rows before this one, within the groups ``by``.

    With a weight of 1 this is the zero-based position of the row.
    """
    by = by or []
    cut = range_slices(
        df.withColumn("weight", weight), [*(F.col(c) for c in by), *order], slices
    )
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("slice", *by).orderBy(*order).rowsBetween(*before)
    across = Window.partitionBy(*by).orderBy("slice").rowsBetween(*before)
    parts = cut.groupBy("slice", *by).agg(F.sum("weight").alias("part"))
    offsets = parts.select(
        "slice", *by, F.coalesce(F.sum("part").over(across), F.lit(0)).alias("offset")
    )
    return (
        cut.withColumn("inside", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
        .join(offsets, ["slice", *by])
        .withColumn(out, F.col("inside") + F.col("offset"))
        .drop("slice", "inside", "offset", "weight")
    )


def group_prefix_sum(
    df: DataFrame,
    weight: Column,
    order: list[Column],
    out: str,
    by: list[str],
    largest: int,
    rows: int,
) -> DataFrame:
    """`prefix_sum` of ``rows`` rows, by a plain window where the largest group fits one task."""
    if largest > WINDOW_ROWS:
        return prefix_sum(df, weight, order, out, by, slices_for(rows))
    window = (
        Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumn(out, F.coalesce(F.sum(weight).over(window), F.lit(0)))


def dense_ids(df: DataFrame, order: list[str], out: str, slices: int) -> DataFrame:
    """Rows numbered 0, 1, ... as ``out`` in the order of the columns ``order``, as a written table.

    Every split is sorted where it lies and written once; an id is the number
    of rows in the splits before, plus the place in the own one.  That holds if the
    splits, of which there is one row each, do not overlap, as in a table that was
    written in order.  Only where they do, the rows are dealt by ranges into
    ``slices`` parts first.  Rows that are equal in ``order`` are numbered in any order.
    """

    def written(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        sorted_rows = rows.sortWithinPartitions(*order)
        table = materialize(
            sorted_rows.withColumns({"split": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}),
            "ordered-splits",
        )
        key = F.struct(*order)
        splits = table.groupBy("split").agg(
            F.min(key).alias("low"), F.max(key).alias("high"), F.min("seq").alias("first_seq"), F.count("*").alias("n")
        )
        return table, materialize(splits, "splits")

    table, splits = written(df)
    following = Window.orderBy("low", "high")
    meets = splits.select((F.lag("high").over(following) > F.col("low")).alias("meets"))
    if not meets.where("meets").isEmpty():
        table, splits = written(table.drop("split", "seq").repartitionByRange(slices, *order))
    before = following.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_seq")
    offsets = splits.select("split", offset.alias("offset"))
    if splits.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    numbered = table.join(offsets, "split").withColumn(out, F.col("offset") + F.col("seq"))
    return numbered.select(out, *df.columns)
