"""Joins of a large table, whose keys may be very uneven, with a table unique on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A table of at most this many narrow rows is broadcast.
BROADCAST_ROWS = 2_000_000
# A key is hot if it holds more than 1/HOT_SHARE of all rows, so fewer than
# HOT_SHARE keys can be hot.
HOT_SHARE = 1024
# Parts that the rows of a hot key are spread over.
SALTS = 64


def hot_rows(table: DataFrame, count: str, total: int) -> DataFrame:
    """Rows of a per-key count table whose key holds more than 1/HOT_SHARE of ``total``."""
    return table.where(F.col(count) * HOT_SHARE > total)


def most_frequent(table: DataFrame, count: str, rows: int) -> DataFrame:
    """Rows of a per-key count table with the highest counts, at most ``rows`` of them; equal counts stay together."""
    sizes = table.groupBy(count).agg(F.count("*").alias("n"))
    # one row per different count, of which there are few
    reached = sizes.withColumn("reached", F.sum("n").over(Window.orderBy(F.col(count).desc())))
    least = reached.where(F.col("reached") <= rows).agg(F.min(count)).head()[0]
    return table.where(F.lit(False) if least is None else F.col(count) >= least)


def salted_join(
    large: DataFrame, table: DataFrame, on: list[str], hot: DataFrame, salts: int = SALTS
) -> DataFrame:
    """Inner join of ``large`` with ``table`` (unique on ``on``) in one shuffle.

    Rows of the keys in ``hot``, a table of a bounded number of rows, are
    spread over ``salts`` copies of the key's row.
    """
    keys = F.broadcast(hot.select(*on, F.lit(True).alias("is_hot")))
    salt = F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int")
    spread = large.join(keys, on, "left").select(
        *large.columns, F.when(F.col("is_hot"), salt).otherwise(0).alias("salt")
    )
    every = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    copies = table.join(keys, on, "left").select(*table.columns, F.explode(every).alias("salt"))
    return spread.join(copies, [*on, "salt"]).drop("salt")


def lookup_join(
    large: DataFrame,
    table: DataFrame,
    on: list[str],
    hot: DataFrame,
    how: str = "inner",
    table_rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``large`` with ``table`` (unique on ``on``) without a skewed shuffle.

    A small table is broadcast.  Beyond that, the keys in ``hot``, a table of a
    bounded number of rows (such as `hot_rows`), are joined by broadcast and
    only the even rest is shuffled.  ``how`` is ``inner`` or ``left``.
    """
    rows = table.count() if table_rows is None else table_rows
    if rows <= broadcast_rows:
        return large.join(F.broadcast(table), on, how)
    keys = F.broadcast(hot.select(*on))
    hot_table = F.broadcast(table.join(keys, on, "left_semi"))
    of_hot = large.join(keys, on, "left_semi").join(hot_table, on, how)
    of_rest = large.join(keys, on, "left_anti").join(
        table.join(keys, on, "left_anti"), on, how
    )
    return of_hot.unionByName(of_rest)
