"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.skew import hot_rows, lookup_join
from corpusloom.scratch import materialize

# A table is broadcast only while its measured content is below this many bytes.
BROADCAST_BYTES = 8_000_000
# Arrow batches for tasks' Python code are of about this many bytes, unless the session asks for smaller ones: both sides
# hold several copies of a batch outside the heap.
ARROW_BYTES = 4_000_000
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
# A-Z become a-z, every other byte outside words becomes a space; bytes from 0x80 on belong to words.
_WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or b in _KEPT else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text with A-Z lower-cased; null has none."""
    return text.translate(_WORD_TABLE).split() if text else []


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches to ARROW_BYTES."""
    number, unit = re.fullmatch("([0-9]+)([a-z]*)", spark.conf.get(_ARROW_SETTING).strip().lower()).groups()
    if int(number) * 1024 ** "bkmgtp".index((unit or "b")[0]) > ARROW_BYTES:
        spark.conf.set(_ARROW_SETTING, f"{ARROW_BYTES}b")


def map_stream(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """`mapInArrow` by workers that give memory back after each task, as later tasks use them too.

    Batches of the session are bounded by ARROW_BYTES from here on.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``function`` to every Arrow batch; nothing larger than a batch is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return map_stream(df, run, schema)


def binary(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def each_text(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, few of them held at a time."""
    for at in range(0, len(column), 256):
        yield from binary(column.slice(at, 256))


def text_parts(column: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, list[bytes | None]]]:
    """Texts of a string column in lists of about ``size`` bytes, with the number of their first row."""
    at, held, total = 0, [], 0
    for i, text in enumerate(each_text(column)):
        held.append(text)
        total += len(text or b"")
        if total >= size:
            yield at, held
            at, held, total = i + 1, [], 0
    if held:
        yield at, held


def row_keys(*columns: str) -> list[Column]:
    """Two 64-bit keys of a row's content: rows with equal content share them, others do not."""
    return [
        F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]).alias(
            f"row_key{seed}"
        )
        for seed in (1, 2)
    ]


def bytes_of(df: DataFrame, *strings: str) -> tuple[int, int]:
    """Rows of ``df`` and bytes of its string columns ``strings``."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(16))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def lookup(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    size: int,
    how: str = "left",
    limit: int = BROADCAST_BYTES,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join with a table, unique on ``on``, whose content was measured as ``size`` bytes.

    Up to ``limit`` bytes it is broadcast.  Beyond that only its rows of hot
    keys are, of which there are less than `skew.HOT_SHARE`; the rest, without
    hot keys, is shuffled.  ``hot`` names the hot keys where they are known;
    else the keys of ``large`` are counted.
    """
    if size <= limit:
        return large.join(F.broadcast(small), on, how)
    if hot is None:
        counts = materialize(large.groupBy(*on).count(), "key-counts")
        hot = hot_rows(counts, "count", counts.agg(F.sum("count")).first()[0] or 0)
    if hot.isEmpty():
        return large.join(small, on, how)
    return lookup_join(large, small, on, hot, how, table_rows=1, broadcast_rows=0)


def join_rows(rows: DataFrame, small: DataFrame, on: list[str], size: int, how: str, limit: int) -> DataFrame:
    """`lookup` for documents, whose keys repeat only in repeated rows: what is shuffled needs no count before."""
    return rows.join(F.broadcast(small) if size <= limit else small, on, how)
