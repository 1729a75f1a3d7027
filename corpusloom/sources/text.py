"""Text files, plain or compressed, one line per sentence or article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.scratch import drop_before_last, drop_since, materialize, run_once, spread, tables_written

# One row per file split (about 128 MB of text each) is broadcast up to this many bytes.
BROADCAST_BYTES = 256_000_000
# Text of a written file, about.
FILE_BYTES = 128_000_000

# Titles of a German example corpus.
EXAMPLE_TITLES_DE = [
    "Österreich", "Wien", "Deutschland", "Berlin", "Frankreich", "Paris", "Spanien", "Madrid",
    "Vereinigtes Königreich", "London", "Finnland", "Helsinki",
]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines ``(src, line_no, doc_id, text)`` of files, directories or globs.

    ``line_no`` counts within a file and ``doc_id`` through all files, both from
    0.  Files are in the order of their folders, then of the numbers of their
    parts, then of their names.  The codec follows the file extension.

    The files are read once, into a written table: the splits of a later read
    follow the cores that are alive then, so nothing is numbered by them.
    """
    scan = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("src"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("text"),
    )
    return number_lines(materialize(scan, "lines"))


def file_order() -> list[Column]:
    """Order of files ``src``: folder, number of the part (none for other names), name."""
    part = F.nullif(F.regexp_extract("src", "part-([0-9]+)[^/]*$", 1), F.lit(""))
    return [F.regexp_extract("src", "^(.*)/", 1), F.coalesce(part.cast("decimal(38,0)"), F.lit(-1)), F.col("src")]


def number_lines(rows: DataFrame) -> DataFrame:
    """Dense line numbers from ``(src, block, seq, text)``.

    ``seq`` rises without gaps inside a split ``(src, block)``; ``rows`` is a
    written table, as it is read twice.  Only one row per split is ordered globally.
    """
    splits = materialize(
        rows.groupBy("src", "block").agg(
            F.min("seq").alias("first_seq"), F.count("*").alias("n")
        ),
        "splits",
    )
    before = (Window.unboundedPreceding, -1)
    in_all = Window.orderBy(*file_order(), "block").rowsBetween(*before)
    in_file = Window.partitionBy("src").orderBy("block").rowsBetween(*before)
    offsets = splits.select(
        "src",
        "block",
        "first_seq",
        F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("line_offset"),
        F.coalesce(F.sum("n").over(in_all), F.lit(0)).alias("doc_offset"),
    )
    size = splits.agg(F.sum(F.octet_length("src") + 48)).head()[0] or 0
    if size <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    index = F.col("seq") - F.col("first_seq")
    return rows.join(offsets, ["src", "block"]).select(
        "src",
        (F.col("line_offset") + index).alias("line_no"),
        (F.col("doc_offset") + index).alias("doc_id"),
        "text",
    )


def document_lines(corpus: DataFrame) -> DataFrame:
    """Lines ``(doc_id, line_no, text)`` of a corpus."""
    return corpus.select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    ).withColumn("line_no", F.col("line_no").cast("long"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus ``(doc_id, text)`` of a Parquet table that carries its own ids."""
    return spread(spark.read.parquet(path).select("doc_id", "text"), "doc_id")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Title list, one per line."""
    return spark.read.text(path).select(F.col("value").alias("title"))


def union_corpora(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of several corpora of the same columns."""
    for other in others:
        first = first.unionByName(other)
    return first


def write_lines(df: DataFrame, path: str, order: list[str], batch: int | None = None,
                compression: str | None = None, files: int | None = None) -> None:
    """Write column ``text`` one line per row; files follow the ``order`` columns.

    A ``batch`` is appended below ``path``: batches are read back in the order of
    their numbers, after files written without one.  The number of files follows
    from the size of the text, but is at least ``files``, so no task writes much more than FILE_BYTES.
    """
    size = df.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    files = max(-(-size // FILE_BYTES), files or 1)
    target = path if batch is None else f"{path}/batch-{batch:012d}"
    ordered = df.repartitionByRange(files, *order).sortWithinPartitions(*order).select("text")
    with run_once(df.sparkSession):
        ordered.write.text(target, compression=compression)


def write_tokens(df: DataFrame, tokens: str, path: str, order: list[str], batch: int | None = None) -> None:
    """Write one article per line, its tokens joined by a space."""
    write_lines(df.withColumn("text", F.array_join(tokens, " ")), path, order, batch)


def write_phrase_lines(
    df: DataFrame, path: str, order: list[str], batch: int | None = None, made_from: int | None = None
) -> None:
    """Write phrase-joined lines; every unit is led by a space, as in the line format.

    The lines are computed once, into a table that is sized, sampled and written.  Tables written since there were
    ``made_from`` serve no other purpose than to compute them and are deleted then.
    """
    spark = df.sparkSession
    first = tables_written()
    lead = F.when(F.col("text") == "", F.col("text")).otherwise(F.concat(F.lit(" "), "text"))
    lines = materialize(df.withColumn("text", lead).select(*order, "text"), "phrase-lines")
    if made_from is not None:
        drop_before_last(spark, made_from)
        first = made_from
    write_lines(lines, path, order, batch)
    drop_since(spark, first)
