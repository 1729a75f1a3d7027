"""Inputs that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.scratch import spread
from corpusloom.sources.text import read_corpus

# Word pairs that sub-corpora are selected by.
PAIRS = [
    ("worthless", "for"),
    ("enonre", "thansh"),
    ("rely", "nttion"),
    ("quevi", "leçan"),
    ("ciónga", "del"),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_corpus(spark, f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return table.select(F.col("item_id").alias("doc_id"), "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents, numbered in conversation order."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return table.select((F.col("conv_id") * 2**32 + F.col("turn")).alias("doc_id"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as wiki pages ``(doc_id, title, text)``."""
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return spread(
        table.select(
            F.col("page_id").alias("doc_id"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.col("html").alias("text"),
        ),
        "doc_id",
    )


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a vector table; a word is the number of its vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(
        F.col("vec_id").cast("string").alias("word"),
        V.as_double(F.col("embedding")).alias("vector"),
    )


def analogy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair per label: its first vector and its last; the last label's is unknown."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ends = table.groupBy("label").agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))
    unknown = F.when(F.col("label") == 9, "oov").otherwise(F.col("high").cast("string"))
    return ends.select(
        F.col("label").cast("long").alias("pair_id"),
        F.col("low").cast("string").alias("word1"),
        unknown.alias("word2"),
    )


def rated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector paired with another one (or an unknown word) and a made-up rating.

    Ratings tie often, and pairs rated above 4 occur a second time with another
    rating.  The labels make up two data sets.
    """
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    size = table.count()
    base = table.select(
        F.when(F.col("label") < 3, "first").otherwise("second").alias("dataset"),
        F.col("vec_id").alias("line_no"),
        F.col("vec_id").cast("string").alias("word1"),
        ((F.col("vec_id") * 5 + 1) % (size + 20)).cast("string").alias("word2"),
        ((F.col("vec_id") * 13 % 37) / 4).alias("score"),
    )
    again = base.where("score > 4").withColumns(
        {"line_no": F.col("line_no") + 2**62, "score": F.col("score") + 1}
    )
    return base.unionByName(again)


def hashed_word_vectors(words: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for about half of the words, chosen by a hash of the word."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    size = table.count()
    code = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")
    coded = words.select("word", (code % (size * 2)).alias("vec_id"))
    return coded.join(table, "vec_id").select(
        "word", V.as_double(F.col("embedding")).alias("vector")
    )
