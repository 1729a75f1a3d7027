"""Token rows of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.text import document_lines


def token_rows(lines: DataFrame, tokens) -> DataFrame:
    """Rows ``(doc_id, line_no, pos, word)`` of lines, split by ``tokens(column)``."""
    exploded = lines.select(
        "doc_id", "line_no", F.posexplode(tokens(F.col("text"))).alias("pos", "word")
    )
    return exploded.withColumn("pos", F.col("pos").cast("long"))


def space_token_rows(corpus: DataFrame) -> DataFrame:
    """Tokens between single spaces; gaps give empty words."""
    return token_rows(document_lines(corpus), T.space_tokens)


def phrase_token_rows(corpus: DataFrame) -> DataFrame:
    """Rows ``(doc_id, line_no, pos, word)`` of the phrase tokenizer, lines without words left out.

    A lone line-break token ends a line as well.
    """
    tokens = corpus.select("doc_id", T.blank_tokens(F.col("text")).alias("tokens"))
    text = F.array_join("tokens", " ")
    lines = tokens.select("doc_id", text.alias("text"))
    rows = token_rows(document_lines(lines), T.space_tokens).where("word <> ''")
    # a line after a line end starts with the space that array_join put there
    lead = F.when(F.col("line_no") > 0, 1).otherwise(0)
    return rows.withColumn("pos", F.col("pos") - lead)


def truncate_tokens(corpus: DataFrame, max_bytes: int = 58) -> DataFrame:
    """Corpus whose phrase tokens are cut at ``max_bytes`` bytes of UTF-8."""
    tokens = F.transform(T.blank_tokens(F.col("text")), lambda t: T.truncate_bytes(t, max_bytes))
    return corpus.select("doc_id", F.array_join(tokens, " ").alias("text"))


def words(corpus: DataFrame) -> DataFrame:
    """One row ``(word)`` per space-separated token, for counting."""
    return corpus.select(F.explode(T.document_space_tokens(F.col("text"))).alias("word"))
