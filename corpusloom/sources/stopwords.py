"""Stop-word lists: built in by language, from files, and their union."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.rows import small_table

# ISO codes of the languages that have a built-in list.
LANGUAGE_NAMES = {
    "da": "danish",
    "de": "german",
    "en": "english",
    "es": "spanish",
    "fi": "finnish",
    "fr": "french",
    "hu": "hungarian",
    "it": "italian",
    "nl": "dutch",
    "no": "norwegian",
    "pt": "portuguese",
    "ru": "russian",
    "sv": "swedish",
    "tr": "turkish",
}

# Extra stop words of a large English news and web corpus
# (the empty word stands for the gap between two spaces).
NEWS_STOPWORDS = [
    ",", ".", "", "-", "'", ")", "(", '"', "also", "–", "one", "said",
    "first", "may", "two", "made", "?", "rd", "many", "#", "use", "like",
    "used", "three", "has_been", "%", "u", "see", "since", "m", "make",
    "even", "however", "us", "d", "based",
]

# Extra stop words of a German encyclopedia corpus.
ENCYCLOPEDIA_STOPWORDS_DE = [
    "kategorie", "wurde", "the", "de", "of", "wurden", "weblinks", "dass", "seit", "ab",
]


def language_stopwords(language: str) -> list[str]:
    """Built-in list of a language, by its full English name or its ISO code."""
    return list(StopWordsRemover.loadDefaultStopWords(LANGUAGE_NAMES.get(language, language)))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """Stop-word file ``(word)``, one per line; an empty line is the empty word."""
    return spark.read.text(path).select(F.col("value").alias("word"))


def stopword_table(spark: SparkSession, *lists: list[str] | DataFrame) -> DataFrame:
    """Distinct words of several lists."""
    frames = [
        part
        if isinstance(part, DataFrame)
        else small_table(spark, word=list(part))
        for part in lists
    ]
    table = frames[0]
    for frame in frames[1:]:
        table = table.union(frame)
    return table.distinct()


def union_lists(*lists: list[str]) -> list[str]:
    """Distinct words of several lists held by the driver."""
    return list(dict.fromkeys(word for part in lists for word in part))


def stopword_list(table: DataFrame, limit: int = 100_000) -> list[str] | None:
    """Words of a table as a list, for the operators that test array elements.

    None if there are more than ``limit``: such a table goes to `remove_by_join`.
    """
    words = [row.word for row in table.limit(limit + 1).collect()]
    return words if len(words) <= limit else None
