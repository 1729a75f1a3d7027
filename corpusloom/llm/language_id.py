"""Language of web pages by Bayesian fusion of evidence.

Evidence is the text's likelihood under trigram models of each language, the
language that the markup declares, the suffix of the address, and a prior of
the host.  What declarations, suffixes and hosts tell is learned from the pages
themselves by grouped aggregation of the text's posteriors.  The prior of a
host is smoothed towards its domain's, and that towards the overall one; a
page's own text is taken out of the priors that it is judged by.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import binary, bytes_of, lookup, map_batches, materialize
from corpusloom.llm.url_filter import host_and_path

# Trigram buckets of a language's model.
BUCKETS = 4096
# Neighbouring trigrams overlap, so each counts only in part.
TEXT_WEIGHT = 0.2
# Strength, in pages, of what a group's counts are smoothed towards.
STRENGTH = 5.0

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[:65] = 32  # white space, digits and punctuation are one symbol
_LOWER[91:97] = 32
_LOWER[123:128] = 32
# What is not closed reaches to the end, so that no text is looked at twice.
_INVISIBLE = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[^<>]*>?"
)
_DECLARED = re.compile(r"(?is)<(?:html|body)\b[^<>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,8})")
_META = re.compile(
    r"(?is)<meta\b[^<>]*?(?:content-language|og:locale)[^<>]*?\bcontent\s*=\s*[\"']?\s*([a-z]{2,8})"
)


def trigram_buckets(text: bytes) -> np.ndarray:
    """Bucket of each trigram of letters; runs of other characters are one gap."""
    codes = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    codes = codes[(codes != 32) | np.concatenate([[True], codes[:-1] != 32])]
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (codes[:-2] * np.uint32(65536) + codes[1:-1] * np.uint32(256) + codes[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(32 - 12)).astype(np.int64)


def visible_text(page: str) -> str:
    return markup.unescape(_INVISIBLE.sub(" ", page))


def declared_language(page: str) -> str | None:
    """Primary subtag that the markup declares, lower-cased."""
    found = _DECLARED.search(page) or _META.search(page)
    return found.group(1).lower() if found else None


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over all documents that have a language."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), binary(batch.column("text"))):
            total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            total += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        langs, buckets, numbers = [], [], []
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            langs += [lang] * len(some)
            buckets.append(some)
            numbers.append(total[some])
        none = [np.zeros(0, dtype=np.int64)]
        columns = [pa.array(langs, pa.string()), pa.array(np.concatenate(buckets or none)), pa.array(np.concatenate(numbers or none))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    known = docs.select(F.lower(F.trim(F.col("lang").cast("string"))).alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where("lang <> '' AND text IS NOT NULL")
    return map_batches(known, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class TextModel:
    """Log probabilities of trigram buckets by language; its size is languages times ``BUCKETS``."""

    def __init__(self, counts: DataFrame):
        rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).orderBy("lang").collect()
        self.languages = [r["lang"] for r in rows]
        table = np.full((len(rows), BUCKETS), 0.5)
        for i, r in enumerate(rows):
            for c in r["counts"]:
                table[i, c["bucket"]] += c["n"]
        self.log = np.log(table / table.sum(axis=1, keepdims=True)) if rows else table

    def likelihood(self, text: bytes) -> np.ndarray:
        """Weighted log likelihood of the text in each language, the greatest set to 0."""
        counts = np.bincount(trigram_buckets(text), minlength=BUCKETS)
        score = TEXT_WEIGHT * (self.log @ counts)
        return score - score.max() if len(score) else score


def read_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id, url, declared, text_score`` (a number for each language) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        declared, scores = [], []
        for page in batch.column("html").to_pylist():
            declared.append(declared_language(page or ""))
            scores.append(shared.value.likelihood(visible_text(page or "").encode("utf-8", "replace")))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(declared, pa.string()), pa.array(scores, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "declared", "text_score"])

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return map_batches(rows, run, "page_id long, url string, declared string, text_score array<double>")


def _softmax(score: Column, n: int) -> Column:
    """Probabilities from logarithms whose greatest is near 0."""
    top = F.array_max(score)
    powers = F.transform(score, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    return F.transform(powers, lambda x: x / total)


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Sum of the text's posteriors of each language, per group, as an array."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.get("posterior", i)) for i in range(n)]).alias(name))


def identify_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Language of every page: ``page_id, lang, probability, text_lang, declared, suffix, host``.

    ``docs`` (lang, text) holds labelled texts; all of them are counted.

    Pages without text are judged by the other evidence, and without any by
    the overall prior.  Null URLs and markup are empty.  Rows that repeat a
    page_id are judged each.  Without labelled texts ``lang`` and
    ``probability`` are null.  Equal probabilities go to the first language in
    alphabetic order.  Other columns are ignored; no pages give no rows.
    """
    model = TextModel(trigram_counts(docs))
    n = len(model.languages)
    read = read_pages(pages, model)
    host, _ = host_and_path(F.col("url"))
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(name, "[.]")
    placed = read.withColumn("host", name).withColumn(
        "domain", F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(name)
    )
    placed = placed.withColumn("suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)))
    if not n:
        return placed.select(
            "page_id",
            F.lit(None).cast("string").alias("lang"),
            F.lit(None).cast("double").alias("probability"),
            F.lit(None).cast("string").alias("text_lang"),
            "declared",
            "suffix",
            "host",
        )
    rows = materialize(placed.withColumn("posterior", _softmax(F.col("text_score"), n)).drop("url"), "page-evidence")
    overall = rows.agg(*[F.sum(F.get("posterior", i)).alias(f"s{i}") for i in range(n)]).first()
    mass = [float(overall[i] or 0.0) for i in range(n)]
    # the overall prior, from all other pages
    prior = [
        (F.greatest(F.lit(m) - F.get("posterior", i), F.lit(0.0)) + 1) / (max(sum(mass) - 1, 0.0) + n)
        for i, m in enumerate(mass)
    ]
    # joins need keys that are not null
    keyed = rows.withColumns(
        {"declared_key": F.coalesce("declared", F.lit("")), "suffix_key": F.coalesce("suffix", F.lit(""))}
    )
    for keys, label in ((["declared_key"], "by_declared"), (["suffix_key"], "by_suffix"), (["domain"], "by_domain"), (["host"], "by_host")):
        sums = materialize(_sums(keyed, keys, n, label), label)
        keyed = lookup(keyed, sums, keys, bytes_of(sums, *keys)[1] + 8 * n * sums.count())

    def own(label: str, i: int) -> Column:
        """A group's mass of a language without the page itself."""
        return F.greatest(F.get(label, i) - F.get("posterior", i), F.lit(0.0))

    def size(label: str) -> Column:
        return F.aggregate(label, F.lit(0.0), lambda a, b: a + b) - 1

    def share(label: str, i: int, towards: Column) -> Column:
        """A language's share of the other pages of a group, smoothed towards a wider group's."""
        return (own(label, i) + STRENGTH * towards) / (F.greatest(size(label), F.lit(0.0)) + STRENGTH)

    evidence = []
    for i in range(n):
        placed_prior = share("by_host", i, share("by_domain", i, prior[i]))
        score = F.get("text_score", i) + F.log(F.when(F.col("host") == "", prior[i]).otherwise(placed_prior))
        for column, label in (("declared", "by_declared"), ("suffix", "by_suffix")):
            # by Bayes' rule the likelihood of a value is its languages' shares over their prior, but for a factor that all
            # have; absent values, and such as no other page has, say nothing
            ratio = F.log(share(label, i, prior[i]) / prior[i])
            score += F.when(F.col(column).isNull(), F.lit(0.0)).otherwise(ratio)
        evidence.append(score)
    fused = keyed.withColumn("fused", F.explode(F.array(_softmax(F.array(*evidence), n))))
    names = F.array(*[F.lit(x) for x in model.languages])

    def best(column: str) -> Column:
        return F.get(names, (F.array_position(column, F.array_max(column)) - 1).cast("int"))

    return fused.select(
        "page_id",
        best("fused").alias("lang"),
        F.array_max("fused").alias("probability"),
        best("posterior").alias("text_lang"),
        "declared",
        "suffix",
        "host",
    )
