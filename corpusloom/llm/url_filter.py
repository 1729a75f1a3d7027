"""URL rules by hashed expressions, as DataFrame operations.

A URL is expanded into expressions: each suffix of its host's labels with each
prefix of its path that is as long as some rule's path.  Expressions and rules
meet in an equi-join on a short prefix of their digests; the full digests
confirm a hit; the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Hex digits of the short digest that the join is on.
SHORT = 8
# The rules to judge by, as (verdict, host followed by path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules as ``(rule, verdict)``."""
    return spark.createDataFrame([(rule, verdict) for verdict, rule in rules], "rule string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Verdict on the URL of every row of ``pages`` (page_id, url).

    ``rules`` has ``rule`` (a host, followed by a path or not) and ``verdict``.
    A rule fits its host and all subdomains where the URL's path starts with
    the rule's.  Among fitting rules the longest wins; of two equal rules,
    the one whose verdict is greater as text (block before allow).

    Returns ``page_id, host, path, rule`` (null if none fits) and ``verdict``
    (``default`` then).  Null URLs and URLs without ``://`` have an empty host
    and path.  Rows that repeat a page_id or a whole row are judged each;
    null rules are ignored, and other columns too.  Empty tables of pages give
    no rows, empty rules the default.
    """
    rules = rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("verdict"))
    rules = rules.where("rule IS NOT NULL AND verdict IS NOT NULL").distinct()
    path_length = F.length("rule") - F.length(F.substring_index("rule", "/", 1))
    facts = rules.agg(
        F.sort_array(F.collect_set(path_length)).alias("lengths"),
        F.sum(F.octet_length("rule") + 160).alias("size"),
        F.max(F.size(F.split(F.substring_index("rule", "/", 1), "[.]", -1))).alias("labels"),
    ).first()
    digest = F.sha2("rule", 256)
    keyed = rules.select(F.substring(digest, 1, SHORT).alias("short"), digest.alias("full"), "rule", "verdict")

    # equal rows are judged once; a group is no larger than one row
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")
    ).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    host, path = host_and_path(F.col("url"))
    # kept in one projection, so that the parts are not taken apart again below
    parts = rows.select("page_id", "url", "copies", F.array(F.struct(host.alias("host"), path.alias("path"))).alias("p"))
    parts = parts.select("page_id", "url", "copies", F.inline("p"))

    labels = F.split("host", "[.]", -1)
    depth = F.least(F.size(labels), F.lit(facts["labels"] or 0))
    suffixes = F.transform(
        F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    fitting = F.filter(
        F.array(*[F.lit(n) for n in facts["lengths"]]).cast("array<int>"), lambda n: n <= F.length("path")
    )
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    expanded = parts.select("page_id", "url", "copies", "host", "path", F.explode_outer(expressions).alias("expression"))
    hashed = expanded.withColumn("digest", F.sha2("expression", 256)).withColumn(
        "short", F.substring("digest", 1, SHORT)
    )
    met = lookup(hashed.drop("expression"), keyed, ["short"], facts["size"] or 0)
    confirmed = F.when(F.col("full") == F.col("digest"), F.struct(F.length("rule").alias("n"), "verdict", "rule"))
    best = met.groupBy("page_id", "url", "host", "path").agg(
        F.first("copies").alias("copies"), F.max(confirmed).alias("best")
    )
    judged = best.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        "copies",
    )
    one = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return judged.withColumn("copy", one).drop("copies", "copy")
