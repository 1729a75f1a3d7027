"""Registered queries of this package: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.decontamination import decontaminate
from corpusloom.llm.hard_negatives import mine_negatives
from corpusloom.llm.jaccard import jaccard_components
from corpusloom.llm.language_id import identify_languages
from corpusloom.llm.licenses import CONFIDENCE, scan_licenses
from corpusloom.llm.manifest import fold, manifest
from corpusloom.llm.packing import pack
from corpusloom.llm.quality import fit_quality, held_out, score_quality
from corpusloom.llm.secrets import forest_by_form, scan_secrets
from corpusloom.llm.substrings import remove_repeats
from corpusloom.llm.token_files import read_documents, write_token_files
from corpusloom.llm.topk import top_k
from corpusloom.llm.url_filter import judge_urls, rule_table
from corpusloom.scratch import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def confidence():
    """The confidence of license rules by priority, as a map column."""
    return F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])


@query
def op5_packing(spark, sf_dir):
    """All documents as pieces of sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op10_decontamination(spark, sf_dir):
    """All documents, with the passages of the benchmark in them counted."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op4_licenses(spark, sf_dir):
    """License labels of all documents: base phrases at all their places, and what the rules keep."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: d["kept"])

    def joined(detections):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")

    doubt = F.aggregate(
        F.array_distinct(F.transform(kept, lambda d: F.struct(d["label"], d["priority"]))),
        F.lit(1.0),
        lambda product, d: product * (1 - F.element_at(confidence(), d["priority"])),
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first_word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.filter("detections", lambda d: d["base"] | d["kept"])).alias("labels"),
        (1 - doubt).alias("score"),
        F.size(kept).cast("long").alias("n_kept"),
    )


@query
def op9_topk(spark, sf_dir):
    """The 5 highest inner products of every 50th embedding with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op2_url_filter(spark, sf_dir):
    """Verdicts on the addresses of all pages."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


@query
def op3_quality(spark, sf_dir):
    """Quality of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query
def op1_secrets(spark, sf_dir):
    """All candidates for secrets in all documents, and the forest's verdict on each."""
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, forest_by_form(docs))
    return found.select("doc_id", F.inline("findings"))


@query
def op8_jaccard(spark, sf_dir):
    """Components of all documents linked by their 4-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark, sf_dir):
    """Language of all pages, from their text, markup, address and host."""
    return identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op7_substrings(spark, sf_dir):
    """All documents without the bytes of repeated 200-byte strings."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_token_files(spark, sf_dir):
    """Ids of all documents, written as bit-packed files and read back."""
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)


@query
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every 100th embedding; every seventh label is another one."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", label)
    return mine_negatives(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op13_manifest(spark, sf_dir):
    """All documents with their proofs; in every seventh, by checksum, one character more is claimed."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    found = manifest(
        docs,
        ["doc_id", "source", "lang", "n_chars", "text"],
        "lang",
        changed={"n_chars": F.when(tampered, n_chars + 1).otherwise(n_chars)},
    )
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        fold(F.col("claimed"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
