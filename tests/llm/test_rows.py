"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for all operators."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm.decontamination import decontaminate, keep_clean
from corpusloom.llm.jaccard import Rule, jaccard_components, keep_first
from corpusloom.llm.language_id import identify_languages
from corpusloom.llm.licenses import scan_licenses
from corpusloom.llm.packing import pack
from corpusloom.llm.quality import Field, fit_quality, keep_good, score_quality
from corpusloom.llm.secrets import Leaf, findings_by_form, fit_forest, mask_secrets, scan_secrets
from corpusloom.llm.substrings import remove_repeats
from corpusloom.llm.topk import top_k
from corpusloom.llm.url_filter import judge_urls, rule_table

LONG = "long words here and there " * 8000
TEXTS = [
    (1, "one text, of a few words.\nand a line"),
    (1, "one text, of a few words.\nand a line"),
    (2, None),
    (3, ""),
    (None, "a text without an id"),
    (None, None),
    (4, LONG),
    (5, "  \n\t "),
    (4, "same id, other text"),
    (6, "ünï çödé 日本語 \U0001f600"),
]
# names that operators use inside, and one that needs quoting
EXTRA = (
    "'s' AS score, 1 AS row, 2 AS mark, 3 AS component_id, 4 AS n, 5 AS spans, 6 AS row_key1, 7 AS items, 8 AS gaps, "
    "9 AS candidates, 10 AS c, 11 AS cluster, 12 AS `a.b`, CAST(NULL AS STRING) AS path, CAST(NULL AS STRING) AS source, "
    "CAST(length(text) AS BIGINT) AS n_chars, 13 AS masked, 14 AS found, 15 AS copies, 16 AS token, 17 AS starts, "
    "18 AS count, 19 AS copy, 20 AS h"
).split(", ")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", *EXTRA)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(7, "a few words"), (7, "a few words"), (8, None), (9, ""), (None, "text"), (10, "日本語")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("window", F.lit(1))


PER_ROW = {
    "secrets": lambda d, b: scan_secrets(d, [Leaf(1.0)]),
    "quality": lambda d, b: score_quality(d, Field(0.5)),
    "licenses": lambda d, b: scan_licenses(d),
    "jaccard": lambda d, b: jaccard_components(d),
    "substrings": lambda d, b: remove_repeats(d),
    "decontamination": lambda d, b: decontaminate(d, b),
    "decontamination by parts": lambda d, b: decontaminate(d, b, automaton_windows=1),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_document(docs, benchmark, name):
    found = [r["doc_id"] for r in PER_ROW[name](docs, benchmark).collect()]
    assert Counter(found) == Counter(t[0] for t in TEXTS)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables(docs, benchmark, name):
    assert PER_ROW[name](docs.limit(0), benchmark).collect() == []
    assert PER_ROW[name](docs.limit(0), benchmark.limit(0)).collect() == []


FILTERS = {
    "quality": (lambda d, b: keep_good(d, Field(0.5)), None),
    "decontamination": (keep_clean, 3),
    "jaccard": (lambda d, b: keep_first(d), 1),
    "secrets": (lambda d, b: mask_secrets(d, [Leaf(1.0)]), None),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_all_columns(docs, benchmark, name):
    function, gone = FILTERS[name]
    kept = function(docs, benchmark)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert len(rows) == len(TEXTS) - (gone or 0)
    assert function(docs.limit(0), benchmark).collect() == []


def test_filters_by_row(docs, benchmark):
    """Of two rows of one id only the contaminated one goes; of equal rows one stays, and unlike ones of one id all."""
    clean = Counter((r["doc_id"], r["text"]) for r in keep_clean(docs, benchmark).collect())
    assert clean == Counter(t for t in TEXTS if t[0] not in (1, 6))
    first = Counter((r["doc_id"], r["text"]) for r in keep_first(docs, Rule(5, 80)).collect())
    assert first == Counter(set(TEXTS))


def test_near_duplicates_among_rows_of_one_id(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(7, say(1)), (7, say(2)), (7, say(1) + " more"), (3, say(2) + " end"), (9, say(3)), (9, say(3)), (None, say(1))]
    rows += [(8, None), (8, ""), (5, say(4)), (6, say(4))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in keep_first(table, Rule(5, 80)).collect())
    either = [(7, say(1)), (7, say(1) + " more")]
    assert sum(got.pop(r, 0) for r in either) == 1
    assert got == Counter([(3, say(2) + " end"), (9, say(3)), (None, say(1)), (8, ""), (5, say(4))])


def test_a_text_is_kept_before_a_null(spark):
    rows = [(1, None), (1, "a clean text"), (2, None), (2, None), (3, ""), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(tuple(r) for r in keep_first(table).collect() if r["doc_id"] != 2)
    assert kept == [(1, "a clean text"), (3, "")]
    assert [r["text"] for r in keep_first(table).where("doc_id = 2").collect()] == [None]


def test_null_and_empty_texts(docs, benchmark):
    words = decontaminate(docs, benchmark).where("doc_id IN (2, 3, 5)").collect()
    assert {(r["n_words"], r["n_hit"], r["contaminated"], len(r["items"])) for r in words} == {(0, 0, False, 0)}
    sets = {r["doc_id"]: r for r in jaccard_components(docs).collect()}
    assert [(sets[i]["n_shingles"], sets[i]["component_id"]) for i in (2, 3, 5)] == [(0, 2), (0, 3), (0, 5)]
    assert sets[None]["component_id"] is None
    kept = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in remove_repeats(docs).where("doc_id IN (2, 3, 5)").collect()}
    assert kept == {2: (0, b""), 3: (0, b""), 5: (5, b"  \n\t ")}


def test_packing_holds_all_rows(docs):
    rows = pack(docs, VOCABULARY, with_ids=True).collect()
    for doc, n in ((1, 2), (2, 1), (3, 1), (None, 2)):
        assert sum(r["length"] for r in rows if r["doc_id"] == doc and r["start"] == 0) > 0
        assert sum(1 for r in rows if r["doc_id"] == doc and r["start"] == 0) == n
    assert [(r["length"], bytes(r["ids"])) for r in rows if r["doc_id"] in (2, 3)] == [(1, b"\x01\0\0\0")] * 2
    assert pack(docs.limit(0), VOCABULARY).collect() == []


def test_urls(spark):
    urls = [(1, None), (1, None), (None, "http://x.org/a"), (2, ""), (3, "no scheme org/"), (4, "a://b://org/"),
            (5, "HTTP://EXAMPLE.ORG/es/" + "x" * 50_000), (6, "x://example.org?/es/"), (7, "x://org"), (8, "x://org:80/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", *EXTRA_URL)
    found = judge_urls(pages, rule_table(spark)).collect()
    assert len(found) == len(urls)
    by = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in found}
    assert by == {
        1: ("", None, "allow"), None: ("x.org", "org/", "allow"), 2: ("", None, "allow"), 3: ("", None, "allow"),
        4: ("b:", None, "allow"), 5: ("example.org", "example.org/es/", "block"), 6: ("example.org", None, "allow"),
        7: ("org", None, "allow"), 8: ("org:80", None, "allow"),
    }
    assert judge_urls(pages.limit(0), rule_table(spark)).collect() == []
    none = judge_urls(pages, rule_table(spark).limit(0), "block").collect()
    assert {r["verdict"] for r in none} == {"block"} and len(none) == len(urls)


EXTRA_URL = ["1 AS host", "2 AS path", "3 AS rule", "4 AS short", "5 AS best", "6 AS copies"]


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [1.0]),
            (5, []), (6, [1e308, 1.0]), (None, [1.0, 1.0]), (7, [-1.0, -2.0]), (8, [1.0, 2.0]), (50, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"q": F.lit(1), "score": F.lit(2), "rank": F.lit(3)}
    )
    found = [tuple(r) for r in top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()]
    assert sorted(found) == [(0, 1, 8, 5 * 65536), (0, 2, 7, -5 * 65536), (50, 1, 5, 0)]
    assert top_k(vectors.limit(0), vectors.limit(0)).collect() == []
    assert top_k(vectors, vectors.limit(0)).collect() == []


def test_pages(spark, docs):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (None, "http://a.de/x", "<html lang=DE-at><p>der die das</p>"),
            (3, "x", "<!-- <script> unclosed " + "<" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"lang": F.lit(1), "host": F.lit(2)})
    texts = spark.createDataFrame([("en", "the and of"), ("de", "der die das"), (None, "x"), ("", "y")], "lang string, text string")
    found = identify_languages(pages, texts).collect()
    assert Counter(r["page_id"] for r in found) == Counter(r[0] for r in rows)
    assert {r["lang"] for r in found} <= {"de", "en"}
    assert [(r["lang"], r["declared"], r["suffix"]) for r in found if r["page_id"] is None] == [("de", "de", "de")]
    assert {r["lang"] for r in identify_languages(pages, texts.limit(0)).collect()} == {None}
    assert identify_languages(pages.limit(0), texts).collect() == []


def test_models_without_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_quality(docs, labels) == Field(0.5)
    one = spark.createDataFrame([(1, 1), (4, None), (None, 0), (6, 1), (6, 0)], "doc_id long, quality int")
    assert fit_quality(docs, one).constant == 1.0
    assert fit_forest(findings_by_form(docs.limit(0))) == [Leaf(1.0)]


def test_secret_places(docs):
    key = "AKIA" + "Q7" * 8
    text = f"é {key} and {key}x, password=0123456789abcdefff"
    table = docs.limit(1).withColumn("text", F.lit(text))
    (row,) = scan_secrets(table, [Leaf(1.0)]).collect()
    assert [text[f["start"] : f["end"]] for f in row["findings"]] == [key, key + "x", "0123456789abcdefff"]
    (masked,) = mask_secrets(table, [Leaf(1.0)]).collect()
    assert masked["text"] == "é [SECRET] and [SECRET], password=[SECRET]" and masked["n_chars"] == len(masked["text"])


def test_stages(spark, docs):
    """Every stage takes odd rows and an empty table; all but the last keep the columns."""
    folder = "/root/testdata/sf0.001"
    for table in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, folder)
            out.collect()
            assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns




@pytest.mark.parametrize("n", [1, 7, 8, 9, 4000])
def test_places_of_many_candidates(spark, n):
    """Starts in blocks are those of the text."""
    rng = random.Random(n)
    words = ["".join(rng.choices("0123456789abcdef", k=rng.randint(20, 40))) for _ in range(n)]
    text = "é \n" + "".join(w + rng.choice([" ", ", ", "\n ü "]) for w in words)
    table = spark.createDataFrame([(1, text), (2, "no"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["findings"] for r in scan_secrets(table, [Leaf(1.0)]).collect()}
    assert found[2] == found[3] == []
    assert [text[f["start"] : f["end"]] for f in found[1]] == [f["candidate"] for f in found[1]] == words
