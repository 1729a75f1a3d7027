import random

import pytest

from corpusloom.functions import text as T
from corpusloom.operators import select
from corpusloom.plans.build_corpus import pair_articles, pair_lines
from pyspark.sql import functions as F

TEXTS = ["paris france", "parisian france", "wien", "österreich wien ab", "", "a b", "france", "xfrancex paris"]
PAIRS = [("france", "paris"), ("österreich", "wien"), ("a", "b"), ("", "wien"), ("wien", "zz")]


@pytest.fixture
def docs(corpus_of):
    return corpus_of(*TEXTS)


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(PAIRS, "word1 string, word2 string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.mark.parametrize("limit", [1000, 2])
def test_pairs_as_tokens(docs, pairs, monkeypatch, limit):
    monkeypatch.setattr(select, "LITERAL_PAIRS", limit)
    tokens = docs.select("doc_id", T.space_tokens(F.col("text")).alias("tokens"))
    expected = [i for i, t in enumerate(TEXTS) if any(a in t.split(" ") and b in t.split(" ") for a, b in PAIRS)]
    assert ids(select.with_pair_tokens(tokens, pairs)) == expected


@pytest.mark.parametrize("limit", [1000, 2])
def test_pairs_as_substrings(docs, pairs, monkeypatch, limit):
    monkeypatch.setattr(select, "LITERAL_PAIRS", limit)
    expected = [i for i, t in enumerate(TEXTS) if any(a in t and b in t for a, b in PAIRS)]
    assert ids(select.with_pair_substrings(docs, pairs)) == expected


def test_long_lists_in_several_scans(docs, pairs, monkeypatch):
    monkeypatch.setattr(select, "LITERAL_PAIRS", 2)
    monkeypatch.setattr(select, "SCAN_WORDS", 2)
    monkeypatch.setattr(select, "WANTED_BYTES", 0)
    expected = [i for i, t in enumerate(TEXTS) if any(a in t and b in t for a, b in PAIRS)]
    assert ids(select.with_pair_substrings(docs, pairs)) == expected
    tokens = docs.select("doc_id", T.space_tokens(F.col("text")).alias("tokens"))
    expected = [i for i, t in enumerate(TEXTS) if any(a in t.split(" ") and b in t.split(" ") for a, b in PAIRS)]
    assert ids(select.with_pair_tokens(tokens, pairs)) == expected


@pytest.mark.parametrize("settling", [200_000, 1, 0])
def test_long_lists_on_random_strings(spark, monkeypatch, settling):
    """Words inside tokens, across tokens and long ones, null and repeated keys, null texts, words of many partners."""
    for name, value in (("LITERAL_PAIRS", 2), ("SETTLING_TOKENS", settling), ("WORD_LENGTH", 8), ("HEAD_LENGTH", 3), ("STRIDE", 4), ("TOGETHER", 5)):
        monkeypatch.setattr(select, name, value)
    rng = random.Random(3)

    def string(letters, most):
        return "".join(rng.choices(letters, k=rng.randint(0, most)))

    texts = [string("aaabbbcé😀 \n", rng.choice([4, 12, 40])) for _ in range(60)]
    rows = [(i % 50 if i % 7 else None, t if i % 11 else None) for i, t in enumerate(texts)]
    words = [string("abcé😀", 6) for _ in range(25)] + [string("ab \n", 4) for _ in range(4)] + ["abababababab", "z", None]
    pairs = [(rng.choice(words[:29]), rng.choice(words)) for _ in range(12)] + [("cé", w) for w in words] + [("bca", "bca"), ("z", "a")]
    found = {
        k for k, _ in rows if k is not None and any(
            a is not None and b is not None and any(a in t for o, t in rows if o == k and t is not None)
            and any(b in t for o, t in rows if o == k and t is not None) for a, b in pairs
        )
    }
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(pairs, "word1 string, word2 string")
    assert 0 < len(found) < 50
    assert ids(select.with_pair_substrings(docs, table)) == sorted(k for k, _ in rows if k in found)


def test_scans_of_texts_do_not_grow_with_the_list(docs, pairs, monkeypatch):
    monkeypatch.setattr(select, "LITERAL_PAIRS", 2)
    monkeypatch.setattr(select, "SCAN_WORDS", 2)
    scans, scan = [], select._word_scan
    monkeypatch.setattr(select, "_word_scan", lambda *a: scans.append(a[-1]) or scan(*a))
    expected = [i for i, t in enumerate(TEXTS) if any(a in t and b in t for a, b in PAIRS if a)]
    assert ids(select.with_pair_substrings(docs, pairs.where("word1 <> ''"))) == expected
    assert not scans


def test_no_pairs(docs, spark):
    none = spark.createDataFrame([], "word1 string, word2 string")
    assert ids(select.with_pair_substrings(docs, none)) == []
    tokens = docs.select("doc_id", T.space_tokens(F.col("text")).alias("tokens"))
    assert ids(select.with_pair_tokens(tokens, none)) == []


def test_first_documents_in_order(docs, pairs):
    assert ids(pair_lines(docs, pairs, 2)) == [0, 1]
    assert ids(pair_lines(docs, pairs, 0)) == []
    tokens = docs.select("doc_id", T.space_tokens(F.col("text")).alias("tokens"))
    rows = pair_articles(tokens, pairs, 2).orderBy("doc_id").collect()
    assert list(map(tuple, rows)) == [(0, "paris france"), (3, "österreich wien ab")]


def test_titles(spark):
    pages = spark.createDataFrame([(0, "New York", "BIG"), (1, "Wien", "Stadt")], "doc_id long, title string, text string")
    titles = spark.createDataFrame([("New York\n",), ("Nowhere",)], "title string")
    rows = select.with_titles(pages, titles).collect()
    assert [(r.doc_id, r.title_key, r.text) for r in rows] == [(0, "New_York", "big")]
