"""One key through all sources, and plans that leave texts where they lie."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import select, subsample
from corpusloom.operators.bigrams import pair_counts
from corpusloom.operators.ordering import dense_ids
from corpusloom.operators.phrases import join_phrases, join_token_phrases, token_table
from corpusloom.plans import training
from corpusloom.plans.build_corpus import build_corpus, numbered_corpus
from corpusloom.plans.phrases import repeat_phrases


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", ["in order", "mixed", "one", "empty"])
def test_ids_are_dense_and_in_order(spark, parts):
    keys = [(s, i * 3) for s in range(3) for i in range(40)] if parts != "empty" else []
    df = spark.createDataFrame(keys, "rank int, source_id long")
    if parts == "in order":
        df = df.repartitionByRange(5, "rank", "source_id")
    elif parts == "mixed":
        df = df.repartition(5)
    elif parts == "one":
        df = df.coalesce(1).orderBy(F.desc("source_id"))
    numbered = dense_ids(df, ["rank", "source_id"], "doc_id", 4).orderBy("doc_id").collect()
    assert [tuple(r) for r in numbered] == [(n, *key) for n, key in enumerate(sorted(keys))]


def test_ids_of_equal_keys_are_dense(spark):
    df = spark.createDataFrame([(1, 7)] * 50 + [(1, None)] * 3, "rank int, source_id long").repartition(4)
    found = dense_ids(df, ["rank", "source_id"], "doc_id", 4).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == list(range(53))
    assert [r.source_id for r in found] == [None] * 3 + [7] * 50


@pytest.fixture(scope="module")
def sources(spark):
    def corpus(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    plain = {
        "first": corpus([(5, "Ends here\nred"), (1, "It starts.\n\nagain"), (3, None)]),
        "second": corpus([(1, "House and more"), (5, "x")]),
    }
    pages = {"pages": corpus([(1, "<b>one</b> two\nalone\n\nthree four"), (2, "alone"), (4, "#REDIRECT [[one two]]")])}
    return plain, pages


def test_one_id_through_all_sources(spark, sources):
    rows = numbered_corpus(*sources, decode_entities=True).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(5))
    assert [(r.source, r.source_id) for r in rows] == [("first", 1), ("first", 5), ("second", 1), ("second", 5), ("pages", 1)]
    lines = build_corpus(*sources, decode_entities=True).orderBy("line_no").collect()
    for r in rows:
        assert r.text.split("\n") == [x.text for x in lines if (x.source, x.doc_id) == (r.source, r.source_id)]


def test_neighbours_of_two_sources_are_counted_once(spark, sources):
    corpus = numbered_corpus(*sources, decode_entities=True).select("doc_id", "text")
    found = {(r.prev, r.word): r.n for r in pair_counts(corpus).collect()}
    assert found["red", "house"] == 1 and found["more", "x"] == 1 and found["x", "one"] == 1
    tokens = [w for r in corpus.orderBy("doc_id").collect() for w in r.text.split()]
    assert sum(n for n in found.values()) == len(tokens)


def test_passes_shuffle_no_text(spark, corpus_of):
    corpus = corpus_of(*["new york is big\nnew york is old"] * 30)
    documents, _ = token_table(corpus)
    assert "Exchange hashpartitioning" not in plan_of(join_token_phrases(documents, 1, 1.0))
    assert "Exchange rangepartitioning" not in plan_of(join_token_phrases(documents, 1, 1.0))
    plan = plan_of(repeat_phrases(corpus, [2.0, 1.0], 1))
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert "SelectedBucketsCount" in plan


def test_passes_equal_single_passes(spark, corpus_of):
    draw = random.Random(7)
    words = ["a", "b", "c", "d", "</s>", "a_b", "e\tf", ""]
    corpus = corpus_of(*["\n".join(" ".join(draw.choices(words, k=9)) for _ in range(3)) for _ in range(20)], "", None, "\n\n")
    once = join_phrases(corpus, 1, 1.5)
    twice = join_phrases(once, 1, 1.0)
    got = repeat_phrases(corpus, [1.5, 1.0], 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_many_wanted_words_in_one_document(spark):
    """20,000 wanted words in a document, every one in a few pairs, and one word in very many."""
    words = [f"w{i}" for i in range(20_000)]
    pairs = [(words[i], f"absent{i}") for i in range(20_000)] + [("w7", f"z{i}") for i in range(5_000)]
    docs = [(1, words), (2, words[:9]), (3, ["w7", "z4999"]), (4, ["z1", "z2"]), (5, ["w1", "absent1", "absent1"]), (6, [])]
    docs = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    listed = spark.createDataFrame(pairs, "word1 string, word2 string")
    assert sorted(r.doc_id for r in select.with_pair_tokens(docs, listed).collect()) == [3, 5]
    both = listed.unionByName(spark.createDataFrame([("w19999", "w0"), ("w3", "w3"), (None, "w1")], "word1 string, word2 string"))
    assert sorted(r.doc_id for r in select.with_pair_tokens(docs, both).collect()) == [1, 2, 3, 5]


@pytest.mark.parametrize("portable", [True, False])
def test_thinning_in_the_row(spark, corpus_of, monkeypatch, portable):
    corpus = corpus_of(*["the cat and the dog éß' \" and\nthe the the rare%d" % i for i in range(60)], "", "the")
    own = training.sampled_sentences(corpus, ["and"], 0.02, 3, portable)
    assert "Exchange" not in plan_of(own)
    monkeypatch.setattr(subsample, "ROW_BYTES", 0)
    joined = training.sampled_sentences(corpus, ["and"], 0.02, 3, portable)
    assert "Exchange" in plan_of(joined)
    rows = sorted(tuple(r) for r in own.collect())
    assert rows == sorted(tuple(r) for r in joined.collect())
    assert 0 < sum(len(r[2]) for r in rows) < corpus.select(F.sum(F.size(T.alphabetic_tokens(F.col("text"))))).head()[0]


def test_row_table_is_a_constant_of_the_plan(spark, corpus_of):
    own = training.sampled_sentences(corpus_of(*["a a a b"] * 20), (), 0.01)
    assert "from_json" not in own._jdf.queryExecution().optimizedPlan().toString()
