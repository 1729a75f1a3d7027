import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import lookup
from corpusloom.operators.analogies import analogies, analogy_accuracy, synonyms
from corpusloom.operators.nearest import nearest_words
from corpusloom.plans.evaluation import evaluate, metric_table
from corpusloom.sources.pairs import COUNTRY_CAPITALS, pairs_from_list


@pytest.fixture
def table(spark):
    def build(vectors):
        rows = [(w, [float(x) for x in v]) for w, v in vectors.items()]
        return spark.createDataFrame(rows, "word string, vector array<double>")

    return build


@pytest.fixture
def random_vectors():
    rng = np.random.default_rng(1)
    vectors = {f"w{i}": rng.normal(size=6).round(2) for i in range(200)}
    vectors["zero"] = np.zeros(6)
    vectors["twin"] = vectors["w7"]
    return vectors


def best(vectors, query, k, excluded=()):
    def cosine(v):
        scale = np.linalg.norm(v) * np.linalg.norm(query)
        return float(v @ query / scale) if scale else 0.0

    sims = [(-round(cosine(v), 9), w) for w, v in vectors.items() if w not in excluded]
    return [w for _, w in sorted(sims)[:k]]


def as_queries(spark, queries):
    rows = [(i, [float(x) for x in v], list(e)) for i, (v, e) in enumerate(queries)]
    return spark.createDataFrame(rows, "query_id long, vector array<double>, excluded array<string>")


def answers(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.word)
    return out


def test_nearest_equals_brute_force(spark, table, random_vectors):
    asked = [(random_vectors[f"w{i}"], {f"w{i}"} if i % 2 else set()) for i in range(12)]
    asked += [(np.zeros(6), set()), (np.zeros(6), {"w0", "w1"})]
    vectors = table(random_vectors).repartition(5)
    expected = {i: best(random_vectors, v, 4, e) for i, (v, e) in enumerate(asked)}
    queries = as_queries(spark, asked)
    assert answers(nearest_words(vectors, queries, 4)) == expected
    # more queries than one matrix holds
    assert answers(nearest_words(vectors, queries, 4, matrix_queries=3)) == expected


def test_nearest_with_few_words(spark, table):
    vectors = table({"a": [1, 0], "b": [0, 1]})
    queries = as_queries(spark, [([1, 1], {"a"}), ([0, 0], set())])
    assert answers(nearest_words(vectors, queries, 5)) == {0: ["b"], 1: ["a", "b"]}


def test_nearest_without_queries(spark, table):
    assert nearest_words(table({"a": [1, 0]}), as_queries(spark, [])).count() == 0


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    row = df.select(
        V.norm(a).alias("n"), V.cosine_similarity(a, b).alias("s"), V.cosine_distance(a, b).alias("d"),
        V.cosine_similarity(a, z).alias("sz"), V.cosine_distance(a, z).alias("dz"),
        V.unit(a).alias("u"), V.unit(z).alias("uz"), V.is_nonzero(a).alias("y"),
        V.is_nonzero(z).alias("x"), V.subtract(a, b).alias("m"), V.scale(a, 2.0).alias("t"),
    ).head()
    assert (row.n, row.s, row.sz, row.dz) == (5.0, 24 / 25, 0.0, None)
    assert math.isclose(row.d, 1 / 25)
    assert (row.u, row.uz, row.y, row.x) == ([0.6, 0.8], [0.0, 0.0], True, False)
    assert (row.m, row.t) == ([-1.0, 1.0], [6.0, 8.0])


def test_lookup_fills_and_filters(spark, table):
    vectors = table({"a": [1, 2], "b": [0, 0], "c": [3, 4]})
    pairs = pairs_from_list(spark, [("A", "c"), ("b", "oov"), ("c", "c")])
    rows = lookup.fill_zero(lookup.pair_vectors(pairs, vectors), 2).orderBy("pair_id").collect()
    assert [(r.vector1, r.vector2) for r in rows] == [
        ([1.0, 2.0], [3.0, 4.0]), ([0.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]),
    ]
    assert sorted(r.pair_id for r in lookup.known_pairs(pairs, vectors).collect()) == [0, 2]


@pytest.mark.parametrize("broadcast_values", [10**6, 2])
def test_mean_vectors(spark, table, broadcast_values):
    vectors = table({"a": [1, 0], "b": [0, 2], "c": [5, 5]})
    docs = {0: "a a b x", 1: "x y", 2: "c a"}
    rows = [(d, w) for d, text in docs.items() for w in text.split()]
    tokens = spark.createDataFrame(rows, "doc_id long, word string")
    counts = tokens.groupBy("word").agg(F.count("*").alias("cn"))
    means = lookup.mean_vectors(tokens, counts, vectors, broadcast_values=broadcast_values)
    found = {r.doc_id: (r.n_tokens, r.vector) for r in means.collect()}
    assert found == {0: (4, [0.5, 0.5]), 1: (2, [0.0, 0.0]), 2: (2, [3.0, 2.5])}


ANALOGY = {
    "china": [1, 0, 0, 1], "beijing": [1, 0, 0, 5], "japan": [0, 1, 0, 1], "tokyo": [0, 1, 0, 5],
    "spain": [0, 0, 1, 1], "madrid": [0, 0, 1, 5], "noise": [-1, -1, -1, -9],
}
PAIRS = [("china", "beijing"), ("japan", "tokyo"), ("atlantis", "poseidonis"), ("spain", "madrid")]


def test_offset_analogies(spark, table):
    pairs, vectors = pairs_from_list(spark, PAIRS), table(ANALOGY)
    found = analogies(pairs, vectors, k=3)
    first = {r.pair_id: r for r in found.where("rank = 1").collect()}
    # the base pair answers itself, the unknown pair is answered from its zero vector
    assert {i: r.predicted for i, r in first.items() if i != 2} == {0: "beijing", 1: "tokyo", 3: "madrid"}
    assert first[2].word1 == "atlantis" and not first[2].correct
    assert tuple(analogy_accuracy(pairs, found).head()) == (3, 4, 4)


def test_unit_mean_analogies_skip_unknown_and_inputs(spark, table):
    pairs, vectors = pairs_from_list(spark, PAIRS), table(ANALOGY)
    found = analogies(pairs, vectors, k=3, exclude_inputs=True)
    rows = found.collect()
    assert {r.pair_id for r in rows} == {0, 1, 3}
    for r in rows:
        assert r.predicted not in {"china", "beijing", r.word1}
    # labels do not shift past the skipped pair
    assert {r.pair_id: r.expected for r in rows}[3] == "madrid"
    assert tuple(analogy_accuracy(pairs, found).head()) == (2, 4, 3)


def test_synonyms_skip_unknown_words(spark, table):
    words = spark.createDataFrame([(0, "japan"), (1, "oov")], "query_id long, word string")
    found = synonyms(words, table(ANALOGY), k=2).orderBy("rank").collect()
    assert [(r.query, r.rank) for r in found] == [("japan", 1), ("japan", 2)]
    assert "japan" not in [r.word for r in found]
    kept = synonyms(words, table(ANALOGY), k=1, exclude_self=False).collect()
    assert [r.word for r in kept] == ["japan"]


def test_pair_lists():
    assert {k: len(v) for k, v in COUNTRY_CAPITALS.items()} == {"en": 11, "de": 11, "de-example": 6}


def test_evaluation_reports(spark, table):
    rated = spark.createDataFrame(
        [("set", 0, "china", "japan", 5.0), ("set", 1, "china", "noise", 1.0),
         ("set", 2, "tokyo", "madrid", 9.0), ("set", 3, "oov", "madrid", 9.0)],
        "dataset string, line_no long, word1 string, word2 string, score double",
    )
    reports = evaluate(table(ANALOGY), pairs_from_list(spark, PAIRS), rated, k=2)
    metrics = dict(metric_table(reports).collect())
    assert metrics == {"n_correct": 3, "n_pairs": 4, "n_answered": 4, "set:rho": 1.0, "set:coverage": 3}
    assert reports["points"].count() == 8 and reports["segments"].count() == 4
    assert reports["synonyms"].count() == 6
