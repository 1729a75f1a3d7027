import random

import numpy as np
import pytest

from corpusloom.operators.projection import pair_map, project, write_map
from corpusloom.plans import training
from corpusloom.sources.pairs import pairs_from_list

GROUPS = [["cat", "dog", "cow", "pig"], ["red", "blue", "green", "pink"]]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(20):
            group = rng.choice(GROUPS)
            lines.append(" ".join(["The", *rng.choices(group, k=8)]))
        texts.append("\n".join(lines))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


PARAMS = {"vector_size": 8, "num_partitions": 1, "step_size": 0.1}


@pytest.fixture(scope="module")
def model(planted):
    return training.fit_vectors(planted, ["the"], **PARAMS)


def vectors_of(model):
    return {r.word: np.array(r.vector) for r in training.word_vectors(model).collect()}


def test_neighbours_are_in_the_planted_group(model):
    vectors = vectors_of(model)
    assert set(vectors) == {w for g in GROUPS for w in g}

    def cosine(a, b):
        return vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])

    for group in GROUPS:
        for word in group:
            ranked = sorted((w for w in vectors if w != word), key=lambda w: -cosine(word, w))
            assert set(ranked[:3]) == set(group) - {word}


def test_same_seed_same_vectors(planted, model):
    again = vectors_of(training.fit_vectors(planted, ["the"], **PARAMS))
    for word, vector in vectors_of(model).items():
        assert np.array_equal(vector, again[word])


def test_saved_models_are_equal(model, tmp_path):
    training.save_model(model, str(tmp_path / "pipeline"))
    training.save_model(model.stages[-1], str(tmp_path / "words"))
    first = vectors_of(model)
    for copy in (
        training.load_pipeline(str(tmp_path / "pipeline")),
        training.load_word_model(str(tmp_path / "words")),
    ):
        assert {w: list(v) for w, v in vectors_of(copy).items()} == {w: list(v) for w, v in first.items()}


def test_sentence_vector_counts_unknown_words_as_zero(spark, model):
    rows = spark.createDataFrame([(0, ["cat", "The", "oov"]), (1, ["oov"])], "doc_id long, raw array<string>")
    found = {r.doc_id: r.vector for r in training.sentence_vectors(model, rows).collect()}
    assert np.allclose(found[0], vectors_of(model)["cat"] / 2)
    assert found[1] == [0.0] * 8


def test_prepared_sentences_and_iterations(planted):
    rows = training.sampled_sentences(planted, ["the"], rate=1.0)
    known = vectors_of(training.fit_sentences(rows, **PARAMS))
    again = vectors_of(training.fit_sentences(rows, **PARAMS, iterations=2))
    assert known.keys() == again.keys() and "cat" in known
    assert any(list(known[w]) != list(again[w]) for w in known)


def test_without_stop_words(planted):
    assert "The" in vectors_of(training.fit_vectors(planted, **PARAMS))


def test_projection_equals_svd(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(30, 5)) * [5, 3, 1, 0.5, 0.1] + 100
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "i long, vector array<double>")
    found = np.array([(r.x, r.y) for r in project(df).orderBy("i").collect()])
    centred = data - data.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for n in range(2):
        axis = axes[n] * np.sign(axes[n][np.argmax(np.abs(axes[n]))])
        assert np.allclose(found[:, n], centred @ axis)


def test_map_keeps_repeated_and_unknown_words(spark, tmp_path):
    vectors = spark.createDataFrame(
        [("a", [1.0, 2.0, 0.0]), ("b", [2.0, 1.0, 5.0]), ("c", [9.0, 9.0, 1.0])],
        "word string, vector array<double>",
    )
    pairs = pairs_from_list(spark, [("a", "b"), ("a", "c"), ("oov", "b")])
    points, lines = pair_map(pairs, vectors)
    rows = points.collect()
    assert len(rows) == 6
    assert len({(r.x, r.y) for r in rows if r.word == "a"}) == 1
    assert lines.count() == 3
    write_map(points, lines, str(tmp_path / "map"))
    assert spark.read.parquet(str(tmp_path / "map/segments")).count() == 3


def test_vector_table_is_read_from_files(model, planted):
    """No plan holds the vectors of a model, and the table outlives it."""
    table = training.word_vectors(model)
    assert table.inputFiles()
    direct = {r.word: r.vector.toArray().tolist() for r in model.stages[-1].getVectors().collect()}
    assert {r.word: r.vector for r in table.collect()} == direct
    passing = training.fit_vectors(planted, ["the"], **PARAMS)
    rows = training.word_vectors(passing)
    del passing
    assert {r.word: r.vector for r in rows.collect()} == direct
