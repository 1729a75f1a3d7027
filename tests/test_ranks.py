"""Rank correlation against a restatement over plain lists."""

import random

import numpy as np
import pytest

from corpusloom.operators import ordering
from corpusloom.operators.ranks import rank_correlation, similarity_scores


def average_ranks(values):
    ordered = sorted(values)
    return [ordered.index(v) + (ordered.count(v) + 1) / 2 for v in values]


def expected(rows):
    """rows: (word1, word2, score, distance) in file order."""
    by_score = sorted(rows, key=lambda r: -r[2])
    by_distance = sorted([(r[:2], r[3]) for r in by_score], key=lambda r: r[1])
    places = [i for i, _ in enumerate(by_score)]
    others = [[p for p, _ in by_distance].index(r[:2]) for r in by_score]
    if len(rows) < 2:
        return None, len(rows)
    rho = np.corrcoef(average_ranks(places), average_ranks(others))[0, 1]
    return (None if np.isnan(rho) else round(float(rho), 3)), len(rows)


def random_rows(rng, n):
    rows, distances = [], {}
    for _ in range(n):
        pair = (rng.choice("abcdef"), rng.choice("uvwxyz"))
        distances.setdefault(pair, rng.choice([0.1, 0.2, 0.25, 0.5, 0.9]))
        rows.append((*pair, rng.choice([1.0, 2.0, 2.5, 3.0]), distances[pair]))
    return rows


@pytest.mark.parametrize("limit", [ordering.WINDOW_ROWS, 3])
def test_correlation_equals_lists(spark, monkeypatch, limit):
    monkeypatch.setattr(ordering, "WINDOW_ROWS", limit)
    monkeypatch.setattr(ordering, "SLICE_ROWS", 20)
    rng = random.Random(8)
    sets = {f"s{i}": random_rows(rng, n) for i, n in enumerate([1, 2, 3, 5, 20, 40, 60, 90])}
    rows = [(name, i, *r) for name, part in sets.items() for i, r in enumerate(part)]
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows, "dataset string, line_no long, word1 string, word2 string, score double, distance double"
    )
    found = {r.dataset: (r.rho, r.coverage) for r in rank_correlation(df).collect()}
    for name, part in sets.items():
        rho, coverage = expected(part)
        assert found[name][1] == coverage
        if rho is None:
            assert found[name][0] is None
        else:
            assert found[name][0] == pytest.approx(rho, abs=1.1e-3)


def test_scores_skip_unknown_and_zero_words(spark):
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])],
        "word string, vector array<double>",
    )
    rated = spark.createDataFrame(
        [("s", 0, "a", "b", 9.0), ("s", 1, "a", "c", 1.0), ("s", 2, "b", "c", 2.0),
         ("s", 3, "a", "z", 5.0), ("s", 4, "a", "oov", 5.0), ("s", 5, "a", "a", 10.0)],
        "dataset string, line_no long, word1 string, word2 string, score double",
    )
    row = similarity_scores(rated, vectors).head()
    assert (row.rho, row.coverage) == (1.0, 4)
