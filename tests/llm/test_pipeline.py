"""Stages of the pipeline against plain restatements, each on what its predecessor kept."""

import itertools
import re

import pytest

import corpus_pipeline
from corpusloom.llm.common import materialize
from corpusloom.llm.quality import document_scores, fit_quality

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage, the documents first."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SMALL), "stage")
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def test_quality(spark, kept):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    score, _ = document_scores(fit_quality(docs, labels), [r["text"].encode() for r in kept[0]])
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(r["doc_id"] for r, s in zip(kept[0], score) if s >= 0.3)


def test_near_duplicates(kept):
    sets = {}
    for r in kept[1]:
        words = re.findall("[^\x20\x09-\x0d]+", r["text"].translate({c: c + 32 for c in range(65, 91)}))
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 5, 0) + 1)} if words else set()
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted(r["doc_id"] for r in kept[2]) == sorted(i for i in sets if label[i] == i)


def test_decontamination(spark, kept):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = split(r["text"])
        windows |= {tuple(words[i : i + 13]) for i in range(max(len(words) - 13, 0) + 1)} if words else set()
    clean = []
    for r in kept[2]:
        words, hit = split(r["text"]), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(words):
            clean.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in kept[3]) == sorted(clean) != sorted(r["doc_id"] for r in kept[2])


def test_secrets(kept):
    before = {r["doc_id"]: r for r in kept[3]}
    assert sorted(before) == sorted(r["doc_id"] for r in kept[4])
    for r in kept[4]:
        plain = re.sub(r'AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}', "[SECRET]", before[r["doc_id"]]["text"])
        assert r["text"] == plain
        assert r["n_chars"] == (len(plain) if plain != before[r["doc_id"]]["text"] else before[r["doc_id"]]["n_chars"])


def test_packing(kept):
    assert {r["doc_id"] for r in kept[5]} == {r["doc_id"] for r in kept[4]}
    total = {r["doc_id"]: r["doc_tokens"] for r in kept[5]}
    assert sum(r["length"] for r in kept[5]) == sum(total.values())


def test_run_is_the_stages(spark, kept):
    assert corpus_pipeline.run(spark, SMALL).count() == len(kept[5])
