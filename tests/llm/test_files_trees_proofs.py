"""Token files, cover trees and the Merkle manifest against plain restatements, rows of odd kinds among them."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import hard_negatives, manifest, token_files
from corpusloom.llm.queries import QUERIES
from corpusloom.scratch import new_path

SMALL = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
EXTRA = "1 AS at, 2 AS n, 3 AS shard, 4 AS start, 5 AS first, 6 AS pos, 7 AS node, 8 AS grp, 9 AS path, 10 AS `a.b`".split(", ")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(TOKENIZER)


# -- token files


@pytest.mark.parametrize("width", range(1, 33))
def test_blocks_round_trip(width):
    ids = np.array([random.Random(width * 7 + i).randrange(1 << width) for i in range(9000)], dtype=np.uint32)
    offsets, data = token_files.pack_blocks(ids, width)
    for at, count in [(0, 9000), (1, 8999), (4095, 2), (4096, 10), (8999, 1), (17, 3), (3, 0)]:
        assert (token_files.read_blocks(offsets, data, width, 9000, at, count) == ids[at : at + count]).all()


def test_width():
    assert [token_files.bit_width(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        token_files.pack_ids(np.array([4], dtype=np.uint32), 2)


def test_pieces_have_the_ids_of_whole_texts(plain, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 300)
    ids_of, draw = token_files.TokenizerIds(TOKENIZER), random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\n\n", "\t", "a", "Z", "é", "ß", "'s", "'", "1", "22", ".", ",", "...", "!?", ":", "<|endoftext|>",
             "<|endoftext", "\xa0", "　", "​", "\x1c", "\x85", "中", "😀", "word", "The", "_", "́", "\x00", ".\n", "x.\nY"]
    for _ in range(300):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(20)] + [None]
        for text, ids in zip(texts, ids_of(pa.array(texts)), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


ROWS = [
    (5, "one text"), (5, "one text"), (5, "another text"), (1, None), (2, ""), (None, "without an id"), (None, None),
    (-3, "long words here. " * 9000), (9, "ünï 日本語 <|endoftext|> \n x"), (7, " "),
]


def brute_tokens(plain, rows):
    """Rows of (doc_id, start, n_tokens, crc), those of one doc_id in any order."""
    out, start = [], 0
    ids = [(doc, [*plain.encode(text or "", add_special_tokens=False).ids, 0]) for doc, text in rows]
    for doc, own in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((doc, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
        start += len(own)
    return out, start


@pytest.mark.parametrize("shard_bytes,segment", [(64_000_000, 1 << 20), (40, 3), (20_000, 100)])
def test_files_hold_every_document(spark, plain, monkeypatch, shard_bytes, segment):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", *EXTRA).repartition(3)
    path = new_path(spark, "token-files")
    token_files.write_token_files(docs, path, TOKENIZER, shard_bytes=shard_bytes)
    got = token_files.read_documents(spark, path, with_ids=True).collect()
    want, total = brute_tokens(plain, ROWS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, n, c) for d, _, n, c in want)
    # gapless, in the order of doc_id, nulls first
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert [r["doc_id"] for r in got] == [d for d, *_ in want]
    whole = np.frombuffer(b"".join(bytes(r["ids"]) for r in got), "<u4")
    assert len(whole) == total
    for first, count in [(0, 5), (total - 2, 10), (1000, 9000), (total, 1), (3, 0)]:
        places = token_files.read_places(spark, path, first, count).orderBy("position").collect()
        assert [r["position"] for r in places] == list(range(first, min(first + count, total)))
        assert [r["id"] for r in places] == whole[first : first + count].tolist()


def test_empty_tables_make_empty_files(spark):
    path = new_path(spark, "token-files")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, TOKENIZER)
    assert token_files.read_documents(spark, path).count() == 0
    assert token_files.read_places(spark, path, 0, 9).count() == 0


def test_query_equals_the_tokenizer(spark, plain):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute_tokens(plain, [tuple(r) for r in rows])
    assert sorted(map(tuple, QUERIES["op11_token_files"](spark, SMALL).collect())) == sorted(want)


# -- hard negatives


def brute_negatives(rows, anchors, positives=5, negatives=5, scale=256):
    usable = lambda r: None not in r and all(x is not None and np.isfinite(x) for x in r[1])
    whole = lambda v: [int(np.floor(scale * x)) for x in v]
    limit = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    rows = [(i, whole(v), c) for i, v, c in filter(usable, rows)]
    asked = {(i, tuple(whole(v)), c) for i, v, c in filter(usable, anchors)}
    out = []
    for i, v, c in asked:
        scored = [(limit(sum(a * b for a, b in zip(v, w))), j, d) for j, w, d in rows if j != i and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, d in [s for s in scored if s[2] == c][:positives]:
            hard = [s for s in scored if s[2] != c and 80 * p <= 100 * s[0] <= 100 * p][:negatives]
            out += [(i, j, rank + 1, n, p, s) for rank, (s, n, _) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    kind = "vec_id long, embedding array<double>, label int"
    tables = [spark.createDataFrame(r, kind).selectExpr("*", *EXTRA) for r in (rows, anchors)]
    return sorted(map(tuple, hard_negatives.mine_negatives(*tables, **options).collect()))


def clustered(seed, n, dim=4, spread=0.1):
    draw = np.random.default_rng(seed)
    heads = draw.normal(size=(6, dim))
    return [(i, (heads[i % 6] + spread * draw.normal(size=dim)).tolist(), int(draw.integers(3))) for i in range(n)]


@pytest.mark.parametrize("tree_rows", [7, 40, 4096])
def test_negatives_equal_brute_force(spark, tree_rows):
    rows = clustered(1, 400)
    anchors = rows[::10]
    got = mined(spark, rows, anchors, tree_rows=tree_rows, block_anchors=16)
    assert got == brute_negatives(rows, anchors) and len(got) > 100


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [
        (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, [0.5, 0.5], 2), (4, [0.5, 0.5], 2), (4, [0.5, 0.5], 2), (5, [0.4, 0.5], 2),
        (1, [0.1, 0.7], 1), (1, [0.1, 0.7], 2), (6, [0.3], 1), (7, [0.3], 1), (8, [0.29], 2), (9, [], 1), (10, [], 1), (11, [], 2),
        (12, None, 1), (13, [1.0, None], 1), (14, [nan, 1.0], 1), (15, [float("inf"), 1.0], 1), (16, [1.0, 1.0], None),
        (None, [1.0, 1.0], 1), (17, [1e9, 2e9], 1), (18, [1e9, 2e9], 1), (19, [1e9, 1.9e9], 2), (20, [1e300, 1e300], 2),
        (21, [-1e300, 1e300], 1), (22, [0.0, 0.0], 2), (23, [-0.5, -0.5], 3), (24, [-0.5, -0.5], 3), (25, [-0.45, -0.5], 2),
    ]
    got = mined(spark, rows, rows + rows[:3])
    assert got == brute_negatives(rows, rows)
    assert mined(spark, [], rows) == mined(spark, rows, []) == []


def test_many_equal_vectors(spark):
    rows = [(i, [0.25, -0.5, 1.0], i % 2) for i in range(300)]
    assert mined(spark, rows, rows[:4], tree_rows=100) == brute_negatives(rows, rows[:4])


def test_tree_covers_and_skips():
    rows = clustered(2, 3000, dim=6, spread=0.02)
    vectors = np.floor(256 * np.array([r[1] for r in rows]))
    labels = np.array([str(i % 6) for i in range(len(rows))], dtype=object)
    tree = hard_negatives.CoverTree.build(np.arange(len(rows)), labels, vectors)
    assert sorted(tree.ids) == list(range(len(rows)))
    for centre, radius, (low, high) in zip(tree.centres, tree.radii, tree.members):
        apart = np.linalg.norm(tree.vectors[low:high] - tree.vectors[centre], axis=1)
        assert low <= centre < high and apart.max() <= radius + 1e-6
    everywhere = np.full((6, 1), -(1 << 62)), np.full((6, 1), 1 << 62)
    asked = hard_negatives.Asked(np.arange(6), labels[:6], vectors[:6], *everywhere, True, 5)
    best, scored = hard_negatives.search(tree, asked)
    product = vectors[:6] @ vectors.T
    for i in range(6):
        own = sorted((-product[i, j], j) for j in range(len(rows)) if j != i and labels[j] == labels[i])[:5]
        assert [(-s, j) for s, j in zip(best.score[best.window == i], best.id[best.window == i])] == own
    assert scored < len(rows) * 6 / 3


# -- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    """Levels of a tree, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_manifest(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0], sha(*map(field, row)), sha(*map(field, changed(row)))))
    trees = {}
    for lang, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = climbed([leaf for _, leaf, _ in own])
    names = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    top = climbed([trees[lang][-1][0] for lang in names])
    out = []
    for at, lang in enumerate(names):
        for pos, (doc, leaf, claimed) in enumerate(groups[lang]):
            siblings, node = [], claimed
            for levels, i in ((trees[lang], pos), (top, at)):
                for level in levels[:-1]:
                    other = level[i ^ 1] if i ^ 1 < len(level) else ""
                    node = sha(other, node) if i % 2 else sha(node, other)
                    siblings.append(other)
                    i //= 2
            out.append((doc, leaf, trees[lang][-1][0], top[-1][0], sha(*siblings), node))
    return sorted(out, key=repr)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
KIND = "doc_id long, source string, lang string, n_chars long, text string"


def of_manifest(spark, rows):
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", *EXTRA).repartition(3)
    more = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    found = manifest.manifest(docs, FIELDS, "lang", changed={"n_chars": more})
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)
    found = found.select("doc_id", "leaf", "subroot", "root", proof, manifest.fold(F.col("claimed"), F.col("path")))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def changed(row):
    doc, source, lang, n, text = row
    return (doc, source, lang, n + 1 if n is not None and doc is not None and doc % 3 == 0 else n, text)


@pytest.mark.parametrize("sizes", [(1,), (2, 1, 3), (4, 5, 16, 17), (70, 1, 33, 4), (64,), (257, 2)])
def test_trees_of_many_blocks(spark, monkeypatch, sizes):
    monkeypatch.setattr(manifest, "BLOCK", 4)
    monkeypatch.setattr(manifest, "LEVELS", 2)
    rows = [(i, "s", f"l{g}", i % 9, f"text {i}") for g, n in enumerate(sizes) for i in range(n)]
    assert of_manifest(spark, rows) == brute_manifest(rows, changed)


def test_rows_of_odd_kinds(spark):
    rows = [
        (3, "a", None, 5, "x"), (3, "a", None, 5, "x"), (3, "a", None, 6, "x"), (None, None, None, None, None), (None, "b", "en", 1, ""),
        (6, "b", "", (1 << 63) - 1, "y"), (9, "b", "en", None, "long text " * 20_000), (12, "ü", "日本", 0, "\n"), (-3, "-", "-", -1, "-"),
        (15, "1:a", "en", 2, "2:a"), (18, "a", "z\U0001f600", 1, "t"), (21, "a", "z￿", 1, "t"),
    ]
    got = of_manifest(spark, rows)
    assert got == brute_manifest(rows, changed)
    assert len({r[3] for r in got}) == 1
    for doc, *_, root, _, folded in got:
        row = [r for r in rows if r[0] == doc]
        assert (folded == root) == (changed(row[0]) == row[0])
    assert of_manifest(spark, []) == []


# -- languages of pages without evidence


def test_pages_without_evidence_have_the_overall_prior(spark):
    """90 English and 10 Spanish pages; one page has nothing, one a suffix that no other page has."""
    from corpusloom.llm.language_id import identify_languages

    texts = {"en": "the house and the street where they are living with the other people", "es": "la casa y la calle donde viven con las otras personas del barrio"}
    docs = spark.createDataFrame(list(texts.items()) * 5, "lang string, text string")
    rows = [(i, f"http://h{i % 7}.example.com/x", f"<p>{texts['en' if i < 90 else 'es']}</p>") for i in range(100)]
    rows += [(100, None, None), (101, "http://a.xyz/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in identify_languages(pages, docs).collect()}
    assert [found[i]["lang"] for i in range(100)] == ["en"] * 90 + ["es"] * 10
    for page in (100, 101):
        assert found[page]["lang"] == "en" and abs(found[page]["probability"] - 0.89) < 0.02


def test_batches_are_met_in_parts(monkeypatch):
    """Small batches are cut together, up to PART_BYTES, and none of their rows is lost or moved."""
    monkeypatch.setattr(token_files, "PART_BYTES", 200)
    texts = [None if i % 7 == 0 else "x" * (i % 50) for i in range(60)]
    rows = pa.record_batch([pa.array(range(60), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    batches = [rows.slice(i, 4) for i in range(0, 60, 4)]
    parts = list(token_files._parts(iter(batches)))
    assert 1 < len(parts) < len(batches)
    assert [d for doc_ids, _ in parts for d in doc_ids] == list(range(60))
    assert [t for _, found in parts for t in found.to_pylist()] == texts
    assert not list(token_files._parts(iter([])))


def test_pieces_are_learned_some_at_a_time(plain, monkeypatch):
    monkeypatch.setattr(token_files, "LEARNED", 3)
    texts = ["one two, three. four\nfive", "two, six x.y 7 é ünï", "one"]
    found = token_files.TokenizerIds(TOKENIZER)(pa.array(texts))
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
