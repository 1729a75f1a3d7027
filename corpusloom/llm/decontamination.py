"""Benchmark decontamination by an Aho-Corasick automaton over words.

Every window of consecutive words of a benchmark item is a pattern of one
automaton.  Texts and items are normalised alike (`common.words_of`); each word
of the benchmark is one symbol of the automaton's alphabet and all other words
share a symbol that no pattern has, so a text is scanned once, a symbol a word,
and a hit gives word numbers, which are mapped back to places in the text.

Windows are bounded rows of a table, not items, so an item of any length is
spread over as many automata as it needs; one automaton is held at a time.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import each_text, lookup, map_batches, materialize, row_keys, words_of

# Windows of one automaton; 13 words each stay below the number of code points.
AUTOMATON_WINDOWS = 80_000

# The words of `words_of` in text that is not lower-cased.
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_OTHER = "\x00"

HITS = (
    "row_key1 long, row_key2 long, doc_id long, n_words long, "
    "spans array<struct<first_word:long,n_words:long,start:long,end:long>>, items array<long>"
)
_SPAN = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_HIT_TYPES = [pa.int64()] * 4 + [pa.list_(_SPAN), pa.list_(pa.int64())]
_HIT_NAMES = ["row_key1", "row_key2", "doc_id", "n_words", "spans", "items"]


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct ``(window, item_id)``: the ``n`` consecutive words of items, or all words of shorter ones.

    Items without words, and rows without an item_id, have none.
    """

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owners = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), each_text(batch.column("text"))):
            words = words_of(text)
            own = {b" ".join(words[i : i + n]) for i in range(max(len(words) - n, 0) + 1)} if words else ()
            found.extend(own)
            owners.extend([item] * len(own))
        columns = [pa.array(found, pa.binary()), pa.array(owners, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["window", "item_id"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_batches(items.where("item_id IS NOT NULL"), split, "window binary, item_id long").distinct()


class Automaton:
    """Finds windows in normalised words."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        owners: dict[bytes, list[int]] = {}
        for window, item in rows:
            owners.setdefault(bytes(window), []).append(item)
        self.symbols: dict[bytes, str] = {}
        self.find = ahocorasick.Automaton()
        for window, items in owners.items():
            word_list = window.split()
            self.find.add_word("".join(map(self._symbol, word_list)), (len(word_list), items))
        self.find.make_automaton()

    def _symbol(self, word: bytes) -> str:
        if word not in self.symbols:
            code = len(self.symbols) + 1
            # surrogates are left out
            self.symbols[word] = chr(code if code < 0xD800 else code + 0x800)
        return self.symbols[word]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs (first word, word after the last) that windows cover, and the items."""
        if not self.symbols:
            return [], set()
        get = self.symbols.get
        coded = "".join([get(w, _OTHER) for w in words])
        runs: list[list[int]] = []
        items: set[int] = set()
        for end, (length, owners) in self.find.iter(coded):
            items.update(owners)
            first = end + 1 - length
            # ends never fall, so a run can only grow at its end or swallow the runs before it
            while runs and runs[-1][1] >= first:
                first = min(first, runs.pop()[0])
            runs.append([first, end + 1])
        return [(a, b) for a, b in runs], items


def places(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """The runs with their character offsets in the text."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [
        {"first_word": a, "n_words": b - a, "start": spans[a][0], "end": spans[b - 1][1]} for a, b in runs
    ]


def _scan(docs: DataFrame, rows: list[tuple[bytes, int]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    key = uuid.uuid4().hex

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automaton(key, shared)
        out: list[list] = [[], [], []]
        for text in each_text(batch.column("text")):
            words = words_of(text)
            runs, items = automaton.hits(words)
            out[0].append(len(words))
            out[1].append(places(text.decode(), runs) if runs else [])
            out[2].append(sorted(items))
        keys = [batch.column(c) for c in ("row_key1", "row_key2", "doc_id")]
        columns = keys + [pa.array(c, t) for c, t in zip(out, _HIT_TYPES[3:])]
        return pa.RecordBatch.from_arrays(columns, names=_HIT_NAMES)

    return map_batches(docs, scan, HITS)


_BUILT: dict[str, Automaton] = {}


def _automaton(key: str, shared) -> Automaton:
    """The automaton of a broadcast, built once in each worker process; an older one is let go."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(shared.value)
    return _BUILT[key]


def _merge(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Spans and items that several automata found in one row, joined."""
    spans_out, items_out = [], []
    for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
        merged: list[dict] = []
        for span in sorted(spans, key=lambda s: (s["first_word"], -s["n_words"])):
            last = merged[-1] if merged else None
            if last and span["first_word"] <= last["first_word"] + last["n_words"]:
                end = max(last["first_word"] + last["n_words"], span["first_word"] + span["n_words"])
                last["n_words"] = end - last["first_word"]
                last["end"] = max(last["end"], span["end"])
            else:
                merged.append(dict(span))
        spans_out.append(merged)
        items_out.append(sorted(set(items)))
    columns = [batch.column(c) for c in _HIT_NAMES[:4]]
    columns += [pa.array(spans_out, _HIT_TYPES[4]), pa.array(items_out, _HIT_TYPES[5])]
    return pa.RecordBatch.from_arrays(columns, names=_HIT_NAMES)


def contaminated(df: DataFrame, share: int) -> DataFrame:
    """Add ``n_hit`` and ``contaminated``: at least one in ``share`` words is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["n_words"])
    return df.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    share: int = 20,
    automaton_windows: int = AUTOMATON_WINDOWS,
) -> DataFrame:
    """Passages of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text), a row for each document.

    Returns ``row_key1, row_key2`` (of the row's id and text), ``doc_id, n_words, spans`` (maximal runs of hit words with their
    places in the text), ``items`` (ids of the items found, ascending),
    ``n_hit`` (hit words) and ``contaminated``.  Other columns are ignored.

    A null or empty text has no words and is not contaminated.  Rows that
    repeat a doc_id, or have none, are judged each on its own.  An empty
    benchmark hits nothing; without documents there are no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    rows = rows.select(*row_keys("doc_id", "text"), "doc_id", "text")
    patterns = materialize(windows(benchmark, n), "benchmark-windows")
    automata = max(-(-patterns.count() // automaton_windows), 1)
    if automata == 1:
        return contaminated(_scan(rows, [tuple(r) for r in patterns.collect()]), share)
    block = F.pmod(F.xxhash64("window", "item_id"), F.lit(automata))
    passes = [
        materialize(_scan(rows, [tuple(r) for r in patterns.where(block == b).collect()]), "benchmark-hits")
        for b in range(automata)
    ]
    every = passes[0]
    for other in passes[1:]:
        every = every.unionByName(other)
    # repeated rows share their keys; each automaton has seen each of them
    joined = every.groupBy("row_key1", "row_key2", "doc_id", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        (F.count(F.lit(1)) / automata).cast("int").alias("copies"),
    )
    copied = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return contaminated(map_batches(copied.select(*_HIT_NAMES), _merge, HITS), share)


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = decontaminate(docs, benchmark, n, share)
    keys = ["row_key1", "row_key2"]
    dirty = materialize(found.where("contaminated").select(*keys).distinct(), "contaminated")
    # the row in one column, as its own names may be any
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole
    ).select("row", *row_keys("doc_id", "text"))
    return lookup(keyed, dirty, keys, 16 * dirty.count(), "left_anti").select("row.*")
