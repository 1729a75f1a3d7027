"""Removal of repeated byte strings by suffix arrays of shards.

A string of ``length`` bytes is repeated if it starts anywhere else.  Every
window of that length is dealt out by the smallest hash of the short runs of
bytes in it, so equal windows meet; neighbouring windows mostly have the same
smallest hash and travel as one run of text.  Hashes that only one run has, and
once, which are most, are left behind.  Runs of equal text are one run with a count.

A shard sorts the suffixes of its runs by Larsson-Sadakane refinement, takes the
common prefixes of neighbours by Kasai's rule, all runs at the same time, and
so finds its repeated windows.  A hash with more text than a shard holds has
several shards; they cut their sorted windows at common places and merge the
slices, by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bytes_of, each_text, join_rows, lookup, map_batches, materialize, row_keys, text_parts
from corpusloom.llm.hashing import mix, prefix_hash, run_hash
from corpusloom.operators.skew import hot_rows

# Bytes of the short runs whose smallest hash deals out a window.
GRAM = 32
# Chosen grams of a run that are compared; a run with more is taken to repeat one.
NEAR = 8
# Window starts of a run at most, and bytes that are hashed together.
RUN = 4096
CHUNK = 500_000
# Bytes of a run whose common prefixes follow from one another.
LANE = 16
# Bytes of text of a shard.
SHARD_BYTES = 192_000
# Tables of places are broadcast up to this many bytes.
PLACE_BYTES = 1_000_000

# Shards of a hash whose windows one slice holds, about.
SLICE_SHARDS = 8

# A place holds the number of window starts and the first of them.
_COUNT, _START = 13, 34
# What tells rows apart: rows of equal id and text share it.
_KEYS = ["row_key1", "row_key2"]


def _place(count: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (count << _START) | start


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbouring values."""
    n, blocks = len(values), -(-len(values) // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[: n - width + 1], upto[width - 1 : n])


def _pieces(texts: list[bytes | None], length: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Text in chunks: (row, offset in its text) of each piece, where the pieces end, and the bytes.

    Long texts are cut into pieces that overlap, so each window lies in one.
    """
    held, ends, size, owners = [], [], 0, []
    for row, text in enumerate(texts):
        for at in range(0, max(len(text or b"") - length + 1, 0), CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            held.append(piece)
            owners.append((row, at))
            size += len(piece)
            ends.append(size)
            if size >= CHUNK:
                yield owners, np.array(ends), np.frombuffer(b"".join(held), np.uint8)
                held, ends, size, owners = [], [], 0, []
    if held:
        yield owners, np.array(ends), np.frombuffer(b"".join(held), np.uint8)


def _runs_of(texts: list[bytes | None], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows: least hash, hash of the run's text, row, first window start, number of starts, and
    whether the bytes of the least hash may stand in the run more than once."""
    for owners, ends, data in _pieces(texts, length):
        sums = prefix_hash(data)
        at = np.arange(len(data) - GRAM + 1)
        grams = run_hash(sums, at, at + GRAM)
        width = length - GRAM + 1
        least = _sliding_least(grams, width)
        # grams that are the least of some window
        none = np.zeros(width - 1, dtype=np.uint64)
        chosen = np.flatnonzero(grams == ~_sliding_least(~np.concatenate([none, least, none]), width))
        starts = np.concatenate([[0], ends[:-1]])
        piece = np.searchsorted(ends, np.arange(len(least)), side="right")
        within = np.arange(len(least)) + length <= ends[piece]
        edge = np.ones(len(least) + 1, dtype=bool)
        edge[1:-1] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1]) | (within[1:] != within[:-1])
        first = np.flatnonzero(edge)
        count = np.diff(first)
        first = first[:-1]
        keep = within[first]
        first, count = first[keep], count[keep]
        if (count > RUN).any():
            parts = -(-count // RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, count = np.repeat(first, parts) + nth * RUN, np.repeat(count, parts) - nth * RUN
            count = np.minimum(count, RUN)
        owner = np.array(owners, dtype=np.int64)[piece[first]]
        own = run_hash(sums, first, first + count + length - 1)
        low, high = np.searchsorted(chosen, first), np.searchsorted(chosen, first + count + width - 1)
        times = np.zeros(len(first), dtype=np.int64)
        for k in range(NEAR):
            nth = chosen[np.minimum(low + k, len(chosen) - 1)]
            times += (low + k < high) & (grams[nth] == least[first])
        again = (times > 1) | (high - low > NEAR)
        yield least[first], own, owner[:, 0], first - starts[piece[first]] + owner[:, 1], count, again


def _measure_runs(rows: DataFrame, length: int) -> DataFrame:
    """``least, own, row_key1, row_key2, place, again`` of all runs of windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for at, part in text_parts(batch.column("text")):
            for least, own, row, start, count, again in _runs_of(part, length):
                place = _place(count, start)
                for kept, x in zip(out, (least.view(np.int64), own.view(np.int64), row + at, place, again)):
                    kept.append(x)
        none = [np.zeros(0, dtype=np.int64)]
        least, own, row, place, again = (np.concatenate(x or none) for x in out)
        keys = [batch.column(k).take(pa.array(row)) for k in _KEYS]
        columns = [pa.array(least), pa.array(own), *keys, pa.array(place), pa.array(again.astype(bool))]
        return pa.RecordBatch.from_arrays(columns, names=["least", "own", *_KEYS, "place", "again"])

    schema = "least long, own long, row_key1 long, row_key2 long, place long, again boolean"
    return map_batches(rows.select("text", *_KEYS), run, schema)


# -- suffix arrays


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; beyond the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement.

    Sorted by their first eight bytes, suffixes are in groups that number them.
    Groups of more than one are sorted by the number of the suffix that begins
    where the compared bytes end, which doubles these bytes; others stay.
    """
    n = len(data)
    key = _words(data)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.ones(n, dtype=bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    # suffixes shorter than eight bytes may equal others only by the zeros behind them
    number = np.empty(n + 1, dtype=np.int64)
    number[n] = -1
    slot = np.arange(n)
    number[order] = np.maximum.accumulate(np.where(head, slot, 0))
    done = 8
    single = head & np.append(head[1:], True)
    open_ = slot[~single]
    # the last seven suffixes are told apart by where the text ends, the shorter one first
    while len(open_):
        at = order[open_]
        behind = at + done
        # beyond the end: shorter suffixes come first, as their end is nearer
        second = np.where(behind < n, number[np.minimum(behind, n)] + n, n - 1 - np.minimum(behind - n, n - 1))
        both = number[at].astype(np.uint64) * np.uint64(2 * n + 1) + second.astype(np.uint64)
        again = np.argsort(both, kind="stable")
        order[open_] = at[again]
        both = both[again]
        fresh = np.ones(len(open_), dtype=bool)
        fresh[1:] = both[1:] != both[:-1]
        number[order[open_]] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        alone = fresh & np.append(fresh[1:], True)
        open_ = open_[~alone]
        done *= 2
    return order


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the front of 64-bit numbers."""
    out = np.zeros(len(x), dtype=np.int64)
    for bits in range(56, 0, -8):
        out += x < (np.uint64(1) << np.uint64(bits))
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Bytes, ``most`` at the most, that each suffix in ``order`` shares with the one before it.

    By Kasai's rule a suffix shares at least as many as the suffix one byte
    earlier, less one.  All the runs of text, from ``starts`` to ``ends``, are
    gone through at the same time, a byte each; long ones in parts of `LANE`
    bytes, of which each begins anew.
    """
    n = len(data)
    parts = -(-(ends - starts) // LANE)
    nth_part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, ends = np.repeat(starts, parts) + nth_part * LANE, np.repeat(ends, parts)
    ends = np.minimum(ends, starts + LANE)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    word = np.concatenate([_words(data), np.zeros(most + 16, dtype=np.uint64)])
    out = np.zeros(n, dtype=np.int64)
    falling = np.argsort(starts - ends, kind="stable")
    starts, sizes = starts[falling], (ends - starts)[falling]
    shared = np.zeros(len(starts), dtype=np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        active = np.searchsorted(-sizes, -t, side="left")
        at = starts[:active] + t
        nth = place[at]
        before = order[np.maximum(nth - 1, 0)]
        have = np.maximum(shared[:active] - 1, 0)
        limit = np.minimum(most, n - np.maximum(at, before))
        going = np.flatnonzero((nth > 0) & (have < limit))
        while len(going):
            a, b = word[at[going] + have[going]], word[before[going] + have[going]]
            differ = a ^ b
            same = differ == 0
            have[going[same]] += 8
            left = going[~same]
            if len(left):
                have[left] += _leading_zero_bytes(differ[~same])
            going = going[same]
            going = going[have[going] < limit[going]]
        have = np.where(nth > 0, np.minimum(have, limit), 0)
        out[nth] = have
        shared[:active] = have
    return out


def repeated_starts(texts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """Which of the first ``counts`` windows of each text start in another place of these texts too."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    order = suffix_array(data)
    group = np.cumsum(common_prefixes(data, order, starts, ends, length) < length)
    # suffixes that are no window's start reach into the next text and do not count
    is_start = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(is_start, starts, 1)
    np.add.at(is_start, starts + np.array(counts), -1)
    is_start = np.cumsum(is_start)[:-1] > 0
    of = np.empty(len(data), dtype=np.int64)
    of[order] = group
    members = np.bincount(group[is_start[order]], minlength=int(group[-1]) + 1 if len(group) else 0)
    repeated = members[of] > 1
    return [repeated[s : s + c] for s, c in zip(starts, counts)]


def _spans(repeated: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(repeated.astype(np.int8), prepend=0, append=0))
    return [{"first": int(a), "after": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_SPAN = pa.struct([("first", pa.int64()), ("after", pa.int64())])
_SHARD = "least long, own long, shard long, shards long, spans array<struct<first:long,after:long>>, prints binary"


def _window_prints(text: bytes, count: int, length: int) -> np.ndarray:
    """128-bit prints of the windows of a run, as two columns."""
    data = np.frombuffer(text, np.uint8)
    at = np.arange(count)
    sums = prefix_hash(data)
    one = run_hash(sums, at, at + length // 2)
    two = run_hash(sums, at + length // 2, at + length)
    return np.stack([mix(one ^ (two * np.uint64(3))), mix(two + one * np.uint64(5))], axis=1)


def _sort_shard(length: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        found = repeated_starts([r["run"] for r in rows], [r["starts"] for r in rows], length)
        out: list[list] = [[], [], [], [], [], []]
        for r, repeated in zip(rows, found):
            if r["copies"] > 1:
                repeated = np.ones(r["starts"], dtype=bool)
            # other shards of the same hash may hold the same windows
            prints = _window_prints(r["run"], r["starts"], length).tobytes() if r["shards"] > 1 else None
            row = (r["least"], r["own"], r["shard"], r["shards"], _spans(repeated), prints)
            for kept, x in zip(out, row):
                kept.append(x)
        types = [pa.int64()] * 4 + [pa.list_(_SPAN), pa.binary()]
        names = ["least", "own", "shard", "shards", "spans", "prints"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return run


_PRINT = np.dtype([("a", "<u8"), ("b", "<u8")])


def _sorted_prints(packed: list[bytes]) -> np.ndarray:
    every = np.frombuffer(b"".join(packed), _PRINT)
    return np.unique(every)


def _cut_slices(group: pa.Table) -> pa.Table:
    """A shard's sorted windows, cut at common places into a slice for each `SLICE_SHARDS` shards of the hash.

    Empty slices are left out, so there are never more of them than windows.
    """
    prints = _sorted_prints([p for p in group.column("prints").to_pylist()])
    shards = group.column("shards")[0].as_py()
    slices = -(-shards // SLICE_SHARDS)
    # the slice of a window follows from the high bits of its print, in their order
    of = (prints["a"] >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    first = np.flatnonzero(np.diff(of, prepend=of[:1] + np.uint64(1))) if len(of) else np.zeros(0, dtype=np.int64)
    parts = [prints[a:b].tobytes() for a, b in zip(first, [*first[1:], len(prints)])]
    columns = [
        pa.array([group.column("least")[0].as_py()] * len(parts), pa.int64()),
        pa.array([group.column("shard")[0].as_py()] * len(parts), pa.int64()),
        pa.array(of[first].astype(np.int64)),
        pa.array(parts, pa.binary()),
    ]
    return pa.Table.from_arrays(columns, names=["least", "shard", "slice", "prints"])


def _merge_slices(group: pa.Table) -> pa.Table:
    """For each shard the windows of a slice that another shard has as well."""
    slices = [np.frombuffer(p, _PRINT) for p in group.column("prints").to_pylist()]
    every = np.sort(np.concatenate(slices))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    shared = []
    for own in slices:
        at = np.searchsorted(twice, own)
        hit = np.zeros(len(own), dtype=bool)
        inside = at < len(twice)
        hit[inside] = twice[at[inside]] == own[inside]
        shared.append(own[hit].tobytes())
    columns = [group.column("least"), group.column("shard"), pa.array(shared, pa.binary())]
    return pa.Table.from_arrays(columns, names=["least", "shard", "shared"])


def _mark_shared(group: pa.Table) -> pa.Table:
    """The runs of a shard with the windows that other shards have added to their own."""
    rows = group.to_pylist()
    shared = _sorted_prints([r["shared"] for r in rows if r["shared"]])
    out: list[list] = [[], [], []]
    for r in rows:
        if r["prints"] is None:
            continue
        own = np.frombuffer(r["prints"], _PRINT)
        at = np.searchsorted(shared, own)
        hit = np.zeros(len(own), dtype=bool)
        inside = at < len(shared)
        hit[inside] = shared[at[inside]] == own[inside]
        for span in r["spans"]:
            hit[span["first"] : span["after"]] = True
        for kept, x in zip(out, (r["least"], r["own"], _spans(hit))):
            kept.append(x)
    types = [pa.int64(), pa.int64(), pa.list_(_SPAN)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["least", "own", "spans"])


def _run_texts(rows: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """Each kind of run with its text, read from the row where it stands first."""
    wanted = materialize(
        kinds.groupBy(*[F.col(f"at.{k}").alias(k) for k in _KEYS]).agg(
            F.collect_list(F.struct("least", "own", "copies", "starts", "first", "shard", "shards")).alias("runs")
        ),
        "run-places",
    )
    size = bytes_of(wanted)[1] + 56 * (wanted.agg(F.sum(F.size("runs"))).first()[0] or 0)
    # a repeated row holds the same text: one of them is enough
    texts = join_rows(rows, wanted, _KEYS, size, "inner", PLACE_BYTES)
    names = ["least", "own", "copies", "starts", "shard", "shards"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        found = []
        for text, runs in zip(each_text(batch.column("text")), batch.column("runs").to_pylist()):
            for r in runs:
                for kept, name in zip(out, names):
                    kept.append(r[name])
                found.append(text[r["first"] : r["first"] + r["starts"] + length - 1])
        columns = [pa.array(c, pa.int64()) for c in out] + [pa.array(found, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "run"])

    schema = ", ".join(f"{n} long" for n in names) + ", run binary"
    return map_batches(texts.select("text", "runs"), run, schema)


def repeated_spans(rows: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """``row_key1, row_key2, spans`` of the rows in which bytes are covered by repeated windows."""
    runs = materialize(_measure_runs(rows, length), "runs")
    twice = materialize(
        runs.groupBy("least")
        .agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
        .where("n > 1 OR again")
        .select("least", "n"),
        "repeated-hashes",
    )
    facts = twice.agg(F.count(F.lit(1)), F.sum("n")).first()
    hot = hot_rows(twice, "n", facts[1] or 0)
    again = lookup(runs, twice.drop("n"), ["least"], 8 * facts[0], "inner", PLACE_BYTES, hot)
    again = materialize(
        again.select(
            "least",
            "own",
            *_KEYS,
            F.shiftrightunsigned("place", _START).bitwiseAND((1 << _COUNT) - 1).alias("starts"),
            F.col("place").bitwiseAND((1 << _START) - 1).alias("first"),
        ),
        "repeated-runs",
    )
    kinds = again.groupBy("least", "own").agg(
        F.count(F.lit(1)).alias("copies"),
        F.first("starts").alias("starts"),
        F.min(F.struct(*_KEYS, "first")).alias("at"),
    )
    kinds = materialize(kinds.withColumn("first", F.col("at.first")), "run-kinds")
    # a hash with more text than a shard holds has several shards
    text = F.sum(F.col("starts") + (length - 1))
    large = kinds.groupBy("least").agg(text.alias("bytes")).where(F.col("bytes") > shard_bytes)
    large = materialize(large.select("least", F.ceil(F.col("bytes") / shard_bytes).cast("long").alias("shards")), "large-hashes")
    total = kinds.agg(text).first()[0] or 0
    groups = max(int(total // shard_bytes), 1)
    dealt = lookup(kinds, large, ["least"], 16 * large.count())
    dealt = dealt.withColumn("shards", F.coalesce("shards", F.lit(1).cast("long")))
    dealt = dealt.withColumn(
        "shard",
        F.when(F.col("shards") > 1, F.pmod(F.xxhash64("own"), F.col("shards")))
        .otherwise(F.pmod(F.xxhash64("least"), F.lit(groups)))
        .cast("long"),
    )
    shards = _run_texts(rows, dealt, length).withColumn(
        "of", F.when(F.col("shards") > 1, F.col("least")).otherwise(F.lit(0))
    )
    # equal rows repeated in the input give the same run twice
    sorted_ = materialize(
        shards.groupBy("of", "shards", "shard").applyInArrow(_unique_runs(_sort_shard(length)), _SHARD),
        "sorted-shards",
    )
    split = sorted_.where("shards > 1")
    marked = sorted_.where("shards = 1").select("least", "own", "spans")
    if not split.isEmpty():
        slices = split.groupBy("least", "shard").applyInArrow(_cut_slices, "least long, shard long, slice long, prints binary")
        shared = slices.groupBy("least", "slice").applyInArrow(_merge_slices, "least long, shard long, shared binary")
        both = split.select("least", "shard", "own", "spans", "prints", F.lit(None).cast("binary").alias("shared")).unionByName(
            shared.select(
                "least",
                "shard",
                F.lit(None).cast("long").alias("own"),
                F.lit(None).cast("array<struct<first:long,after:long>>").alias("spans"),
                F.lit(None).cast("binary").alias("prints"),
                "shared",
            )
        )
        merged = both.groupBy("least", "shard").applyInArrow(
            _mark_shared, "least long, own long, spans array<struct<first:long,after:long>>"
        )
        marked = marked.unionByName(merged)
    marked = materialize(marked.where(F.size("spans") > 0), "marked-runs")
    size = 24 * marked.count() + 32 * (marked.agg(F.sum(F.size("spans"))).first()[0] or 0)
    hot = hot_rows(kinds, "copies", kinds.agg(F.sum("copies")).first()[0] or 0)
    placed = lookup(again, marked, ["least", "own"], size, "inner", PLACE_BYTES, hot)
    spans = F.transform(
        "spans",
        lambda s: F.struct(
            (F.col("first") + s["first"]).alias("start"), (F.col("first") + s["after"] + (length - 1)).alias("end")
        ),
    )
    each = placed.select(*_KEYS, spans.alias("spans"))
    return materialize(
        each.groupBy(*_KEYS).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")), "spans"
    )


def _unique_runs(function):
    """The group without runs that came twice, from repeated rows."""

    def run(group: pa.Table) -> pa.Table:
        seen, keep = set(), []
        for i, key in enumerate(zip(group.column("least").to_pylist(), group.column("own").to_pylist())):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        return function(group.take(pa.array(keep)))

    return run


_BYTES = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def remove_repeats(docs: DataFrame, length: int = 200, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every document without the bytes covered by repeated strings of ``length`` bytes.

    Returns ``doc_id, n_bytes, spans`` (maximal removed runs of bytes, in order)
    and ``kept`` (the other bytes, concatenated; a character may be cut).
    All strings are judged on the input, overlapping ones count, and none
    reaches over the end of a document.

    Null and empty texts, and texts shorter than ``length``, keep all they
    have.  Repeated rows are documents of their own and so repeat each other;
    rows may share a doc_id or have none.  Other columns are ignored; an empty
    table gives no rows.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be more than {GRAM}")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.select("doc_id", "text", *row_keys("doc_id", "text"))
    spans = repeated_spans(rows.drop("doc_id"), length, shard_bytes)
    size = bytes_of(spans)[1] + 24 * (spans.agg(F.sum(F.size("spans"))).first()[0] or 0)
    marked = join_rows(rows, spans, _KEYS, size, "left", PLACE_BYTES)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, kept = [], [], []
        for text, found in zip(each_text(batch.column("text")), batch.column("spans").to_pylist()):
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in found or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            sizes.append(len(text))
            removed.append([{"start": a, "end": b} for a, b in merged])
            cuts = [0, *[x for s in merged for x in s], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if merged else text)
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(_BYTES)), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])

    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return map_batches(marked.select("doc_id", "text", "spans"), run, schema)
