"""Exact Jaccard join of shingle sets with signature trees.

1. Every document's set of shingles is hashed; documents of equal sets are one
   class, named by its smallest id.
2. Similar sets share several of their smallest hashes.  Classes of which
   too many of these occur in no other class are similar to none; for the
   others, which are few, all shingles are counted.
3. Similar sets share a shingle among their first few, in an order that puts
   rare shingles first (prefix filter).  Classes that share one are put in one
   cluster.
4. Clusters are cut into blocks of bounded size.  In a block, or a pair of
   blocks, a signature tree is built: its nodes hold the OR of their members'
   bitmaps and the range of their sizes.  Two trees are walked together, and a
   pair of nodes is left out when their greatest possible overlap is below what
   their sizes need, or when all their members are linked already.  What is
   left is compared exactly, by the shingles that any two classes share.
5. Links are joined into components.  Pairs within a component need not be
   compared, so only blocks whose members are not yet all linked meet in pairs.

Nothing is sampled or capped: a cluster of any size is a number of block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bytes_of, join_rows, lookup, map_batches, map_stream, materialize, row_keys, text_parts
from corpusloom.llm.components import connected
from corpusloom.llm.hashing import mix, prefix_hash, run_hash
from corpusloom.operators.ordering import dense_ids, slices_for
from corpusloom.operators.skew import hot_rows

# Smallest hashes that are counted beyond those that the prefix filter needs, in hundredths of a set.
EXTRA = 5
# Tables of candidates, and of their shingles, are broadcast up to this many bytes.
CANDIDATE_BYTES, SHINGLE_BYTES = 4_000_000, 500_000
# Shingles of a block.
BLOCK_SHINGLES = 16_384
# Members that stand in every block of a cluster in the first round.
PIVOTS = 6
# Members, or nodes, under a node of a signature tree.
FAN = 8
# Pairs of nodes that are looked at together.
FRONTIER = 16_384

# Word bytes: all but space and 0x09-0x0D; A-Z lower-cased.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = mix(np.arange(101, 116, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Sets of ``n``-word shingles are linked from ``percent`` hundredths of Jaccard similarity on."""

    n: int = 4
    percent: int = 85

    def prefix(self, size):
        """How many first shingles of a set of ``size`` must be looked at for one that a similar set shares."""
        return size - (self.percent * size + 99) // 100 + 1

    def smallest(self, size):
        """How many smallest hashes of a set are counted."""
        return np.minimum(self.prefix(size) + EXTRA * size // 100, size)

    def shared(self, size: Column) -> tuple[Column, Column]:
        """Smallest hashes that are counted, and how many of them a similar set shares at least.

        A similar set may be smaller, by the similarity; the smaller one of
        both tells how many they share.
        """
        least = F.floor((size * self.percent + 99) / 100)
        counted = F.least(size - least + 1 + F.floor(size * EXTRA / 100), size)
        return counted, F.floor(least * EXTRA / 100) + 1

    def links(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)

    def needed(self, a, b):
        """Smallest overlap, as a real number, of linked sets of sizes ``a`` and ``b``."""
        return self.percent * (a + b) / (100 + self.percent)


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The set of each text as ascending 64-bit hashes; empty without words."""
    whole = b"\n".join([(t or b"").translate(_LOWER) for t in texts]) + b"\n"
    data = np.frombuffer(whole, np.uint8)
    solid = ~_GAP[data]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = run_hash(prefix_hash(data), first, after)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    upto = np.searchsorted(first, ends)
    shingle = np.full(max(len(word) - n + 1, 0), n, dtype=np.uint64)
    for i in range(n):
        shingle += word[i : i + len(shingle)] * _PLACE[i]
    shingle = mix(shingle)
    sets, low = [], 0
    for high in upto:
        if high - low >= n:
            sets.append(np.unique(shingle[low : high - n + 1]))
        elif high > low:
            short = np.uint64(high - low) + (word[low:high] * _PLACE[: high - low]).sum(dtype=np.uint64)
            sets.append(mix(np.array([short], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        low = high
    return sets


def _digests(s: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set, as two signed numbers."""
    one = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    two = mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(np.uint64(one).view(np.int64)), int(np.uint64(two).view(np.int64))


def _measure(rows: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n, d1, d2, smallest``: size and digest of each document's set, and its smallest hashes."""
    names = ["doc_id", "n", "d1", "d2", "smallest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_parts(batch.column("text")):
                sets = shingle_sets(texts, rule.n)
                digests = [_digests(s) for s in sets]
                columns = [
                    batch.column("doc_id").slice(at, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    _lists([s[: int(rule.smallest(np.int64(len(s))))] for s in sets]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_stream(rows, run, "doc_id long, n long, d1 long, d2 long, smallest array<long>")


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    """Sets of hashes as lists of signed numbers."""
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _candidates(measured: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Classes of which enough smallest hashes are those of other classes too."""
    tokens = measured.where("doc_id IS NOT NULL AND n > 0").select(F.explode("smallest").alias("token"), "d1")
    own = tokens.groupBy("token").agg(F.min("d1").alias("d1"), F.max("d1").alias("other")).where("d1 = other")
    alone = own.groupBy("d1").agg(F.count(F.lit(1)).alias("alone"))
    counted, shared = rule.shared(F.col("n"))
    joined = classes.drop("copies").join(alone, "d1", "left")
    return joined.where(counted - F.coalesce("alone", F.lit(0)) >= shared).select(
        F.col("class_id").alias("doc_id"), "n", "d1", "d2"
    )


def _members(rows: DataFrame, candidates: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n, shingles`` (those that other candidates have) ``, firsts`` (those of the prefix filter)."""
    wanted = materialize(candidates, "candidates")
    texts = join_rows(rows, wanted, ["doc_id"], 32 * wanted.count(), "inner", CANDIDATE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("d1", "d2"))
            for at, part in text_parts(batch.column("text")):
                sets = shingle_sets(part, rule.n)
                # rows may share an id; only that of the class counts
                own = [i for i, s in enumerate(sets) if _digests(s) == (one[at + i], two[at + i])]
                if own:
                    owner = np.repeat([at + i for i in own], [len(sets[i]) for i in own])
                    token = np.concatenate([sets[i] for i in own]).view(np.int64)
                    columns = [pa.array(token), batch.column("doc_id").take(pa.array(owner))]
                    yield pa.RecordBatch.from_arrays(columns, names=["token", "doc_id"])

    tokens = map_stream(texts.select("doc_id", "text", "d1", "d2"), run, "token long, doc_id long")
    tokens = materialize(tokens, "shingles")
    numbers = tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    )
    numbers = materialize(numbers.where("low < high").select("token", "docs"), "shared-shingles")
    facts = numbers.agg(F.count(F.lit(1)), F.sum("docs")).first()
    hot = hot_rows(numbers, "docs", facts[1] or 0)
    shared = lookup(tokens, numbers, ["token"], 16 * facts[0], "inner", SHINGLE_BYTES, hot)
    # a row for each document; its shingles are no more than its text
    own = shared.groupBy("doc_id").agg(F.collect_set(F.struct("docs", "token")).alias("own"))
    own = own.join(wanted.select("doc_id", "n"), "doc_id")

    def order(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, firsts = [], []
        flat = batch.column("own").flatten()
        docs, token = (flat.field(i).to_numpy() for i in (0, 1))
        ends = np.cumsum([len(x) for x in batch.column("own")])
        for low, high, n in zip([0, *ends[:-1]], ends, batch.column("n").to_pylist()):
            s, d = token[low:high].view(np.uint64), docs[low:high]
            shingles.append(np.sort(s).tobytes())
            # shingles that no other candidate has come before all of these
            rest = max(int(rule.prefix(n)) - (n - len(s)), 0)
            firsts.append(s[np.lexsort((s, d))[:rest]])
        columns = [batch.column("doc_id"), batch.column("n"), pa.array(shingles, pa.binary()), _lists(firsts)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "shingles", "firsts"])

    ordered = map_batches(own.select("doc_id", "n", "own"), order, "doc_id long, n long, shingles binary, firsts array<long>")
    return materialize(ordered.where("size(firsts) > 0"), "members")


# -- signature trees


class Tree:
    """Levels of nodes over sets, of which ``sets`` has some shingles and ``sizes`` the number of all.

    The first level is the sets themselves.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, width: int):
        # neighbours in the order of their smallest hashes are likely to be alike
        keys = np.array([[s[0], s[min(1, len(s) - 1)]] for s in sets], dtype=np.uint64)
        self.order = np.lexsort((keys[:, 1], keys[:, 0]))
        size = sizes[self.order]
        bits = np.zeros((len(sets), width // 64), dtype=np.uint64)
        mask = np.uint64(width - 1)
        for row, i in enumerate(self.order):
            at = (sets[i] >> np.uint64(20)) & mask
            np.bitwise_or.at(bits[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        # shingles beyond the first on a bit: an overlap holds at most so many more than common bits
        given = np.array([len(sets[i]) for i in self.order], dtype=np.int64)
        excess = given - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, size, size, excess)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, excess = self.levels[-1]
            starts = np.arange(0, len(bits), FAN)
            self.levels.append((
                np.bitwise_or.reduceat(bits, starts), np.minimum.reduceat(low, starts),
                np.maximum.reduceat(high, starts), np.maximum.reduceat(excess, starts),
            ))

    def labels(self, own: np.ndarray) -> list[np.ndarray]:
        """For each level the label that all members of a node share, or -1."""
        out = [own[self.order]]
        for bits, *_ in self.levels[1:]:
            starts = np.arange(0, len(out[-1]), FAN)
            low, high = np.minimum.reduceat(out[-1], starts), np.maximum.reduceat(out[-1], starts)
            out.append(np.where((low == high) & (low >= 0), low, -1))
        return out


class Forest:
    """Union of linked members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], dtype=np.int64)


def _width(sets: list[np.ndarray]) -> int:
    largest = max(int(np.median([len(s) for s in sets])), 16)
    return min(1 << (4 * largest - 1).bit_length(), 1 << 16)


def dual_links(
    sets: list[np.ndarray], sizes: list[int], split: int | None, rule: Rule, known: list | None = None
) -> list[tuple[int, int]]:
    """Links that join the sets into their components.

    ``sets`` need only hold shingles that several of them have; ``sizes`` are
    those of the whole sets.

    With ``split`` only pairs of one of the first ``split`` sets and one of the
    rest are looked at.  ``known`` names components that are known already;
    links within one are not looked for.
    """
    forest, found = Forest(len(sets)), []
    if known is not None:
        first: dict = {}
        for i, c in enumerate(known):
            forest.join(i, first.setdefault(c, i))
    width, size = _width(sets), np.array(sizes, dtype=np.int64)
    if split is None:
        left = right = Tree(sets, size, width)
        left_at = right_at = left.order
    else:
        left, right = Tree(sets[:split], size[:split], width), Tree(sets[split:], size[split:], width)
        left_at, right_at = left.order, right.order + split

    def walk(i: np.ndarray, j: np.ndarray, li: int, lj: int) -> None:
        """Pairs of nodes of two levels, their children, and so on."""
        for at in range(0, len(i), FRONTIER):
            a, b = i[at : at + FRONTIER], j[at : at + FRONTIER]
            now = forest.labels()
            own = left.labels(now if split is None else now[:split])
            other = own if split is None else right.labels(now[split:])
            keep = (own[li][a] != other[lj][b]) | (own[li][a] < 0)
            if split is None and li == lj == 0:
                keep &= a != b
            a, b = a[keep], b[keep]
            bits, low, high, excess = left.levels[li]
            bits2, low2, high2, excess2 = right.levels[lj]
            common = np.bitwise_count(bits[a] & bits2[b]).sum(axis=1).astype(np.int64)
            most = np.minimum(common + np.minimum(excess[a], excess2[b]), np.minimum(high[a], high2[b]))
            # sizes: the smaller must be able to reach the larger's share
            keep = most >= rule.needed(low[a], low2[b]) - 1e-9
            keep &= (100 * high[a] >= rule.percent * low2[b]) & (100 * high2[b] >= rule.percent * low[a])
            a, b = a[keep], b[keep]
            if li == lj == 0:
                # the likeliest first, so that others fall within one component
                for k in np.argsort(-common[keep] / (low[a] + low2[b]), kind="stable"):
                    x, y = int(left_at[a[k]]), int(right_at[b[k]])
                    if forest.find(x) == forest.find(y):
                        continue
                    overlap = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if rule.links(overlap, size[x], size[y]):
                        forest.join(x, y)
                        found.append((x, y))
                continue
            na, nb = max(li - 1, 0), max(lj - 1, 0)
            ca, cb = _children(a, li, len(left.levels[na][0])), _children(b, lj, len(right.levels[nb][0]))
            pairs = [(p, q) for x, y in zip(ca, cb) for p in x for q in y if split is not None or li != lj or p <= q or x[0] != y[0]]
            if pairs:
                both = np.array(pairs, dtype=np.int64)
                walk(both[:, 0], both[:, 1], na, nb)

    root = np.zeros(1, dtype=np.int64)
    walk(root, root, len(left.levels) - 1, len(right.levels) - 1)
    return found


def _children(nodes: np.ndarray, level: int, below: int) -> list[range]:
    if level == 0:
        return [range(n, n + 1) for n in nodes.tolist()]
    return [range(n * FAN, min(n * FAN + FAN, below)) for n in nodes.tolist()]


def _group_links(rule: Rule, crossing: bool):
    """Function for a group of packed members: links within each cluster, or across its two blocks."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        rows.sort(key=lambda r: (r["cluster"], r["side"], r["doc_id"]))
        out: list[tuple[int, int]] = []
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to]["cluster"] == rows[at]["cluster"]:
                to += 1
            own = rows[at:to]
            sets = [np.frombuffer(r["shingles"], "<u8") for r in own]
            split = sum(r["side"] == 0 for r in own) if crossing else None
            if len(own) > 1 and (split is None or 0 < split < len(own)):
                known = [r["component"] for r in own] if crossing else None
                links = dual_links(sets, [r["n"] for r in own], split, rule, known)
                out += [(own[i]["doc_id"], own[j]["doc_id"]) for i, j in links]
            at = to
        columns = [pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)]
        return pa.Table.from_arrays(columns, names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Two documents are linked when their sets of shingles are at least as
    similar as ``rule`` says; a component is named by its smallest doc_id.
    Texts with fewer words than a shingle are one shingle.  Null and empty
    texts, and texts without words, have no shingles and are linked with
    nothing.  A row without a doc_id is linked with nothing and has a null
    component.  Rows that repeat a doc_id are returned each; what one of them
    is linked with, the document is.  Other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = materialize(_measure(rows, rule), "shingle-sets")
    base = measured.drop("smallest")
    classes = materialize(
        base.where("doc_id IS NOT NULL AND n > 0").groupBy("n", "d1", "d2").agg(
            F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")
        ),
        "classes",
    )
    members = _members(rows, _candidates(measured, classes, rule), rule)
    # the smallest document of a shared shingle is the hub of a star
    firsts = members.select(F.explode("firsts").alias("token"), "doc_id")
    hubs = firsts.groupBy("token").agg(
        F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("docs")
    )
    hubs = materialize(hubs.where("hub < last").drop("last"), "hubs")
    facts = hubs.agg(F.count(F.lit(1)), F.sum("docs")).first()
    hot = hot_rows(hubs, "docs", facts[1] or 0)
    stars = lookup(firsts, hubs, ["token"], 16 * facts[0], "inner", SHINGLE_BYTES, hot).where("doc_id <> hub")
    clusters = connected(stars.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    clusters = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    sets = _blocks(members.drop("firsts").join(clusters, "doc_id"), rule, block_shingles)
    links = _first_round(sets, rule, block_shingles)
    components = connected(links)
    crossing = _second_round(sets, components, rule)
    if crossing is not None:
        components = connected(links.unionByName(crossing))
    size = bytes_of(components)[1]
    labelled = classes.drop("copies").withColumnRenamed("class_id", "node")
    # every class has one node
    classed = join_rows(labelled, components, ["node"], size, "left", CANDIDATE_BYTES).select(
        "n", "d1", "d2", F.coalesce("component", "node").alias("component_id")
    )
    # classes of a single document are their own component; only others are looked up
    facts = classes.agg(F.count(F.lit(1)), F.sum("copies")).first()
    hot = hot_rows(classes, "copies", facts[1] or 0)
    joined = lookup(base, classed, ["n", "d1", "d2"], 32 * facts[0], hot=hot)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _blocks(members: DataFrame, rule: Rule, block_shingles: int) -> DataFrame:
    """Members with their block: ``doc_id, cluster, n, shingles, cut, band, part``.

    A cluster that is larger than a block is cut, by size of set and then by hash.
    """
    step = F.lit(float(np.log(100 / rule.percent)))
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    bands = banded.groupBy("cluster", "band").agg(F.sum(F.octet_length("shingles") / 8).alias("held"))
    whole = bands.groupBy("cluster").agg(F.sum("held").alias("of_cluster"))
    cut = bands.join(whole, "cluster").where(F.col("of_cluster") > block_shingles)
    cut = materialize(cut.select("cluster", "band", F.ceil(F.col("held") / block_shingles).alias("parts")), "cluster-bands")
    placed = lookup(banded, cut, ["cluster", "band"], 20 * cut.count())
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(F.lit(0))
    return materialize(
        placed.select(
            "doc_id", "cluster", "n", "shingles", F.col("parts").isNotNull().alias("cut"), "band", part.cast("int").alias("part")
        ),
        "member-sets",
    )


def _first_round(sets: DataFrame, rule: Rule, block_shingles: int) -> DataFrame:
    """Links within blocks; each block of a cut cluster also holds the cluster's pivots."""
    total = sets.where("NOT cut").agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    groups = max(total // 8 // block_shingles, 1)
    whole = sets.where("NOT cut").withColumn("grp", F.concat_ws(":", F.lit("w"), F.pmod(F.xxhash64("cluster"), F.lit(groups))))
    of_block = F.concat_ws(":", "cluster", "band", "part")
    cut = sets.where("cut").withColumn("grp", of_block)
    picks = [F.min("doc_id")] + [F.min_by("doc_id", F.xxhash64(F.lit(i), F.col("doc_id"))) for i in range(1, PIVOTS)]
    pivots = sets.where("cut").groupBy("cluster").agg(F.array_distinct(F.array(*picks)).alias("p"))
    pivots = pivots.select("cluster", F.explode("p").alias("doc_id"))
    places = sets.where("cut").select("cluster", "band", "part").distinct()
    pivot_sets = materialize(sets.join(pivots, ["cluster", "doc_id"], "left_semi").drop("band", "part"), "pivots")
    at_pivots = pivot_sets.join(places, "cluster").withColumn("grp", of_block)
    columns = ["grp", "cluster", "doc_id", F.lit(0).alias("side"), F.lit(0).cast("long").alias("component"), "n", "shingles"]
    every = whole.select(*columns).unionByName(cut.select(*columns)).unionByName(at_pivots.select(*columns))
    return materialize(every.groupBy("grp").applyInArrow(_group_links(rule, False), "a long, b long"), "links")


def _second_round(sets: DataFrame, components: DataFrame, rule: Rule) -> DataFrame | None:
    """Links across the blocks of a cut cluster whose members are not all linked."""
    cut = sets.where("cut")
    named = lookup(cut, components.withColumnRenamed("node", "doc_id"), ["doc_id"], bytes_of(components)[1])
    named = materialize(named.withColumn("component", F.coalesce("component", "doc_id")), "named-sets")
    blocks = materialize(
        named.groupBy("cluster", "band", "part").agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.min("n").alias("least"),
            F.max("n").alias("most"),
        ),
        "blocks",
    )
    first, second = blocks.alias("x"), blocks.alias("y")
    differ = (F.col("x.low") != F.col("y.low")) | (F.col("x.high") != F.col("x.low")) | (F.col("y.high") != F.col("y.low"))
    fits = (F.col("x.most") * 100 >= F.col("y.least") * rule.percent) & (
        F.col("y.most") * 100 >= F.col("x.least") * rule.percent
    )
    later = F.struct("x.band", "x.part") < F.struct("y.band", "y.part")
    pairs = first.join(second, F.col("x.cluster") == F.col("y.cluster")).where(later & differ & fits)
    pairs = materialize(
        pairs.select(
            F.col("x.cluster").alias("cluster"),
            F.concat_ws(":", "x.cluster", "x.band", "x.part", "y.band", "y.part").alias("grp"),
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("side"), F.col("x.band").alias("band"), F.col("x.part").alias("part")),
                    F.struct(F.lit(1).alias("side"), F.col("y.band").alias("band"), F.col("y.part").alias("part")),
                )
            ).alias("end"),
        ).select("cluster", "grp", "end.*"),
        "block-pairs",
    )
    if pairs.isEmpty():
        return None
    every = named.join(pairs, ["cluster", "band", "part"]).select(
        "grp", "cluster", "doc_id", "side", "component", "n", "shingles"
    )
    return materialize(every.groupBy("grp").applyInArrow(_group_links(rule, True), "a long, b long"), "links")


def _numbered(docs: DataFrame, several: DataFrame, size: int) -> DataFrame:
    """``doc_id, text, row`` with a number for each different pair of id and text in place of the id, in its order.

    A row without text goes where its id has a text: it says nothing that the other does not.
    """
    keyed = docs.select("*", *row_keys("doc_id", "text"))
    order = ["doc_id", "row_key1", "row_key2"]
    places = keyed.where("doc_id IS NOT NULL").groupBy(*order).agg(F.min(F.col("text").isNull()).alias("bare"))
    places = materialize(places, "row-places")
    numbers = dense_ids(places, order, "number", slices_for(places.count()))
    numbers = lookup(numbers, several, ["doc_id"], size)
    numbers = materialize(numbers.where("NOT (bare AND coalesce(worded, false))").drop("bare", "worded"), "row-numbers")
    # rows without an id stay as they are
    known = lookup(keyed.where("doc_id IS NOT NULL"), numbers, order, 32 * numbers.count(), "inner")
    unknown = keyed.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "text", "row")
    return known.select(F.col("number").alias("doc_id"), "text", "row").unionByName(unknown)


def keep_first(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` but for those whose component has a smaller one, with all their columns.

    Rows are judged each by its own text: rows that share a doc_id are linked
    only if their texts are, and equal rows, of which one stays, count as one.
    Rows without text or words, and rows without a doc_id, all stay; but a row
    whose id has another row with text goes if it has none.
    """
    # the row in one column, as its own names may be any
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole)
    counted = rows.where("doc_id IS NOT NULL").groupBy("doc_id")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("text").isNotNull()).alias("worded"))
    several = materialize(counted.where("n > 1").drop("n"), "repeated-ids")
    size = 12 * several.count()
    if size:
        rows = materialize(_numbered(rows, several, size), "numbered-rows")
    found = jaccard_components(rows, rule).where("component_id < doc_id").select("doc_id").distinct()
    later = materialize(found, "later-documents")
    kept = join_rows(rows, later, ["doc_id"], 8 * later.count(), "left_anti", CANDIDATE_BYTES)
    if not size:
        return kept.select("row.*")
    # of equal rows one stays
    again = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.first("row").alias("row"))
    return again.select("row").unionByName(kept.where("doc_id IS NULL").select("row")).select("row.*")
