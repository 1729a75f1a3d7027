"""Hard negatives by cover trees over norm-augmented vectors.

Rows are integer vectors; a candidate x is augmented to (x, sqrt(M^2 - |x|^2)), M
being the largest norm of its tree, and an anchor q to (q, 0).  Products stay
what they were and all candidates have one length, so the nearest ones are those of
the largest product.  A tree's nodes have a centre and a covering radius, the
greatest distance from it to what is below: all products below differ from the
centre's by at most |q| times the radius.

1. Every task cuts its rows into runs of TREE_ROWS and builds a cover tree of
   each; the trees are written once, and nothing is shuffled.
2. Anchors are met in blocks of bounded size.  Their positives are the best
   rows of their own label; each tree gives its best, and the best of all are kept.
3. The score of a positive is the upper end of a window, in which the
   best rows of other labels are searched in the same way.

In a tree, every anchor opens its most promising nodes first.  A node whose
bounds lie outside all windows of the anchor, or below the worst row that each
window keeps, is skipped; the rows of leaves are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_stream, materialize

# Rows of a tree, of a leaf, and the ratio of the radii of neighbouring levels.
TREE_ROWS = 4096
LEAF_ROWS = 16
RATIO = 1.3
# Components of a tree, so that trees of long vectors have fewer rows.
TREE_VALUES = 1 << 20
# Anchors that are met in one go, and nodes that one of them opens at a time.
BLOCK_ANCHORS = 1024
BEAM = 16
# Integer products of at most this size are exact in double precision.
EXACT = 1 << 53
_LONG = (1 << 63) - 1

TREES = (
    "dim int, n int, ids binary, labels array<string>, vectors binary, centres binary, radii binary, "
    "children binary, members binary"
)


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer-valued matrices; beyond 64 bits they stay at the end of the range."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), dtype=np.int64)
    if left.shape[1] * float(np.abs(left).max()) * float(np.abs(right).max()) < EXACT:
        return (left @ right.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    products = whole(left).astype(object) @ whole(right).astype(object).T
    return np.clip(products, -_LONG - 1, _LONG).astype(np.int64)


@dataclass
class CoverTree:
    """Nodes in the order of their levels; rows so ordered that a node's are consecutive.

    Of node i, ``centres[i]`` is the row at its centre, ``radii[i]`` covers
    ``members[i]`` (from, to), and ``children[i]`` (from, to) are its nodes, none for a leaf.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    centres: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    radii: np.ndarray = field(default_factory=lambda: np.zeros(0))
    children: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int32))
    members: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int32))

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> CoverTree:
        """Tree of rows, of which there is at least one.

        Each level has a radius.  A node takes its centre as first child, and then, again and again, the row
        farthest from all of its children's centres, until every row is within the next level's
        radius of one; rows go to the nearest.
        """
        # beyond double range no bound is of use: such radii are infinite
        with np.errstate(over="ignore", invalid="ignore"):
            square = np.einsum("ij,ij->i", vectors, vectors)
            points = np.column_stack([vectors, np.sqrt(np.maximum(square.max() - square, 0.0))])

            def distances(rows: np.ndarray, centre: int) -> np.ndarray:
                apart = points[rows] - points[centre]
                far = np.sqrt(np.einsum("ij,ij->i", apart, apart))
                return np.where(np.isnan(far), np.inf, far)

            rows = np.arange(len(ids))
            nodes = [(0, rows, distances(rows, 0))]
            centres, radii, children, spans, order = [], [], [], [], {}
            at = 0
            while at < len(nodes):
                centre, rows, away = nodes[at]
                radius = float(away.max())
                first = len(nodes)
                if len(rows) > LEAF_ROWS and 0 < radius < np.inf:
                    nearest, owner, heads = away.copy(), np.zeros(len(rows), dtype=np.int64), [centre]
                    while nearest.max() > radius / RATIO:
                        head = int(rows[int(nearest.argmax())])
                        other = distances(rows, head)
                        closer = other < nearest
                        owner[closer], nearest[closer] = len(heads), other[closer]
                        heads.append(head)
                    for k, head in enumerate(heads):
                        own = owner == k
                        nodes.append((head, rows[own], nearest[own]))
                else:
                    order[at] = rows
                centres.append(centre)
                radii.append(radius)
                children.append((first, len(nodes)))
                nodes[at] = (centre, rows[:0], away[:0])
                at += 1
        # leaves from left to right, so that a node's rows are consecutive
        members = np.zeros((len(nodes), 2), dtype=np.int32)
        sequence: list[np.ndarray] = []
        size, stack = 0, [(0, False)]
        while stack:
            node, done = stack.pop()
            low, high = children[node]
            if done:
                members[node] = members[low, 0], members[high - 1, 1]
            elif low == high:
                sequence.append(order[node])
                members[node] = size, size + len(order[node])
                size += len(order[node])
            else:
                stack.append((node, True))
                stack.extend((child, False) for child in range(high - 1, low - 1, -1))
        rows = np.concatenate(sequence)
        place = np.empty(len(rows), dtype=np.int32)
        place[rows] = np.arange(len(rows))
        return cls(
            ids[rows], labels[rows], vectors[rows], place[centres], np.array(radii),
            np.array(children, dtype=np.int32), members,
        )

    def row(self) -> list[pa.Array]:
        parts = (
            self.vectors.astype("<f8"), self.centres.astype("<i4"), self.radii.astype("<f8"),
            self.children.astype("<i4"), self.members.astype("<i4"),
        )
        return [
            pa.array([self.vectors.shape[1]], pa.int32()),
            pa.array([len(self.ids)], pa.int32()),
            pa.array([self.ids.astype("<i8").tobytes()], pa.binary()),
            pa.array([self.labels.tolist()], pa.list_(pa.string())),
            *[pa.array([part.tobytes()], pa.binary()) for part in parts],
        ]

    @classmethod
    def of_row(cls, row: dict) -> CoverTree:
        shape = (row["n"], row["dim"])
        return cls(
            np.frombuffer(row["ids"], "<i8"),
            np.array(row["labels"], dtype=object),
            np.frombuffer(row["vectors"], "<f8").reshape(shape),
            np.frombuffer(row["centres"], "<i4"),
            np.frombuffer(row["radii"], "<f8"),
            np.frombuffer(row["children"], "<i4").reshape(-1, 2),
            np.frombuffer(row["members"], "<i4").reshape(-1, 2),
        )


@dataclass
class Asked:
    """Anchors of one vector length: each has windows (low, high) of scores, unused ones being empty."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


class Best:
    """The best rows of every window so far, by score and then by smaller id."""

    def __init__(self, windows: int, k: int):
        self.k, self.worst = k, np.full(windows, -np.inf)
        self.window = self.score = self.id = np.zeros(0, dtype=np.int64)

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        window, score = np.concatenate([self.window, window]), np.concatenate([self.score, score])
        ids = np.concatenate([self.id, ids])
        # the complement falls as scores rise, also at the end of 64 bits
        order = np.lexsort((ids, ~score, window))
        window, score, ids = window[order], score[order], ids[order]
        nth = np.arange(len(window)) - np.searchsorted(window, window)
        kept = nth < self.k
        self.window, self.score, self.id = window[kept], score[kept], ids[kept]
        full = nth == self.k - 1
        self.worst[window[full]] = score[full]


def search(tree: CoverTree, asked: Asked) -> tuple[Best, int]:
    """The best rows of a tree for every window (numbered anchor by anchor), and how many rows were scored."""
    anchors, width = asked.low.shape
    best, scored = Best(anchors * width, asked.k), 0
    vectors = asked.vectors
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))

    def bounds(a: np.ndarray, nodes: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product below the nodes, with room for rounding."""
        with np.errstate(over="ignore", invalid="ignore"):
            reach = norm[a] * tree.radii[nodes]
            reach = np.where(np.isnan(reach), np.inf, reach)
            reach = reach + 1e-9 * (np.abs(score) + reach + norm[a] * norm_of_all) + 1.0
            return score - reach, score + reach

    with np.errstate(over="ignore", invalid="ignore"):
        norm_of_all = np.nan_to_num(np.sqrt(np.einsum("ij,ij->i", tree.vectors, tree.vectors).max()), nan=np.inf)

    def wanted(a: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether any window of an anchor can still take something between the bounds."""
        floor = np.maximum(asked.low, best.worst.reshape(anchors, width))
        return ((most[:, None] >= floor[a]) & (least[:, None] <= asked.high[a])).any(axis=1)

    a, nodes = np.arange(anchors), np.zeros(anchors, dtype=np.int64)
    least, most = np.full(anchors, -np.inf), np.full(anchors, np.inf)
    while len(a):
        keep = wanted(a, least, most)
        a, nodes, least, most = a[keep], nodes[keep], least[keep], most[keep]
        order = np.lexsort((-most, a))
        a, nodes, least, most = a[order], nodes[order], least[order], most[order]
        now = np.arange(len(a)) - np.searchsorted(a, a) < BEAM
        open_a, open_nodes = a[now], nodes[now]
        fresh: list[tuple[np.ndarray, ...]] = [(a[~now], nodes[~now], least[~now], most[~now])]
        found: list[tuple[np.ndarray, ...]] = []
        order = np.argsort(open_nodes, kind="stable")
        open_a, open_nodes = open_a[order], open_nodes[order]
        cuts = np.flatnonzero(np.diff(open_nodes, prepend=-1, append=-1))
        for i, j in zip(cuts[:-1], cuts[1:]):
            node, own = int(open_nodes[i]), open_a[i:j]
            low, high = tree.children[node]
            if low < high:
                # centres are scored to bound what is below them
                score = exact_products(vectors[own], tree.vectors[tree.centres[low:high]])
                pairs = np.repeat(own, high - low), np.tile(np.arange(low, high), len(own))
                fresh.append((*pairs, *bounds(*pairs, score.ravel().astype(float))))
                continue
            low, high = tree.members[node]
            score = exact_products(vectors[own], tree.vectors[low:high])
            scored += score.size
            fits = (asked.labels[own][:, None] == tree.labels[low:high]) == asked.same
            fits &= asked.ids[own][:, None] != tree.ids[low:high]
            for w in range(width):
                inside = fits & (score >= asked.low[own, w][:, None]) & (score <= asked.high[own, w][:, None])
                q, r = np.nonzero(inside)
                found.append((own[q] * width + w, score[q, r], tree.ids[low:high][r]))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found)))
        a, nodes, least, most = (np.concatenate(x) for x in zip(*fresh))
    return best, scored


def _usable(rows: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, embedding`` of the rows that take part, components as floor(scale * x)."""
    plain = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    finite = ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) == float("inf"))
    )
    return plain.where(finite)


def _scaled(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * values.astype(np.float64))


def build_trees(rows: DataFrame, scale: int = 256, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Cover trees, as rows of TREES, of the rows that `_usable` gives; each row is in one tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def limit(dim: int) -> int:
            return max(min(tree_rows, TREE_VALUES // max(dim, 1)), 1)

        def trees(dim: int, last: bool) -> Iterator[pa.RecordBatch]:
            ids, labels, vectors = (np.concatenate(x) for x in zip(*held[dim]))
            size = limit(dim)
            upto = len(ids) if last else len(ids) - len(ids) % size
            for at in range(0, upto, size):
                part = slice(at, min(at + size, upto))
                tree = CoverTree.build(ids[part], labels[part], vectors[part])
                yield pa.RecordBatch.from_arrays(tree.row(), names=[c.split()[0] for c in TREES.split(", ")])
            held[dim] = [(ids[upto:], labels[upto:], vectors[upto:])]

        for batch in batches:
            column = batch.column("embedding")
            offsets, values = column.offsets.to_numpy(), _scaled(column.values.to_numpy(zero_copy_only=False), scale)
            lengths = np.diff(offsets)
            ids = batch.column("vec_id").to_numpy()
            labels = np.array(batch.column("label").to_pylist(), dtype=object)
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                vectors = values[offsets[own][:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[own], labels[own], vectors))
                if sum(len(x[0]) for x in held[dim]) >= limit(dim):
                    yield from trees(dim, False)
        for dim in list(held):
            yield from trees(dim, True)

    return map_stream(rows.select("vec_id", "label", "embedding"), run, TREES)


def _search_all(trees: DataFrame, asked: dict[int, Asked], numbers: dict[int, np.ndarray]) -> DataFrame:
    """``window, vec_id, score, scored`` of every tree's best rows; ``numbers`` names the windows of each length.

    A row without a window tells how many rows of a tree were scored.
    """
    shared = trees.sparkSession.sparkContext.broadcast((asked, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_length, of_window = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                tree = CoverTree.of_row({c: batch.column(c)[row].as_py() for c in batch.schema.names})
                own = of_length.get(tree.vectors.shape[1])
                if own is None:
                    continue
                best, scored = search(tree, own)
                window = np.append(of_window[tree.vectors.shape[1]][best.window], -1)
                columns = [pa.array(window), pa.array(np.append(best.id, 0)), pa.array(np.append(best.score, scored))]
                yield pa.RecordBatch.from_arrays(columns, names=["window", "vec_id", "score"])

    return map_stream(trees, run, "window long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return found.where("window >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    scale: int = 256,
    block_anchors: int = BLOCK_ANCHORS,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Both tables have ``vec_id, embedding, label``; a component x counts as
    floor(scale * x) and a score is the integer inner product.  The positives of an
    anchor are the best ``positives`` rows of its label and another id.  For each, the best ``negatives``
    rows of other labels are returned whose score is from ``low_percent`` to ``high_percent`` hundredths of the
    positive's.  Equal scores rank by the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component (also after
    scaling), take no part.  Only vectors of equal length have a score; that of vectors without components
    is 0.  Scores beyond 64 bits stay at the end of that range.  Repeated rows are candidates each; repeated anchor rows are one anchor,
    and rows of one id that differ are anchors each.  Empty tables give no rows.

    The work is done block of anchors by block, each over all trees, and the results of a block are
    written before the next one is met.
    """
    spark = vectors.sparkSession
    trees = materialize(build_trees(_usable(vectors, scale), scale, tree_rows), "cover-trees")
    asked = materialize(_usable(anchors, scale).distinct(), "anchors")
    blocks = max(-(-asked.count() // block_anchors), 1)
    number = F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = asked.where(number == b).orderBy("vec_id", "label", "embedding").collect()
        if not rows:
            continue
        found = materialize(_mine_block(trees, rows, positives, negatives, (low_percent, high_percent), scale), "negatives")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame(
            [],
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
        )
    return out


def _mine_block(
    trees: DataFrame, rows: list, positives: int, negatives: int, percent: tuple[int, int], scale: int
) -> DataFrame:
    spark = trees.sparkSession
    by_length: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_length.setdefault(len(r["embedding"]), []).append(i)

    def asked(low, high, same: bool, k: int) -> dict[int, Asked]:
        out = {}
        for dim, own in by_length.items():
            values = np.array([rows[i]["embedding"] for i in own], dtype=np.float64).reshape(len(own), dim)
            out[dim] = Asked(
                np.array([rows[i]["vec_id"] for i in own], dtype=np.int64),
                np.array([rows[i]["label"] for i in own], dtype=object),
                _scaled(values, scale), low[own].astype(np.int64), high[own].astype(np.int64), same, k,
            )
        return out

    anywhere = asked(np.full((len(rows), 1), -_LONG - 1), np.full((len(rows), 1), _LONG), True, positives)
    numbers = {dim: np.array(own, dtype=np.int64) for dim, own in by_length.items()}
    found = _first(_search_all(trees, anywhere, numbers), positives).collect()
    # at most ``positives`` for each anchor of the block
    low, high = np.full((len(rows), positives), _LONG), np.full((len(rows), positives), -_LONG - 1)
    for r in found:
        score, at = r["score"], (r["window"], r["rank"] - 1)
        # whole numbers n with low percent of the score <= n <= high percent of it
        ends = -(-percent[0] * score // 100), percent[1] * score // 100
        low[at], high[at] = (min(max(x, -_LONG - 1), _LONG) for x in ends)
    numbers = {
        dim: (np.array(own, dtype=np.int64)[:, None] * positives + np.arange(positives)).ravel()
        for dim, own in by_length.items()
    }
    best = _first(_search_all(trees, asked(low, high, False, negatives), numbers), negatives)
    of_window = [
        (r["window"] * positives + r["rank"] - 1, rows[r["window"]]["vec_id"], r["vec_id"], r["score"]) for r in found
    ]
    windows = spark.createDataFrame(of_window, "window long, anchor_id long, positive_id long, positive_score long")
    return best.join(F.broadcast(windows), "window").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
