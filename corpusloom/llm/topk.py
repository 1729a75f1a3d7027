"""Exact top-k inner products by distributed histogram selection.

The query set is met in blocks of bounded size.  For a block every candidate
is scored in every pass.  A pass counts, per query, the scores in equal
bins of the query's current range; the sums over all tasks tell which bin
holds the kth highest score, and that bin is the next range.  After a few
passes a bin is one score wide, so the kth score is known exactly.  A last
pass keeps what reaches it and breaks ties by the smaller id.

Scores are integers, so all of it is exact.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, materialize

# Queries that are met in one go; their vectors are what is broadcast.
BLOCK_QUERIES = 2048
# Bins of a histogram.
BINS = 512
# Candidates that are scored against a block at a time.
SLICE = 1024
# Integer products of at most this size are exact in double precision.
EXACT = 1 << 53
_LONG = (1 << 63) - 1


def _matrices(column: pa.ListArray, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors as floor(scale * x), grouped by length: (row numbers, matrix)."""
    offsets = column.offsets.to_numpy()
    values = np.floor(scale * column.values.to_numpy(zero_copy_only=False))
    lengths = np.diff(offsets)
    groups = []
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        groups.append((rows, values[offsets[rows][:, None] + np.arange(length)]))
    return groups


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer products, one row a query; beyond 64 bits they stay at the end of the range."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(candidates)), dtype=np.int64)
    bound = queries.shape[1] * float(np.abs(queries).max()) * float(np.abs(candidates).max())
    if bound < EXACT:
        return (queries @ candidates.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in candidates]
    out = np.empty((len(queries), len(candidates)), dtype=np.int64)
    for i, query in enumerate(queries):
        own = [int(x) for x in query]
        for j, row in enumerate(whole):
            out[i, j] = min(max(sum(a * b for a, b in zip(own, row)), -_LONG - 1), _LONG)
    return out


class Block:
    """Queries of one block, by vector length."""

    def __init__(self, ids: list[int], vectors: list[list[float]]):
        self.ids = np.array(ids, dtype=np.int64)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_length.setdefault(len(v), []).append(i)
        for length, rows in by_length.items():
            matrix = np.array([vectors[i] for i in rows], dtype=np.float64).reshape(len(rows), length)
            self.groups[length] = (np.array(rows), matrix)

    def slices(self, batch: pa.RecordBatch, scale: int):
        """Query rows, candidate ids, scores, and which scores are of another id, a slice at a time."""
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for rows, matrix in _matrices(batch.column("embedding"), scale):
            if matrix.shape[1] not in self.groups:
                continue
            queries, vectors = self.groups[matrix.shape[1]]
            for at in range(0, len(rows), SLICE):
                own = ids[rows[at : at + SLICE]]
                scores = _scores(vectors, matrix[at : at + SLICE])
                yield queries, own, scores, self.ids[queries][:, None] != own[None, :]


_BLOCKS: dict[str, Block] = {}


def _block(key: str, shared) -> Block:
    if key not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[key] = Block(*shared.value)
    return _BLOCKS[key]


def _histogram(candidates: DataFrame, key: str, shared, low: np.ndarray, width: np.ndarray, k: int, scale: int):
    """Scores of each query in its BINS bins from ``low`` on, each ``width`` scores wide.

    Scores above the range are counted in the highest bin: fewer than k are.
    """
    n = len(low)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        total = np.zeros((n, BINS), dtype=np.int64)
        for queries, _, scores, other in _block(key, shared).slices(batch, scale):
            least, step = low[queries][:, None], width[queries][:, None]
            take = other & (scores >= least)
            row = np.broadcast_to(queries[:, None], scores.shape)[take]
            # within the range first, so that no difference leaves 64 bits
            bins = ((np.minimum(scores, least + (BINS * step - 1)) - least) // step)[take]
            total += np.bincount(row * BINS + bins, minlength=n * BINS).reshape(n, BINS)
        # only the highest bins, down to where k scores are reached: the kth highest of all
        # batches cannot lie below the kth of one batch
        falling = total[:, ::-1]
        q, b = np.nonzero((falling > 0) & (np.cumsum(falling, axis=1) - falling < k))
        columns = [pa.array(q), pa.array(BINS - 1 - b), pa.array(falling[q, b])]
        return pa.RecordBatch.from_arrays(columns, names=["q", "bin", "n"])

    return map_batches(candidates, count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` highest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Both tables have ``vec_id`` and ``embedding``; a component x counts as
    floor(scale * x).  All rows of another id are candidates of a query; fewer
    than ``k`` are returned whole.  Equal scores rank by the smaller id.

    Vectors that are null or hold a null or non-finite component (also after
    scaling) take no part, nor do rows without an id.  Only vectors of equal
    length have a score; that of vectors without components is 0.  Scores
    beyond 64 bits stay at the end of that range.  Repeated rows are candidates
    each; repeated query rows are one query, and rows of one id with different
    vectors are queries each.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    plain = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    usable = ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) == float("inf"))
    )
    candidates = plain.where(usable)
    asked = (
        queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(usable)
        .distinct()
    )
    asked = materialize(asked, "top-k-queries")
    blocks = max(-(-asked.count() // block_queries), 1)
    number = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks))
    # a bound of all scores, from the largest component
    largest = candidates.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0] or 0.0
    out = None
    for b in range(blocks):
        rows = asked.where(number == b).orderBy("vec_id", "embedding").collect()
        if not rows:
            continue
        found = _block_top(candidates, rows, k, scale, float(largest))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _block_top(candidates: DataFrame, rows: list, k: int, scale: int, largest: float) -> DataFrame:
    spark = candidates.sparkSession
    scaled = [np.floor(scale * np.array(r["embedding"], dtype=np.float64)).tolist() for r in rows]
    key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(([r["vec_id"] for r in rows], scaled))
    # |floor(scale * x)| is at most scale * |x| + 1
    bounds = [min(int(sum(map(abs, v))) * (int(scale * largest) + 2), _LONG // 8) for v in scaled]
    low = np.array([-b - 1 for b in bounds], dtype=np.int64)
    width = np.array([max(-(-(2 * b + 3) // BINS), 1) for b in bounds], dtype=np.int64)
    settled = np.zeros(len(rows), dtype=bool)
    while not settled.all():
        counts = _histogram(candidates, key, shared, low, width, k, scale)
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        reached = counts.withColumn("upto", F.sum("n").over(down)).where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
        bins = {r["q"]: r["bin"] for r in reached.select("q", "bin").collect()}
        for q in np.flatnonzero(~settled):
            if int(q) not in bins:
                # fewer than k reach the range: all candidates count
                low[q], settled[q] = -_LONG - 1, True
                continue
            low[q] += bins[int(q)] * width[q]
            settled[q] = width[q] == 1
            if not settled[q]:
                width[q] = -(-int(width[q]) // BINS)

    def reach(batch: pa.RecordBatch) -> pa.RecordBatch:
        """What reaches the kth score; of a batch's ties only those that k others do not precede."""
        block, kept = _block(key, shared), [[], [], []]
        for queries, ids, scores, other in block.slices(batch, scale):
            q, c = np.nonzero(other & (scores >= low[queries][:, None]))
            kept[0].append(queries[q])
            kept[1].append(ids[c])
            kept[2].append(scores[q, c])
        q, ids, scores = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in kept)
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < k
        columns = [pa.array(x[keep].astype(np.int64)) for x in (q, ids, scores)]
        return pa.RecordBatch.from_arrays(columns, names=["q", "vec_id", "score"])

    found = map_batches(candidates, reach, "q long, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, r["vec_id"]) for i, r in enumerate(rows)], "q long, query_id long")
    return ranked.join(F.broadcast(ids), "q").select("query_id", "rank", "vec_id", "score")
