"""Quality of documents by a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are shares of character classes and
repeated words, those of the lines beside it, and its place; a chain of two
labels links neighbouring lines.  The marginals of the forward-backward
recursion, weighted by the lines' lengths, are the document's quality.

The field is fitted on a bounded sample of labelled documents, whose lines all
take the document's label; lengths, classes and repetitions are computed for
whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import binary, map_batches, map_stream, text_parts
from corpusloom.llm.hashing import prefix_hash, run_hash

# Labelled documents of each class, and lines of one, that the field is fitted on.
SAMPLE = 1500
SAMPLE_LINES = 1000
# Bytes of text whose features are computed together; cut at line ends.
CHUNK = 500_000
STEPS = 120

OWN = 13
# own features, those of the lines before and after that tell most, and the place
FEATURES = OWN + 2 * 5 + 3
_BESIDE = [2, 4, 5, 8, 9]

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_CLASS[[ord(c) for c in " \t\r\n"]] = 5
# class 0: all other bytes, most of them symbols


def _line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own features of lines, and a hash of each."""
    size = np.maximum(ends - starts, 1).astype(np.float64)
    kind = _CLASS[data]
    out = np.zeros((len(starts), OWN))

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[ends] - sums[starts]

    out[:, 0] = ends == starts
    out[:, 1] = np.log1p(ends - starts) / 8
    out[:, 2] = count(kind == 2) / size
    out[:, 3] = count(kind == 3) / size
    out[:, 4] = count(kind == 0) / size
    out[:, 5] = count(kind == 1) / size
    out[:, 6] = count(kind == 4) / size
    # words: runs of bytes that are no white space
    solid = kind != 5
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    low, high = np.searchsorted(first, starts), np.searchsorted(first, ends)
    words = (high - low).astype(np.float64)
    some = np.maximum(words, 1)
    sums = prefix_hash(data)
    line_hash = run_hash(sums, starts, ends)
    if len(first):
        hashes = run_hash(sums, first, after)
        same = np.zeros(len(first) + 1, dtype=np.int32)
        same[2:] = np.cumsum(hashes[1:] == hashes[:-1])
        # pairs within a line: from its second word on
        out[:, 8] = (same[high] - same[np.minimum(low + 1, high)]) / some
        line_of = np.repeat(np.arange(len(starts)), high - low)
        key = hashes ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at = np.unique(key, return_index=True)
        out[:, 9] = 1 - np.bincount(line_of[at], minlength=len(starts)) / some
        # a word's last byte is a symbol
        marked = np.zeros(len(first) + 1, dtype=np.int32)
        np.cumsum(kind[after - 1] == 0, out=marked[1:])
        out[:, 10] = (marked[high] - marked[low]) / some
    out[:, 7] = np.log1p(words) / 6
    out[:, 11] = (out[:, 2] + out[:, 3] + out[:, 4] + out[:, 5] + out[:, 6]) * size / some / 10
    last = data[np.maximum(ends - 1, 0)]
    out[:, 12] = (ends > starts) & np.isin(last, [ord("."), ord("!"), ord("?")])
    out[:, 9] = np.where(words > 0, out[:, 9], 0)
    return out, line_hash


def lines_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, line lengths, and the number of lines of each text.

    A text without line feeds, also an empty one, is one line.
    """
    lengths = np.array([t.count(b"\n") + 1 if t else 1 for t in texts], dtype=np.int64)
    if not texts:
        return np.zeros((0, FEATURES)), np.zeros(0, dtype=np.int64), lengths
    rows, hashes, sizes = [], [], []
    whole = b"\n".join([t or b"" for t in texts]) + b"\n"
    at = 0
    while at < len(whole):
        to = whole.find(b"\n", min(at + CHUNK, len(whole) - 1)) + 1
        data = np.frombuffer(whole, np.uint8, to - at, at)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        own, line_hash = _line_features(data, starts, ends)
        rows.append(own)
        hashes.append(line_hash)
        sizes.append(ends - starts)
        at = to
    own, line_hash, size = np.concatenate(rows), np.concatenate(hashes), np.concatenate(sizes)
    out = np.zeros((len(own), FEATURES))
    out[:, :OWN] = own
    first = np.zeros(len(own), dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    last = np.roll(first, -1)
    n = len(_BESIDE)
    out[1:, OWN : OWN + n] = own[:-1, _BESIDE]
    out[first, OWN : OWN + n] = 0
    out[:-1, OWN + n : OWN + 2 * n] = own[1:, _BESIDE]
    out[last, OWN + n : OWN + 2 * n] = 0
    out[:, -3], out[:, -2] = first, last
    out[1:, -1] = line_hash[1:] == line_hash[:-1]
    out[first, -1] = 0
    return out, size + 1, lengths


class Chains:
    """Lines of many documents as chains, worked on one place at a time for all documents together."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.order = np.argsort(-lengths, kind="stable")
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        # documents that have a line at place t come first in this order
        falling = lengths[self.order]
        self.active = np.searchsorted(-falling, -np.arange(falling[0] if len(falling) else 0), side="left")

    def places(self):
        for t, n in enumerate(self.active):
            yield self.starts[:n] + t, n

    def ratios(self, emission: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds of good to bad for every line; t[i, j] scores label i before j."""
        forward, backward = np.empty_like(emission), np.zeros_like(emission)
        last = None
        steps = list(self.places())
        for at, n in steps:
            if last is None:
                forward[at] = emission[at]
            else:
                a = forward[last[:n]]
                forward[at] = emission[at] + np.logaddexp(a + t[1, 1], t[0, 1]) - np.logaddexp(a + t[1, 0], t[0, 0])
            last = at
        for at, n in reversed(steps[1:]):
            b = emission[at] + backward[at]
            backward[at - 1] = np.logaddexp(b + t[1, 1], t[1, 0]) - np.logaddexp(b + t[0, 1], t[0, 0])
        return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass(frozen=True)
class Field:
    """Weights of standardised features, and scores of neighbouring labels; without weights, a constant."""

    constant: float
    weights: np.ndarray | None = None
    bias: float = 0.0
    pairs: np.ndarray | None = None

    def marginals(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each line to be good."""
        if self.weights is None:
            return np.full(len(features), self.constant)
        emission = features @ self.weights + self.bias
        forward, backward = Chains(lengths).ratios(emission, self.pairs)
        return _sigmoid(forward + backward)


def fit_field(features: np.ndarray, lengths: np.ndarray, good: np.ndarray, steps: int = STEPS) -> Field:
    """The field of greatest penalised likelihood, by gradient steps over all chains.

    ``good`` is the label of each document.  Without documents of both
    classes the result is the constant share of good ones (0.5 without any).
    """
    if not len(good) or good.min() == good.max():
        return Field(float(good.mean()) if len(good) else 0.5)
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    x = (features - centre) / scale
    label = np.repeat(good, lengths).astype(np.float64)
    # a document counts alike whatever its number of lines, and both classes alike
    share = np.where(good == 1, 0.5 / (good == 1).sum(), 0.5 / (good == 0).sum())
    weight = np.repeat(share / lengths, lengths)
    chains = Chains(lengths)
    second = np.ones(len(x), dtype=bool)
    second[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(second)
    parameters = np.zeros(x.shape[1] + 5)
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = weight[at][(label[at - 1] == i) & (label[at] == j)].sum()
    first, second_moment = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        w, bias, t = parameters[: x.shape[1]], parameters[x.shape[1]], parameters[-4:].reshape(2, 2)
        emission = x @ w + bias
        forward, backward = chains.ratios(emission, t)
        p = _sigmoid(forward + backward)
        slope = weight * (label - p)
        gradient = np.empty_like(parameters)
        gradient[: x.shape[1]] = x.T @ slope - 1e-3 * w
        gradient[x.shape[1]] = slope.sum()
        # both labels of neighbouring lines: what leads up to the first, the pair, what follows
        a, b = forward[at - 1], emission[at] + backward[at]
        joint = np.stack([np.full(len(at), t[0, 0]), b + t[0, 1], a + t[1, 0], a + b + t[1, 1]])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        expected = (joint @ weight[at]).reshape(2, 2)
        gradient[-4:] = (seen - expected - 1e-2 * t).ravel()
        first = 0.9 * first + 0.1 * gradient
        second_moment = 0.99 * second_moment + 0.01 * gradient**2
        parameters += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-8)
    w = parameters[: x.shape[1]] / scale
    return Field(float(good.mean()), w, float(parameters[x.shape[1]] - centre @ w), parameters[-4:].reshape(2, 2))


def held_out(doc_id):
    """Whether no label of the row may be learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Field:
    """Fit on at most ``sample`` labelled documents of each class, of at most ``sample_lines`` lines.

    Held-out rows are never looked at.  Labels that contradict each other, or
    are neither 0 nor 1, do not count.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("good"), F.max("quality").cast("int").alias("most"))
        .where("good = most")
        .drop("most")
    )
    short = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    features = []
    for good in (0, 1):
        # drawn by hash; bounded by ``sample``
        drawn = known.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        features.append(short.join(F.broadcast(drawn), "doc_id").select("text", "good"))

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = binary(batch.column("text"))
        some = [i for i, t in enumerate(texts) if not t or t.count(b"\n") < sample_lines]
        x, _, lengths = lines_of([texts[i] for i in some])
        ends = np.cumsum(lengths)
        parts = [x[e - n : e].astype("<f4").tobytes() for e, n in zip(ends, lengths)]
        columns = [pa.array(parts, pa.binary()), batch.column("good").take(pa.array(some, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["lines", "good"])

    rows = map_batches(features[0].unionByName(features[1]), measured, "lines binary, good int").collect()
    rows.sort(key=lambda r: (r["good"], zlib.crc32(bytes(r["lines"])), bytes(r["lines"])))
    parts = [np.frombuffer(bytes(r["lines"]), "<f4").reshape(-1, FEATURES) for r in rows]
    if not parts:
        return Field(0.5)
    x = np.concatenate(parts).astype(np.float64)
    return fit_field(x, np.array([len(p) for p in parts]), np.array([r["good"] for r in rows]))


def document_scores(field: Field, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Quality of each text, and the probability of each of its lines to be good."""
    x, size, lengths = lines_of(texts)
    p = field.marginals(x, lengths)
    start = np.cumsum(lengths) - lengths
    score = np.add.reduceat(p * size, start) / np.add.reduceat(size, start)
    return np.clip(score, 0.0, 1.0), np.split(p, start[1:])


def score_quality(docs: DataFrame, field: Field, with_lines: bool = False) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``n_lines`` of every document, with ``lines`` their marginals.

    Null and empty texts are one empty line and get its score.  Rows that
    repeat a doc_id, or have none, are scored each on its own; other columns
    are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_parts(batch.column("text")):
                score, lines = document_scores(field, part)
                columns = [batch.column("doc_id").slice(at, len(part)), pa.array(score)]
                columns.append(pa.array([len(p) for p in lines], pa.int64()))
                names = ["doc_id", "score", "n_lines"]
                if with_lines:
                    columns.append(pa.array(lines, pa.list_(pa.float64())))
                    names.append("lines")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, score double, n_lines long" + (", lines array<double>" if with_lines else "")
    return map_stream(rows, run, schema)


def keep_good(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose quality is at least ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_parts(batch.column("row").field(place).cast(pa.string())):
                score, _ = document_scores(field, part)
                yield batch.slice(at, len(part)).filter(pa.array(score >= threshold))

    # the row in one column, as its own names may be any
    place = [c.lower() for c in docs.columns].index("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return map_stream(rows, run, T.StructType([T.StructField("row", docs.schema, False)])).select("row.*")
