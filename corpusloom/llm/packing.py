"""Vector bin packing of tokenised examples into sequences.

Every example is a vector of tokens, segments (one) and loss-bearing tokens.
An open sequence takes the example with the largest dot product of the
example's vector and the sequence's free room, both as shares of the limits.
Where nothing fits whole, an example is cut to fill the room.

The packing runs inside each input partition, a bounded number of examples at
a time; what does not fill a sequence moves on to the next examples of the
partition.  No shuffle takes place and no task holds more than a block.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_stream

# Sequences of a partition are numbered from partition * SEQUENCES on.
SEQUENCES = 1 << 33
# Examples, and tokens, that are packed together.
BLOCK_EXAMPLES = 4096
BLOCK_TOKENS = 4_000_000
# Chunks of text whose ids a task remembers.
REMEMBERED = 120_000

# A space beside white space, and white space other than space and line feed.
WIDE_GAPS = ("  ", " \n", "\n ")
OTHER_GAPS = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, loss_tokens long"
)


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Tokens that the JSON file beside the rank file ``vocabulary`` adds to it; none without such a file."""
    beside = vocabulary.removesuffix(".tiktoken") + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        text = file.read()
    # the list alone, not the vocabulary behind it
    tokens, _ = json.JSONDecoder().raw_decode(text, text.index("[", text.index('"added_tokens"')))
    for token in tokens:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} is not matched by its characters alone")
    return {token["content"]: token["id"] for token in tokens}


class TextIds:
    """Byte-level BPE ids of whole texts.

    A text is cut at the ``added`` tokens, which have their own ids wherever
    their characters stand; what is between them is a text of its own.

    The pre-tokeniser always starts a token at a space that stands between
    two characters that are not white space.  A text whose spaces all do is cut
    there: a chunk, with its leading space, has the same ids wherever it
    stands.  Other texts are encoded whole.
    """

    def __init__(self, vocabulary: str, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.encode = encoding.encode_ordinary
        self.chunks: dict[str, bytes] = {}
        self.added = {t: array("I", [i]).tobytes() for t, i in (added or {}).items()}
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest)})").split

    def whole(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids of ``text`` as little-endian 32-bit bytes."""
        if not text:
            return b""
        if self.added and any(map(text.__contains__, self.added)):
            # every second part is an added token
            return b"".join(self.added[p] if i % 2 else self.between(p) for i, p in enumerate(self.cut(text)))
        return self.between(text)

    def between(self, text: str) -> bytes:
        """Ids of ``text``, whose added tokens, if any, count as plain characters."""
        if not text:
            return b""
        if any(map(text.__contains__, WIDE_GAPS)) or text[0] == " " or text[-1] == " " or OTHER_GAPS(text):
            return self.whole(text)
        first, space, rest = text.partition(" ")
        if not space:
            return self.whole(first)
        chunks = rest.split(" ")
        parts = list(map(self.chunks.get, chunks))
        if None in parts:
            keep = len(self.chunks) < REMEMBERED
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = ids = self.whole(" " + chunks[i])
                    if keep:
                        self.chunks[chunks[i]] = ids
        return self.whole(first) + b"".join(parts)


def vector_bins(
    tokens: np.ndarray, free_of_loss: np.ndarray, limits: Limits
) -> Iterator[tuple[list[tuple[int, int, int]], bool]]:
    """Sequences over examples of ``tokens``, whose first ``free_of_loss`` tokens bear no loss.

    Yields lists of pieces (example, start, length) and whether the examples
    ran out before the sequence was full.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
    start = np.zeros(len(tokens), dtype=np.int64)
    left = tokens.astype(np.int64).copy()
    loss_left = np.maximum(tokens - free_of_loss, 0).astype(np.int64)
    alive = left > 0

    def take(i: int, room: int, loss_room: int) -> tuple[int, int]:
        """Longest piece from the start of what is left of example i."""
        length = int(min(left[i], room))
        plain = max(int(free_of_loss[i] - start[i]), 0)
        length = min(length, plain + loss_room)
        return length, max(length - plain, 0)

    def cut(i: int, length: int, loss: int) -> tuple[int, int, int]:
        piece = (i, int(start[i]), length)
        start[i] += length
        left[i] -= length
        loss_left[i] -= loss
        alive[i] = left[i] > 0
        return piece

    # an example longer than a sequence fills sequences of its own
    for i in np.flatnonzero(left >= limits.tokens):
        while left[i] >= limits.tokens:
            length, loss = take(i, limits.tokens, limits.loss)
            yield [cut(i, length, loss)], False
    while alive.any():
        order = np.flatnonzero(alive)
        vectors = np.stack([left[order] / cap[0], np.full(len(order), 1 / cap[1]), loss_left[order] / cap[2]])
        open_ = np.ones(len(order), dtype=bool)
        while open_.any():
            pieces, room = [], np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64)
            while room[0] > 0 and room[1] > 0:
                fits = open_ & (left[order] <= room[0]) & (loss_left[order] <= room[2])
                if fits.any():
                    at = int(np.argmax(np.where(fits, (room / cap) @ vectors, -1.0)))
                    i = int(order[at])
                    length, loss = int(left[i]), int(loss_left[i])
                elif open_.any():
                    # the shortest rest is cut, so the next sequences get pieces of use
                    at = int(np.argmin(np.where(open_, left[order], 1 << 60)))
                    i = int(order[at])
                    length, loss = take(i, int(room[0]), int(room[2]))
                    if length <= 0:
                        break
                else:
                    break
                pieces.append(cut(i, length, loss))
                room -= (length, 1, loss)
                open_[at] = bool(alive[i])
                vectors[0, at], vectors[2, at] = left[i] / cap[0], loss_left[i] / cap[2]
            if not pieces:
                raise ValueError("a sequence must hold at least one token")
            yield pieces, room[0] > 0 and not open_.any()


def unpadded(pieces: list[tuple[int, int, int]], capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces as sequences whose lengths are powers of two or ``capacity``: these need no padding."""
    total = sum(p[2] for p in pieces)
    pieces = list(reversed(pieces))
    while total:
        size = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            example, start, length = pieces.pop()
            if length > size:
                pieces.append((example, start + size, length - size))
                length = size
            out.append((example, start, length))
            size -= length
        yield out


def pack(
    examples: DataFrame,
    vocabulary: str,
    limits: Limits = Limits(),
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of packed sequences.

    ``examples`` has ``doc_id`` and ``text``, whose tokens bear loss, and may
    have ``prompt``, whose tokens precede them and bear none; other columns are
    ignored.  ``end_id`` follows each example and bears loss.  Returns a row
    for each piece: its example, place in the example, place in its sequence,
    and with ``with_ids`` the ids as little-endian 32-bit bytes.  Sequences that
    are not full have lengths that are powers of two, which need no padding.

    Null and empty texts give an example of the end id alone.  Rows that
    repeat a doc_id (or have none) are examples of their own.  An empty table
    gives no rows.
    """
    prompted = "prompt" in examples.columns
    schema = PIECES + (", ids binary" if with_ids else "")
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # not kept beyond the task: the worker goes on to other work
        ids_of = TextIds(vocabulary, added_tokens(vocabulary))
        number = TaskContext.get().partitionId() * SEQUENCES
        # an example: doc_id, its ids, tokens without loss, tokens of it that are packed already
        held: list[tuple[int | None, bytes, int, int]] = []
        size = 0

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            if not held:
                return
            tokens = np.array([len(x[1]) // 4 - x[3] for x in held])
            free = np.array([max(x[2] - x[3], 0) for x in held])
            rows: list[tuple] = []

            def add(pieces):
                nonlocal number
                offset = 0
                for i, start, length in pieces:
                    doc, ids, plain, done = held[i]
                    start += done
                    part = ids[4 * start : 4 * (start + length)]
                    loss = max(start + length - max(start, plain), 0)
                    row = (doc, start, length, zlib.crc32(part), len(ids) // 4, number, offset, loss)
                    rows.append((*row, part) if with_ids else row)
                    offset += length
                number += 1

            kept: list[tuple[int, int, int]] = []
            for pieces, short in vector_bins(tokens, free, limits):
                if short and not last:
                    kept = pieces  # goes on with the next examples
                elif sum(p[2] for p in pieces) == limits.tokens:
                    add(pieces)
                else:
                    for part in unpadded(pieces, limits.tokens):
                        add(part)
            # a kept piece reaches to the end of its example
            held = [(held[i][0], held[i][1], held[i][2], held[i][3] + start) for i, start, _ in kept]
            size = sum(length for _, _, length in kept)
            if rows:
                types = [pa.int64()] * 8 + ([pa.binary()] if with_ids else [])
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            texts = batch.column("text")
            prompts = batch.column("prompt") if prompted else None
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                before = ids_of(prompts[i].as_py()) if prompted else b""
                ids = before + ids_of(texts[i].as_py()) + end
                held.append((doc, ids, len(before) // 4, 0))
                size += len(ids) // 4
                if len(held) >= BLOCK_EXAMPLES or size >= BLOCK_TOKENS:
                    yield from emit(False)
        yield from emit(True)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if prompted:
        columns.append(F.col("prompt").cast("string").alias("prompt"))
    return map_stream(examples.select(*columns), run, schema)
