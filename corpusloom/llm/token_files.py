"""Token ids of a corpus as files of fixed-width bit-packed blocks.

A corpus is written in ascending doc_id order as Parquet tables below one
folder.  Each row of ``segments`` is a run of whole documents of one shard:

* ``shard, at, n``: its shard, the ids of the shard before it, its ids;
* ``width``: bits of an id, the fewest that hold the largest id of the vocabulary;
* ``offsets``: byte offset of each block of BLOCK_IDS ids in ``data``, as little-endian 64-bit numbers;
* ``data``: the blocks, each a little-endian bit string that starts at a byte;
* ``doc_ids, lengths``: its documents and their ids.

``shards`` has a row for each shard: ``shard, first, n``, where ``first`` is
the number of ids in all shards before it.  So a place in the corpus leads to a shard, a
segment, a block and a bit by arithmetic, and a document is read without its neighbours.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import bytes_of, lookup, map_batches, map_stream

# Ids of a block, of which the last of a segment may have fewer.
BLOCK_IDS = 4096
# A segment ends with the document that brings it to this many ids.
SEGMENT_IDS = 1 << 18
# Text of a shard, about.
SHARD_BYTES = 64_000_000
# Pieces of text whose ids a task remembers.
REMEMBERED = 150_000

# Text that is cut and looked up at a time.
PART_BYTES = 8_000_000
# Pieces that are taken apart at a time.
LEARNED = 20_000

# Texts whose spaces do not all stand between two characters that are not white space, or that hold other white space.
_ODD_SPACES = "  | \n|\n |\\A | \\z|[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The places beside those spaces where a token always starts.
_INNER_CUT = re.compile(r"(?<=\S)(\n)(?=\S)|(?<=[A-Za-z])(?=[.,;:!?])").split
# Letters of Latin scripts, with or without a space before them: one token of the pre-tokeniser.
_LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the rest from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


SEGMENTS = (
    "shard int, at long, n long, width int, offsets binary, data binary, doc_ids array<long>, lengths array<long>"
)


def bit_width(vocabulary_size: int) -> int:
    """Fewest bits, at least one, that hold every id below ``vocabulary_size``."""
    return max((vocabulary_size - 1).bit_length(), 1)


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """Ids as a little-endian bit string of ``width`` bits each, filled up to a whole byte."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack_ids(data: bytes | memoryview, width: int, at: int, count: int) -> np.ndarray:
    """``count`` ids of a bit string, from its id number ``at`` on; only their bytes are looked at."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, at * width // 8).astype(np.uint32)
    bit = np.arange(at, at + count, dtype=np.int64) * width
    low = at * width // 8
    raw = np.frombuffer(data, np.uint8, min(((at + count) * width + 7) // 8, len(data)) - low, low)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    byte, out = bit // 8 - low, np.zeros(count, dtype=np.uint64)
    # an id and the bits before it in its first byte lie in at most five bytes
    for k in range((width + 14) // 8):
        out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (bit % 8).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray, width: int) -> tuple[bytes, bytes]:
    """Block offsets and blocks of a segment."""
    blocks = [pack_ids(ids[i : i + BLOCK_IDS], width) for i in range(0, len(ids), BLOCK_IDS)]
    sizes = np.array([0, *map(len, blocks)], dtype="<u8")
    return np.cumsum(sizes)[:-1].astype("<u8").tobytes(), b"".join(blocks)


def read_blocks(offsets: bytes, data: bytes, width: int, n: int, at: int, count: int) -> np.ndarray:
    """``count`` of the ``n`` ids of a segment from ``at`` on; only the blocks they lie in are unpacked."""
    if not count:
        return np.zeros(0, dtype=np.uint32)
    starts, view = np.frombuffer(offsets, "<u8"), memoryview(data)
    parts = []
    for block in range(at // BLOCK_IDS, (at + count - 1) // BLOCK_IDS + 1):
        first = block * BLOCK_IDS
        low, high = max(at - first, 0), min(at + count - first, BLOCK_IDS, n - first)
        parts.append(unpack_ids(view[int(starts[block]) :], width, low, high - low))
    return np.concatenate(parts)


class TokenizerIds:
    """Ids of whole texts by a tokenizer of the ``tokenizers`` library without special tokens.

    The pre-tokeniser of a byte-level BPE always starts a token

    * at a space between two characters that are not white space,
    * at, and after, a line feed between two such characters,
    * at a mark ``.,;:!?`` that follows an ASCII letter.

    Texts are cut there, and every different piece is encoded once: words of Latin letters by the model itself, others by the
    whole tokenizer.  The ids of a bounded number of pieces are remembered.  Texts
    with an added token or other white space are encoded whole, as are those of any other kind of tokenizer.
    """

    def __init__(self, path: str):
        import json
        import os

        # a task has one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.tokenizer = Tokenizer.from_str(text)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD_SPACES, *map(re.escape, added)])
        parts = json.loads(text)
        before = parts["pre_tokenizer"] or {}
        self.cuts = (
            parts["model"]["type"] == "BPE"
            and parts["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and not parts["truncation"]
            and not parts["padding"]
        )
        self.letters = _byte_letters()
        # ids of pieces and their parts; a space before them belongs to them
        self.known: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are not cut."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces, added to those that are known."""
        known, fresh, joined, hard = self.known, {}, [], []
        for piece in itertools.filterfalse(known.__contains__, pieces):
            if _LETTERS(piece, 1 if piece[:1] == " " else 0):
                fresh[piece] = None
                continue
            parts = [x for x in _INNER_CUT(piece) if x]
            for x in parts:
                if x not in known:
                    if _LETTERS(x, 1 if x[:1] == " " else 0):
                        fresh[x] = None
                    else:
                        hard.append(x)
            if len(parts) != 1:
                joined.append((piece, parts))
        tokens, letters = self.model.tokenize, self.letters
        for word in fresh:
            if word.isascii():
                byte_word = "\u0120" + word[1:] if word[0] == " " else word
            else:
                byte_word = word.encode().decode("latin-1").translate(letters)
            known[word] = array("I", [t.id for t in tokens(byte_word)]).tobytes()
        hard = list(dict.fromkeys(hard))
        known.update(zip(hard, self.encoded(hard)))
        for piece, parts in joined:
            known[piece] = b"".join([known[x] for x in parts])

    def _of_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose spaces are all fit to cut at, and how many each text has."""
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        # the first piece of a text has no space before it
        heads = coded.dictionary.take(pa.array(number[starts[:-1]])).to_pylist()
        led = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string()))
        pieces = led.to_numpy(zero_copy_only=False).tolist() + heads
        number[starts[:-1]] = np.arange(len(heads)) + len(pieces) - len(heads)
        del cut, coded, led
        for low in range(0, len(pieces), LEARNED):
            self._learn(pieces[low : low + LEARNED])
        ids = [self.known[p] for p in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), "<u4")
        del pieces, ids
        while len(self.known) > REMEMBERED:
            # the oldest stay, as frequent pieces are met early
            self.known.popitem()
        counts = size[number]
        after = np.cumsum(counts)
        # fewer ids than bytes, of which an array of texts has less than 2**31
        places = (first[number] - after + counts).astype(np.int32)
        at = np.arange(after[-1] if len(after) else 0, dtype=np.int32) + np.repeat(places, counts)
        ends = np.concatenate([[0], after])[starts[1:]]
        return flat[at], np.diff(ends, prepend=0)

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit bytes; none of an empty or null one."""
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        after = np.cumsum(pc.binary_length(texts).to_numpy())
        low = 0
        while low < len(texts):
            reach = (after[low - 1] if low else 0) + PART_BYTES
            high = max(int(np.searchsorted(after, reach, side="right")), low + 1)
            part = texts.slice(low, high - low)
            whole = pc.match_substring_regex(part, self.odd) if self.cuts else pa.array([True] * len(part))
            ids, counts = self._of_pieces(part.filter(pc.invert(whole)))
            of_whole = iter(self.encoded(part.filter(whole).to_pylist()))
            data, ends, at = ids.tobytes(), (4 * np.cumsum(counts)).tolist(), 0
            cut = iter(ends)
            for odd in whole.to_pylist():
                if odd:
                    yield next(of_whole)
                else:
                    end = next(cut)
                    yield data[at:end]
                    at = end
            low = high


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and texts of documents in runs of batches of about PART_BYTES, as more of their pieces are then the same."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(b.nbytes for b in held) >= PART_BYTES):
            doc_ids, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text"))
            batch, held = None, []
            yield doc_ids.to_pylist(), texts


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES
) -> None:
    """Write the ids of all whole texts of ``docs`` (doc_id, text) to ``path``, which must not exist.

    ``tokenizer`` is a file of the ``tokenizers`` library; ``end_id`` follows
    each document.  Documents are dealt by ranges of doc_id to shards of about
    ``shard_bytes`` of text and sorted in each, so a task holds one segment.

    Null and empty texts have the end id alone.  Rows without a doc_id come
    first.  Rows that repeat a doc_id are documents each, in the order of a
    hash of their texts; as equal rows are told apart by their place in the
    scan, they may be spread over shards.  Other columns are left out.  An
    empty table gives files without rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    shards = max(-(-bytes_of(rows, "text")[1] // shard_bytes), 1)
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, shard, at = TokenizerIds(tokenizer), TaskContext.get().partitionId(), 0
        width = bit_width(max(ids_of.size, end_id + 1))
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            offsets, data = pack_blocks(ids, width)
            columns = [
                pa.array([shard], pa.int32()), pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([width], pa.int32()), pa.array([offsets], pa.binary()), pa.array([data], pa.binary()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SEGMENTS.split(", ")])

        for docs_of_part, texts in _parts(batches):
            for doc, ids in zip(docs_of_part, ids_of(texts)):
                doc_ids.append(doc)
                held.append(ids + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield segment()
                    at, size, doc_ids, held = at + size, 0, [], []
        if held:
            yield segment()

    spark = docs.sparkSession
    map_stream(ordered, run, SEGMENTS).write.parquet(f"{path}/segments")
    # one row for each shard, of which there are as many as tasks wrote
    totals = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    totals.select("shard", first, "n").coalesce(1).write.parquet(f"{path}/shards")


def _placed(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Segments with ``start``, the ids of the corpus before them, and ``columns``."""
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    shards = spark.read.parquet(f"{path}/shards").select("shard", "first")
    met = lookup(segments, shards, ["shard"], 16 * shards.count())
    return met.select((F.col("first") + F.col("at")).alias("start"), *columns)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files at ``path``.

    ``start`` counts the ids of all documents before it and ``ids_crc32`` is
    the checksum of its ids as little-endian 32-bit numbers, which ``ids``
    holds, if ``with_ids``.  Segments are read where they lie; nothing is shuffled.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                width, n = row["width"].as_py(), row["n"].as_py()
                offsets, data = row["offsets"].as_py(), row["data"].as_py()
                lengths = row["lengths"].values.to_numpy()
                after = np.cumsum(lengths)
                view = memoryview(read_blocks(offsets, data, width, n, 0, n).astype("<u4").tobytes())
                parts = [view[4 * (a - c) : 4 * a] for a, c in zip(after.tolist(), lengths.tolist())]
                columns = [
                    row["doc_ids"].values,
                    pa.array(row["start"].as_py() + after - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    columns = ["n", "width", "offsets", "data", "doc_ids", "lengths"]
    return map_stream(_placed(spark, path, *columns), run, schema)


def read_places(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """``position, id`` of ``count`` ids of the corpus from place ``first`` on, fewer at its end.

    Only the segments that hold them leave the scan, and of these only the
    blocks that hold them are unpacked.
    """
    end = first + count

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
        for row in batch.to_pylist():
            low, high = max(first - row["start"], 0), min(end - row["start"], row["n"])
            if low < high:
                found.append(read_blocks(row["offsets"], row["data"], row["width"], row["n"], low, high - low))
                places.append(np.arange(low, high) + row["start"])
        columns = [pa.array(np.concatenate(places)), pa.array(np.concatenate(found).astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["position", "id"])

    shards = spark.read.parquet(f"{path}/shards")
    within = shards.where((F.col("first") < end) & (F.col("first") + F.col("n") > first)).select("shard", "first")
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    met = lookup(segments, within, ["shard"], 16 * within.count(), "inner")
    start = F.col("first") + F.col("at")
    met = met.where((start < end) & (start + F.col("n") > first))
    return map_batches(met.select(start.alias("start"), "n", "width", "offsets", "data"), run, "position long, id long")
