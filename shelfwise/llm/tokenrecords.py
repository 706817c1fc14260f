"""Token ids as length-delimited binary records with an offset index (operator 11).

Every document is one record of a shard file::

    uint64  length of the payload       uint32  masked CRC-32C of the length
    payload                             uint32  masked CRC-32C of the payload

all little-endian.  The payload is ``int64 id, uint32 flags, uint32 ids`` and the
token ids, 16 bits each where the vocabulary allows, else 32; flag 1 marks a
null id, flag 2 ids of 32 bits.

Beside each shard lies an index file of one ``uint64`` offset a record, and the
table ``blocks`` of the folder lists stretches of records of at most about
``block_bytes`` with their place, so that readers take byte ranges, in order
(``read``) or record by record in any order (``read_shuffled``).

The documents are range-partitioned by id, so the shards follow each other in
ascending id; each task streams its rows into files of its own name, and only
files of committed tasks are in ``blocks``: a lost or repeated task leaves files
that no reader sees.  Files are written by ``pyarrow.fs`` into a folder that all
executors share.

Texts are encoded whole.  A text is cut where the tokenizer's pattern always ends a
match (see ``Encoder._cuts``), so its ids are those of its pieces; pieces are encoded
once per task and reused.

Defined cases: null and empty texts have no ids but the end id; null ids come
first; rows with equal ids follow each other in any order; an empty table gives
no shard and an empty result; other columns do not matter.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm import text as tx
from shelfwise.llm.components import _FREE_SHUFFLES
from shelfwise.llm.crc32c import crc32c, masked

NULL_ID, WIDE = 1, 2
#: 16-bit words before the ids of a record (frame 6, payload header 8) and after them
_HEAD, _TAIL = 14, 2
BLOCKS = ("part int, place int, file string, first long, records long, lo long, hi long, ids long")
_KEPT_PIECES = 1 << 20
#: bytes of texts encoded at once, so that pieces are looked up once for many uses
CHUNK_BYTES = 8 << 20
_LETTER, _DIGIT, _MARK, _SPACE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)               # 0: what the rules leave alone
_CLASS[0x21:0x7F] = _MARK
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Shuffle files of what runs inside are deleted when it ends."""
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


class Encoder:
    """A tokenizer of the tokenizers library over chunks of texts."""

    def __init__(self, path: str, specials_are_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_are_text
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self._whole = [] if specials_are_text else [
            t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _cuts(self, raw: np.ndarray) -> np.ndarray:
        """Bytes at which a piece may start.  The pattern's matches are letters,
        digits or other marks, each with at most one space before; white space; and
        an apostrophe with one or two letters.  Between ASCII characters a match
        therefore ends after a letter before anything else, after a digit before
        anything else, after a mark but the apostrophe before a letter or digit,
        before white space, and after a single line feed between visible characters."""
        cut = np.zeros(len(raw), bool)
        c = _CLASS[raw]
        a, b = c[:-1], c[1:]
        cut[1:] = (a != b) & (a > 0) & (b > 0) & (a != _SPACE) & ((raw[:-1] != 0x27) | (b == _SPACE))
        cut[2:] |= (raw[1:-1] == 0x0A) & (b[1:] > 0) & (b[1:] != _SPACE) & (c[:-2] > 0) & (c[:-2] != _SPACE)
        data = raw.tobytes() if self._whole else b""
        for token in self._whole:               # added tokens are matched before the pattern
            at = data.find(token)
            while at >= 0:
                cut[at + 1:at + len(token)] = False
                at = data.find(token, at + 1)
        return cut

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk, one after the other, and the ids per row."""
        rows = len(off) - 1
        start = self._cuts(raw)
        start[off[:-1][np.diff(off) > 0]] = True
        at = np.flatnonzero(start)
        if len(at) == 0:
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        edge = np.append(at, len(raw)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        if len(self._known) > _KEPT_PIECES:
            self._known.clear()
        new = [x for x in names if x not in self._known]
        fresh = dict(zip(new, self._encode(new), strict=True))
        got = [fresh[x] if x in fresh else self._known[x] for x in names]
        self._known.update((k, v) for k, v in fresh.items() if len(k) <= 64)
        code = pieces.indices.to_numpy()
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), np.uint32)
        n = size[code]
        done = np.concatenate(([0], np.cumsum(n)))
        pick = np.repeat((np.cumsum(size) - size)[code] - done[:-1], n) + np.arange(done[-1])
        row = np.searchsorted(at, off)
        return flat[pick], np.diff(done[row])


@lru_cache(2)
def _encoder(path: str, specials_are_text: bool) -> Encoder:
    return Encoder(path, specials_are_text)


def frame(doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, count: np.ndarray, wide: bool
          ) -> tuple[np.ndarray, np.ndarray]:
    """Records of a chunk as 16-bit words, and each record's first word."""
    width = 2 if wide else 1
    size = _HEAD + width * count + _TAIL
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint16)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        words = np.ascontiguousarray(values).view(np.uint16).reshape(len(at), -1)
        out[at[:, None] + np.arange(words.shape[1])] = words

    payload = 8 + width * count
    put(first, (2 * payload).astype(np.uint64))
    put(first + 4, masked(crc32c(out, first, np.full(len(first), 4))))
    put(first + 6, doc_ids.astype(np.int64))
    put(first + 10, (null * NULL_ID + wide * WIDE).astype(np.uint32))
    put(first + 12, count.astype(np.uint32))
    begin = np.cumsum(count) - count
    to = np.repeat(first + _HEAD - width * begin, count) + width * np.arange(len(ids))
    if wide:
        out[to], out[to + 1] = ids & 0xFFFF, ids >> 16
    else:
        out[to] = ids
    put(first + 6 + payload, masked(crc32c(out, first + 6, payload)))
    return out, first


class CorruptRecord(ValueError):
    """A length or checksum of a file does not fit its bytes."""


def unframe(data: bytes, at: np.ndarray, end: np.ndarray
            ) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token ids and ids per record of the records of ``data``
    from bytes ``at`` to ``end``; lengths and checksums are verified."""
    words = np.frombuffer(data, np.uint16)
    if len(at) == 0:
        return [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
    first = at // 2

    def take(place: np.ndarray, n: int, kind) -> np.ndarray:
        return np.ascontiguousarray(words[place[:, None] + np.arange(n)]).view(kind).ravel()

    payload = (end - at) // 2 - 8
    if (payload < 8).any() or (end > len(data)).any() or (
            take(first + 4, 2, np.uint32) != masked(crc32c(words, first, np.full(len(first), 4)))).any() or (
            take(first, 4, np.uint64) != 2 * payload.astype(np.uint64)).any():
        raise CorruptRecord("a record's length does not fit")
    if (take(first + 6 + payload, 2, np.uint32) != masked(crc32c(words, first + 6, payload))).any():
        raise CorruptRecord("a record's checksum does not fit")
    flags, count = take(first + 10, 2, np.uint32), take(first + 12, 2, np.uint32).astype(np.int64)
    ids = np.zeros(int(count.sum()), np.uint32)
    wide = (flags & WIDE) > 0
    begin = np.cumsum(count) - count
    for w, width in ((False, 1), (True, 2)):
        r = np.flatnonzero(wide == w)
        n = count[r]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        src = np.repeat(first[r] + _HEAD, n) + width * k
        ids[np.repeat(begin[r], n) + k] = words[src] if width == 1 else (
            words[src].astype(np.uint32) | words[src + 1].astype(np.uint32) << 16)
    doc = take(first + 6, 4, np.int64).tolist()
    return [None if f & NULL_ID else d for d, f in zip(doc, flags.tolist(), strict=True)], ids, count


class _Shard:
    """One shard file and its index, open for appending."""

    def __init__(self, folder: str, part: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        self.fs.create_dir(root, recursive=True)
        self.data = self.fs.open_output_stream(f"{root}/{self.name}")
        self.index = self.fs.open_output_stream(f"{root}/{self.name}.idx")
        self.size = self.records = 0

    def append(self, words: np.ndarray, first: np.ndarray) -> None:
        self.index.write((self.size + 2 * first).astype(np.uint64).tobytes())
        self.data.write(words.tobytes())
        self.size += 2 * len(words)
        self.records += len(first)

    def close(self) -> None:
        self.data.close()
        self.index.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None,
          specials_are_text: bool = False, shard_bytes: int = 256 << 20, block_bytes: int = 4 << 20,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the texts with the tokenizer file and write them in ascending id
    order; the table of blocks, which is also kept as Parquet in the folder."""
    spark = docs.sparkSession
    # rows of one id may fill a task, so the row number spreads them
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"),
                    F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), F.col("row")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, rows = TaskContext.get().partitionId(), 0, []
        enc, shard, block = _encoder(tokenizer, specials_are_text), None, None
        for batch in batches:
            key = batch.column(0)
            for lo, hi, raw, off in tx.text_chunks(batch, "t", CHUNK_BYTES):
                ids, count = enc.ids(raw, off)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(count), end_id).astype(np.uint32)
                    count = count + 1
                k = key.slice(lo, hi - lo)
                null = ~k.is_valid().to_numpy(zero_copy_only=False)
                words, first = frame(k.fill_null(0).to_numpy(), null, ids, count,
                                     enc.wide or (end_id or 0) >= 1 << 16)
                if shard is None:
                    shard = _Shard(folder, part)
                if block is None:
                    block = [part, place, shard.name, shard.records, 0, shard.size, 0, 0]
                shard.append(words, first)
                block[7] += len(ids)
                if shard.size - block[5] >= block_bytes:
                    block[4], block[6] = shard.records - block[3], shard.size
                    rows.append(block)
                    block, place = None, place + 1
                    if shard.size >= shard_bytes:
                        shard.close()
                        shard = None
        if block is not None:
            block[4], block[6] = shard.records - block[3], shard.size
            rows.append(block)
        if shard is not None:
            shard.close()
        types = [pa.int32(), pa.int32(), pa.string()] + [pa.int64()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)],
            names=[c.split()[0] for c in BLOCKS.split(", ")])

    with _shuffles_freed(spark):
        d.mapInArrow(run, BLOCKS).write.parquet(f"{folder}/blocks")
    return blocks(spark, folder)


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a folder, with the ids of all records before each (``base``)."""
    b = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # one row a writing task, then one row a block of the task
    tasks = b.groupBy("part").agg(F.sum("ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("task_base"))
    own = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return b.join(tasks, "part").withColumn(
        "base", F.col("task_base") + F.coalesce(F.sum("ids").over(own), F.lit(0))).drop("task_base")


def _offsets(fs: pafs.FileSystem, path: str, first: int, n: int) -> np.ndarray:
    with fs.open_input_file(f"{path}.idx") as f:
        return np.frombuffer(f.read_at(8 * n, 8 * first), np.uint64).astype(np.int64)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, start, ids)`` per record, ids as an array; ``start`` counts the ids
    of all records before it."""
    return _read(spark, folder, "ids array<long>",
                 lambda ids, count: [pa.ListArray.from_arrays(
                     pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()),
                     pa.array(ids.astype(np.int64)))])


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` per record, the CRC-32 over the ids
    as little-endian 32-bit integers."""
    def sums(ids: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        data, end = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(count)
        return [pa.array(count), pa.array([zlib.crc32(data[a:b]) for a, b in zip(
            (end - 4 * count).tolist(), end.tolist(), strict=True)], pa.int64())]

    return _read(spark, folder, "n_tokens long, ids_crc32 long", sums)


def _read(spark: SparkSession, folder: str, schema: str, columns, step: int = 1 << 20) -> DataFrame:
    names = ["id", "start", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for b in batch.to_pylist():
                path, at = f"{root}/{b['file']}", b["base"]
                off = np.append(_offsets(fs, path, b["first"], b["records"]), b["hi"])
                with fs.open_input_file(path) as f:
                    k = 0
                    while k < b["records"]:  # about a step of bytes at once, one record at least
                        e = max(k + 1, int(np.searchsorted(off, off[k] + step, "right")) - 1)
                        data = f.read_at(int(off[e] - off[k]), int(off[k]))
                        doc, ids, count = unframe(data, off[k:e] - off[k], off[k + 1:e + 1] - off[k])
                        start = at + np.cumsum(count) - count
                        at += int(count.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc, pa.int64()), pa.array(start), *columns(ids, count)], names=names)
                        k = e

    b = blocks(spark, folder).select("file", "first", "records", "hi", "base")
    return _spread(b).mapInArrow(run, f"id long, start long, {schema}")


def _spread(b: DataFrame) -> DataFrame:
    """Blocks, some to a task: their rows are tiny, so the number of tasks is given."""
    tasks = max(1, min(b.count() // 4, 100_000))
    return b.repartition(tasks, F.xxhash64("file", "first"))


def read_shuffled(spark: SparkSession, folder: str, seed: int = 0) -> DataFrame:
    """``(id, ids)`` of every record in an order that the seed draws over all
    shards: the index gives every record's place, the places are sorted by a
    seeded hash, and each task fetches its records one by one."""
    places_schema = "file string, lo long, hi long"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for b in batch.to_pylist():
                off = np.append(_offsets(fs, f"{root}/{b['file']}", b["first"], b["records"]), b["hi"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["file"]] * b["records"]), pa.array(off[:-1]), pa.array(off[1:])],
                    names=["file", "lo", "hi"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        held: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids_of, doc_of = [], []
                for b in batch.slice(lo, 256).to_pylist():
                    if b["file"] not in held:
                        if len(held) >= 64:
                            held.pop(next(iter(held))).close()
                        held[b["file"]] = fs.open_input_file(f"{root}/{b['file']}")
                    data = held[b["file"]].read_at(b["hi"] - b["lo"], b["lo"])
                    doc, ids, _ = unframe(data, np.array([0]), np.array([len(data)]))
                    doc_of += doc
                    ids_of.append(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_of, pa.int64()), pa.array(ids_of, pa.list_(pa.int64()))], names=["id", "ids"])

    b = blocks(spark, folder).select("file", "first", "records", "hi")
    spread = _spread(b).mapInArrow(places, places_schema)
    draw = F.xxhash64(F.lit(seed), "file", "lo")
    return (spread.withColumn("draw", draw).repartitionByRange("draw").sortWithinPartitions("draw")
            .select("file", "lo", "hi").mapInArrow(fetch, "id long, ids array<long>"))
