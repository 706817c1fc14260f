"""Benchmark decontamination (operator 2).

Every item has the SimHash of its ``shingle``-word shingles.  A document is
read through windows as long as each item; a window's fingerprint is looked up
in a multi-index (``radius + 1`` bit blocks, one of which must agree within
the radius), and every fingerprint within the radius is verified by the exact
weighted-shingle similarity (sum of minima over sum of maxima of the shingle
counts).  Windows that hold too few of the benchmark's shingles to reach the
similarity are not fingerprinted: their similarity is known to be below it.

At the smallest similarity, 0.8, two windows differ in 9.7 of 64 bits on
average with a standard deviation of 2.9, so the default radius of 24 is five
deviations above; the similarity check decides.

The benchmark is the query set: its index is sent to the tasks in blocks of
at most ``BLOCK_BYTES`` of item text, each block against all documents.

Defined cases: null and empty texts and items match nothing; an item shorter
than ``shingle`` words counts as one shingle of all its words; a document
shorter than an item is one window; repeated rows are reported each; repeated
items (one id) as one; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import text as tx

BLOCK_BYTES = 32 << 20
_FILTER_BITS = 20
SCHEMA = "id long, th long, item_id long, position long, similarity double, distance int"


@dataclass
class SizeClass:
    """Items of one number of shingles."""

    size: int
    items: list[int] = field(default_factory=list)         # item ids
    counts: list[dict[int, int]] = field(default_factory=list)
    fps: np.ndarray | None = None
    blocks: list[dict[int, np.ndarray]] = field(default_factory=list)


def _fold(bits: np.ndarray) -> np.ndarray:
    """Fingerprints from signed bit sums ``(n, 64)``."""
    return np.packbits(bits > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit of each hash, ``(n, 64)``."""
    b = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return b.astype(np.int32) * 2 - 1


class ItemIndex:
    """Fingerprints, multi-index and shingle counts of a block of items."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int):
        self.shingle, self.radius = shingle, radius
        self.edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        #: per shingle length in words: the size classes
        self.classes: dict[int, dict[int, SizeClass]] = defaultdict(dict)
        vocab = defaultdict(set)
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = tx.words(raw, np.array([0, len(raw)]), tx.WORD_CHARS)
            k = min(shingle, len(w.start))
            if k == 0:
                continue
            h, _ = tx.shingle_hashes(w.hashes(), w.row, k)
            vocab[k].update(h.tolist())
            c = self.classes[k].setdefault(len(h), SizeClass(len(h)))
            ids, n = np.unique(h, return_counts=True)
            c.items.append(item_id)
            c.counts.append(dict(zip(ids.tolist(), n.tolist(), strict=True)))
            fp = _fold(_signs(h).sum(axis=0, keepdims=True))
            c.fps = fp if c.fps is None else np.concatenate([c.fps, fp])
        self.vocab = {k: np.sort(np.array(list(v), np.uint64)) for k, v in vocab.items()}
        self.filter = {}
        for k, v in self.vocab.items():
            f = np.zeros(1 << _FILTER_BITS, bool)
            f[(v >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.filter[k] = f
        for classes in self.classes.values():
            for c in classes.values():
                for b in range(radius + 1):
                    values = self._block(c.fps, b)
                    c.blocks.append({int(x): np.flatnonzero(values == x) for x in np.unique(values)})

    def _block(self, fp: np.ndarray, b: int) -> np.ndarray:
        lo, hi = self.edges[b], self.edges[b + 1]
        return (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def within(self, c: SizeClass, fps: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(window, item place, distance)`` of all items of the class within
        the radius, each once."""
        found = []
        for b, table in enumerate(c.blocks):
            values = self._block(fps, b)
            for x in np.unique(values).tolist():
                if x in table:
                    at = np.flatnonzero(values == x)
                    found.append(np.repeat(at, len(table[x])) * len(c.items) + np.tile(table[x], len(at)))
        if not found:
            return
        pair = np.unique(np.concatenate(found))
        win, item = pair // len(c.items), pair % len(c.items)
        d = np.bitwise_count(fps[win] ^ c.fps[item])
        near = d <= self.radius
        yield from zip(win[near].tolist(), item[near].tolist(), d[near].tolist(), strict=True)

    def hits(self, k: int, h: np.ndarray) -> np.ndarray:
        """Which shingles of ``k`` words occur in the benchmark."""
        maybe = np.flatnonzero(self.filter[k][(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        out = np.zeros(len(h), bool)
        v = self.vocab[k]
        at = np.minimum(np.searchsorted(v, h[maybe]), len(v) - 1)
        out[maybe] = v[at] == h[maybe]
        return out

    def search(self, k: int, h: np.ndarray, hit: np.ndarray, similarity: float
               ) -> dict[int, tuple[float, int, int]]:
        """Best window of one document per item id: ``(similarity, -first
        shingle, -distance)``."""
        best: dict[int, tuple[float, int, int]] = {}
        seen = np.concatenate(([0], np.cumsum(hit)))
        lo, hi = int(np.argmax(hit)), len(hit) - int(np.argmax(hit[::-1]))
        for m, c in self.classes[k].items():
            size = min(m, len(h))
            need = similarity * (m + size) / (1 + similarity) - 1e-9
            if seen[-1] < need:
                continue
            first = max(0, lo - size + 1)
            starts = np.arange(first, min(len(h) - size, hi - 1) + 1)
            starts = starts[seen[starts + size] - seen[starts] >= need]
            for part in range(0, len(starts), 4096):
                self._verify(c, h, starts[part:part + 4096], size, similarity, best)
        return best

    def _verify(self, c: SizeClass, h: np.ndarray, starts: np.ndarray, size: int,
                similarity: float, best: dict[int, tuple[float, int, int]]) -> None:
        # only the stretches the windows cover are summed
        gap = np.flatnonzero(np.diff(starts) > size) + 1
        for group in np.split(starts, gap):
            a = group[0]
            sums = np.zeros((group[-1] + size - a + 1, 64), np.int32)
            np.cumsum(_signs(h[a:group[-1] + size]), axis=0, out=sums[1:])
            fps = _fold(sums[group - a + size] - sums[group - a])
            for win, item, d in self.within(c, fps):
                s = int(group[win])
                want = c.counts[item]
                have: dict[int, int] = {}
                for x in h[s:s + size].tolist():
                    if x in want:
                        have[x] = have.get(x, 0) + 1
                both = sum(min(n, want[x]) for x, n in have.items())
                sim = both / (c.size + size - both)
                if sim >= similarity:
                    key = (sim, -s, -int(d))
                    item_id = c.items[item]
                    if item_id not in best or key > best[item_id]:
                        best[item_id] = key


def _matches(batch: pa.RecordBatch, ix: ItemIndex, similarity: float
             ) -> Iterator[tuple[int, int, int, float, int]]:
    """``(row, item id, position, similarity, distance)`` of the texts ``t`` of a batch."""
    for lo, _, raw, off in tx.text_chunks(batch, "t"):
        w = tx.words(raw, off, tx.WORD_CHARS)
        if len(w.start) == 0:
            continue
        wh = w.hashes()
        for k in ix.vocab:
            h, first = tx.shingle_hashes(wh, w.row, k)
            hit = ix.hits(k, h)
            row = w.row[first]
            for r in np.unique(row[hit]).tolist():
                a, b = np.searchsorted(row, [r, r + 1])
                for item, (s, p, d) in ix.search(k, h[a:b], hit[a:b], similarity).items():
                    yield lo + r, item, -p, s, -d


def _scan(docs: DataFrame, index, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            found = list(_matches(batch, index.value, similarity))
            rows, items, at, sims, dist = zip(*found, strict=True) if found else ((),) * 5
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(items, pa.int64()),
                 pa.array(at, pa.int64()), pa.array(sims, pa.float64()), pa.array(dist, pa.int32())],
                names=["id", "th", "item_id", "position", "similarity", "distance"])

    return docs.mapInArrow(run, SCHEMA)


def _indexes(benchmark: DataFrame, shingle: int, radius: int, item_col: str, item_text_col: str
             ) -> Iterator[Broadcast]:
    """The benchmark's index, in blocks of at most about ``BLOCK_BYTES`` of text."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"),
                             F.col(item_text_col).cast("string").alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = 1 + size // BLOCK_BYTES
    for b in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(n)) == b)
        index = ItemIndex([tuple(r) for r in block.toLocalIterator()], shingle, radius)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, shingle: int = 5,
                  radius: int = 24, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row ``(id, th, item_id, position, similarity, distance)`` per
    document row and benchmark item with a window of at least ``similarity``:
    the best window (the first on ties), its first word from 0 and its SimHash
    distance; ``th`` is the text's XXH64."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                    F.col(text_col).cast("string").alias("t"))
    out = None
    for index in _indexes(benchmark, shingle, radius, item_col, item_text_col):
        found = _scan(d, index, similarity)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, shingle: int = 5,
                      radius: int = 24, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """The documents without a benchmark passage; every row is judged where it
    is read, nothing is shuffled."""
    def clean(index: Broadcast):
        @F.arrow_udf("boolean")
        def no_match(t: pa.Array) -> pa.Array:
            batch = pa.RecordBatch.from_arrays([t], names=["t"])
            out = np.ones(len(t), bool)
            out[[m[0] for m in _matches(batch, index.value, similarity)]] = False
            tx.release()
            return pa.array(out)
        return no_match

    for index in _indexes(benchmark, shingle, radius, item_col, item_text_col):
        docs = docs.filter(clean(index)(F.col(text_col).cast("string")))
    return docs
