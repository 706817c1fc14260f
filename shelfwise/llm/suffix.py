"""Suffix-array removal of repeated byte strings (operator 10).

A byte goes when a ``length``-byte string that covers it also starts anywhere
else, in the same document or another.

1. Every window of ``length`` bytes has an anchor, its smallest ``GRAM``-byte
   hash (leftmost on ties), so equal windows have equal anchors at equal
   offsets.  Consecutive windows with one anchor form a block; blocks whose
   anchor occurs once in the corpus cannot repeat and leave.
2. Texts that occur in several rows are one text with a count, and blocks with
   equal content collapse to one representative with a count (partial sums
   before the shuffle, so a passage in a third of all documents is one row per
   task).  Texts and blocks are told apart by 128-bit hashes.
3. Where an anchor has several contents, their suffixes are sorted: a merge
   sort whose comparisons find the common extension of two suffixes by binary
   search over prefix polynomial hashes.  Neighbours that agree on ``length``
   bytes repeat; the bytes are compared, too, so that a hash collision cannot
   remove text.  Suffixes are bucketed by anchor and offset, as suffixes of
   different buckets share no window.
4. An anchor with more than ``max_contents`` contents (a common passage with
   many different surroundings) is not gathered in one task: its windows are
   counted by a 128-bit hash with partial aggregates, and the repeated ones are
   looked up where the blocks are (a broadcast of at most ``MAX_SENT`` hashes,
   else a join).  The result is the same, but for collisions of that hash.

Defined cases: null text is empty; texts shorter than ``length`` bytes keep
everything; repeated rows are documents of their own (so they repeat each
other); null ids are allowed; an empty table gives an empty result; a long
text is scanned in overlapping pieces, never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import text as tx
from shelfwise.llm.components import cut

GRAM = 40
PIECE = 8 << 20            # bytes of a long text that are scanned at once
_POS_BITS = 24
_POS = tx.U((1 << _POS_BITS) - 1)
MAX_SENT = 1 << 20         # window hashes of 16 bytes that may be broadcast


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have, m = 1, v
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        rest = width - have
        m = np.minimum(m[:-rest], m[rest:])
    return m


def _blocks(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Blocks of a chunk: start byte, windows, anchor offset, anchor hash."""
    none = np.zeros(0, np.int64)
    n_valid = np.maximum(np.diff(off) - (length - 1), 0)
    if not n_valid.any():
        return none, none, none, none
    s = tx.prefix_sums(raw)
    at = np.arange(len(raw) - GRAM + 1)
    gram = tx.mix(tx.slice_hash(s, at, at + GRAM))
    packed = (gram & ~_POS) | at.astype(tx.U)
    anchor = (_sliding_min(packed, length - GRAM + 1) & _POS).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int64)
    has = n_valid > 0
    edge[off[:-1][has]] += 1
    edge[off[:-1][has] + n_valid[has]] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(new)
    run = np.cumsum(new)[valid] - 1
    n_win = np.bincount(run, minlength=len(start))
    return start, n_win, anchor[start] - start, gram[anchor[start]].view(np.int64)


def blocks(docs: DataFrame, length: int) -> DataFrame:
    """``(th, tg, pos, n_win, at, a, c)``: the blocks of every text; ``a`` hashes
    the anchor, ``c`` the block's bytes, ``at`` is the anchor's offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            th, tg = batch.column(0), batch.column(1)
            for lo, _, raw, off in tx.text_chunks(batch, "t"):
                pieces = [(0, raw, off)]
                if len(off) == 2 and len(raw) > PIECE:
                    pieces = [(p, raw[p:p + PIECE + length - 1],
                               np.array([0, len(raw[p:p + PIECE + length - 1])]))
                              for p in range(0, len(raw), PIECE)]
                for shift, b, o in pieces:
                    start, n_win, at, a = _blocks(b, o, length)
                    if len(start) == 0:
                        continue
                    data = b.tobytes()
                    digest = xxhash.xxh3_128_digest
                    c = [digest(data[x:y]) for x, y in zip(
                        start.tolist(), (start + n_win + length - 1).tolist(), strict=True)]
                    row = np.searchsorted(o, start, "right") - 1
                    pick = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [th.take(pick), tg.take(pick), pa.array(start - o[row] + shift),
                         pa.array(n_win.astype(np.int32)), pa.array(at.astype(np.int32)),
                         pa.array(a), pa.array(c, pa.binary())],
                        names=["th", "tg", "pos", "n_win", "at", "a", "c"])

    return docs.select("th", "tg", "t").mapInArrow(
        run, "th long, tg long, pos long, n_win int, at int, a long, c binary")


class SuffixOrder:
    """Suffix comparisons over one buffer by hashed common extensions."""

    def __init__(self, buf: np.ndarray, length: int):
        self.buf, self.length = buf, length
        self.sums = tx.prefix_sums(buf)
        self.scale = tx.powers(tx._BASE, len(buf) + 1)

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at p and q, at most ``length``."""
        lo = np.zeros(len(p), np.int64)
        hi = np.full(len(p), self.length)
        sp, sq, kp, kq = self.sums[p], self.sums[q], self.scale[p], self.scale[q]
        for _ in range(int(self.length).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.sums[p + mid] - sp) * kp == (self.sums[q + mid] - sq) * kq
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, mid - 1)
            hi = np.maximum(hi, lo)
        return lo

    def order(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix at p against that at q over ``length`` bytes."""
        n = self.common(p, q)
        tie = n >= self.length
        at = np.minimum(n, self.length - 1)
        d = np.sign(self.buf[p + at].astype(np.int16) - self.buf[q + at])
        d[tie] = 0
        return d

    def merge_sort(self, pos: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sort the suffixes of every bucket (a run of ``pos`` from ``first``
        with ``size`` suffixes); all merges of one width run together."""
        out = pos.copy()
        t = np.arange(len(pos)) - first
        width = 1
        while True:
            live = np.flatnonzero(size > width)
            if len(live) == 0:
                return out
            f, sz, tt, x = first[live], size[live], t[live], out[live]
            run = tt // width
            lo0 = f + (run ^ 1) * width
            lo = np.minimum(lo0, f + sz)
            hi = np.minimum(lo0 + width, f + sz)
            base = lo.copy()
            right = (run & 1).astype(bool)
            while True:
                open_ = np.flatnonzero(lo < hi)
                if len(open_) == 0:
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                d = self.order(out[mid], x[open_])
                up = np.where(right[open_], d <= 0, d < 0)
                lo[open_[up]] = mid[up] + 1
                hi[open_[~up]] = mid[~up]
            to = f + (run & ~1) * width + (tt - run * width) + (lo - base)
            merged = out.copy()
            merged[to] = x
            out = merged
            width *= 2

    def repeats(self, pos: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Of the suffixes ``pos`` (sorted by ``bucket``), those whose first
        ``length`` bytes start at another suffix of the bucket; positions."""
        head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        n = np.diff(np.append(head, len(pos)))
        first, size = np.repeat(head, n), np.repeat(n, n)
        some = size > 1
        if not some.any():
            return pos[:0]
        keep = np.flatnonzero(some)
        shift = np.cumsum(~some)[keep]
        pos, bucket, first, size = pos[keep], bucket[keep], first[keep] - shift, size[keep]
        done = self.merge_sort(pos, first, size)
        near = np.flatnonzero(bucket[1:] == bucket[:-1])
        near = near[self.common(done[near], done[near + 1]) >= self.length]
        windows = np.lib.stride_tricks.sliding_window_view(self.buf, self.length)
        found = []
        for k in range(0, len(near), 1 << 14):
            i, j = done[near[k:k + (1 << 14)]], done[near[k:k + (1 << 14)] + 1]
            same = (windows[i] == windows[j]).all(axis=1)
            if not same.all():
                return self._by_bytes(pos, bucket)
            found += [i, j]
        return np.unique(np.concatenate(found)) if found else pos[:0]

    def _by_bytes(self, pos: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The same without hashes, for buffers in which two of them collide."""
        data, seen, out = self.buf.tobytes(), {}, set()
        for p, b in zip(pos.tolist(), bucket.tolist(), strict=True):
            other = seen.setdefault((b, data[p:p + self.length]), p)
            if other != p:
                out |= {p, other}
        return np.array(sorted(out), np.int64)


def _ranges(unit: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows: unit, first window, end window."""
    if len(w) == 0:
        return unit, w, w
    cutp = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (w[1:] != w[:-1] + 1))))
    last = np.append(cutp[1:], len(w)) - 1
    return unit[cutp], w[cutp], w[last] + 1


def _sort_units(t: pa.Table, length: int) -> pa.RecordBatch:
    """Repeated windows of the blocks of one or more anchors (sorted by ``a``)."""
    n_win = t["n_win"].to_numpy().astype(np.int64)
    data = t["bytes"].cast(pa.large_binary()).combine_chunks()
    off = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    buf = np.frombuffer(data.buffers()[2], np.uint8)[off[0]:off[-1]]
    off = off[:-1] - off[0]
    a = t["a"].to_numpy()
    group = np.cumsum(np.concatenate(([False], a[1:] != a[:-1])))
    unit = np.repeat(np.arange(len(n_win)), n_win)
    w = np.arange(len(unit)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    bucket = group[unit] * (2 * length) + (t["at"].to_numpy().astype(np.int64)[unit] - w + length)
    order = np.argsort(bucket, kind="stable")
    pos = off[unit] + w
    rep = SuffixOrder(buf, length).repeats(pos[order], bucket[order])
    u = np.searchsorted(off, rep, "right") - 1
    return _range_rows(t, *_ranges(u, rep - off[u]))


def _range_rows(t: pa.Table, u: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """``(a, c, lo, hi)`` of window ranges of units; a content that occurs more
    than once is repeated as a whole and needs none."""
    once = t["n"].to_numpy()[u] == 1
    pick = pa.array(u[once])
    return pa.RecordBatch.from_arrays(
        [t["a"].combine_chunks().take(pick), t["c"].combine_chunks().take(pick),
         pa.array(lo[once].astype(np.int32)), pa.array(hi[once].astype(np.int32))],
        names=["a", "c", "lo", "hi"])


def _sort_anchors(units: DataFrame, length: int, max_bytes: int = 1 << 20) -> DataFrame:
    """``(a, c, lo, hi)``: repeated window ranges of the given blocks, each
    anchor's blocks sorted in one task (their number is bounded by the caller)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in tx.released(batches):
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                held.append(part)
                size += part.nbytes
                if size < max_bytes:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                a = t["a"].to_numpy()
                whole = int(np.searchsorted(a, a[-1], "left"))
                if whole:
                    yield _sort_units(t.slice(0, whole), length)
                    held = t.slice(whole).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield _sort_units(pa.Table.from_batches(held), length)

    return (units.select("a", "c", "n_win", "at", "n", "bytes").repartition("a").sortWithinPartitions("a")
            .mapInArrow(run, "a long, c binary, lo int, hi int"))


def _windows(units: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Unit, place and 128-bit hash of every window of the units."""
    digest = xxhash.xxh3_128_digest
    n_win = units["n_win"].to_numpy().astype(np.int64)
    h = [digest(b[i:i + length]) for b, n in zip(units["bytes"].to_pylist(), n_win.tolist(), strict=True)
         for i in range(n)]
    unit = np.repeat(np.arange(len(n_win)), n_win)
    return unit, np.arange(len(unit)) - np.repeat(np.cumsum(n_win) - n_win, n_win), h


def _count_windows(units: DataFrame, length: int, max_sent: int = MAX_SENT) -> DataFrame:
    """The same for blocks of anchors with too many contents for one task:
    windows are counted by hash over the whole cluster."""
    units = units.select("a", "c", "n_win", "n", "bytes")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            for lo in range(0, batch.num_rows, 1000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_windows(batch.slice(lo, 1000), length)[2], pa.binary())], names=["h"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                unit, w, h = _windows(part, length)
                pick = pa.array(unit)
                yield pa.RecordBatch.from_arrays(
                    [part["a"].take(pick), part["c"].take(pick), part["n"].take(pick),
                     pa.array(w.astype(np.int32)), pa.array(h, pa.binary())], names=["a", "c", "n", "w", "h"])

    twice = cut(units.mapInArrow(hashes, "h binary").groupBy("h").agg(F.count(F.lit(1)).alias("k"))
                .filter("k > 1").select("h"))
    if twice.count() > max_sent:
        windows = units.mapInArrow(rows, "a long, c binary, n long, w int, h binary")
        return (windows.filter("n = 1").join(twice, "h")
                .select("a", "c", F.col("w").alias("lo"), (F.col("w") + 1).alias("hi")))
    sent = units.sparkSession.sparkContext.broadcast(frozenset(bytes(r.h) for r in twice.collect()))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                unit, w, h = _windows(part, length)
                hit = np.fromiter((x in sent.value for x in h), bool, len(h))
                yield _range_rows(pa.Table.from_batches([part]), *_ranges(unit[hit], w[hit]))

    return units.mapInArrow(ranges, "a long, c binary, lo int, hi int")


def _take_bytes(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """Representatives with the bytes of their blocks.  Each text is read once; a
    text in many rows is one row before the join."""
    want = reps.groupBy("th", "tg").agg(F.collect_list(
        F.struct("pos", "a", "c", "n_win", "at", "contents", "n")).alias("want"))
    texts = docs.groupBy("th", "tg").agg(F.first("t").alias("t"))
    schema = "a long, c binary, n_win int, at int, contents long, n long, bytes binary"
    fields = ("a", "c", "n_win", "at", "contents", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            for lo, hi, raw, off in tx.text_chunks(batch, "t"):
                want = batch.column(1).slice(lo, hi - lo)
                flat = want.flatten()
                row = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(want).to_numpy())
                start = off[row] + flat.field("pos").to_numpy()
                end = start + flat.field("n_win").to_numpy() + length - 1
                data = raw.tobytes()
                b = pa.array([data[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)],
                             pa.binary())
                yield pa.RecordBatch.from_arrays([*[flat.field(x) for x in fields], b], names=[*fields, "bytes"])

    return texts.join(want, ["th", "tg"]).select("t", "want").mapInArrow(run, schema)


def _hashes(text: Column) -> list[Column]:
    """Two 64-bit hashes that name a text."""
    return [F.xxhash64(text).alias("th"), F.xxhash64(F.lit("second"), text).alias("tg")]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), *_hashes(t), t.alias("t"))


def repeated_spans(docs: DataFrame, length: int = 200, max_contents: int = 4096,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(th, tg, spans)`` for the texts that repeat anything: byte ranges
    (unmerged) as an array of ``(lo, hi)``, one row a text, in however many rows of
    the documents it occurs."""
    d = _keyed(docs, id_col, text_col).filter(F.octet_length("t") >= length)
    # what is joined on an anchor comes from checkpoints, so that a hot one can be split
    common = cut(blocks(d, length).groupBy("a").agg(F.count(F.lit(1)).alias("k"))
                 .filter("k > 1").select("a"))
    b = cut(blocks(d, length).join(common, "a").groupBy("th", "tg", "pos").agg(
        F.first(F.struct("n_win", "at", "a", "c")).alias("b"), F.count(F.lit(1)).alias("n")).select(
        "th", "tg", "pos", "b.*", "n"))
    content = cut(b.groupBy("a", "c").agg(
        F.sum("n").alias("n"), F.min(F.struct("th", "tg", "pos", "n_win", "at")).alias("rep")))
    variety = cut(content.groupBy("a").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1"))
    reps = content.join(variety, "a").select("a", "c", "contents", "n", "rep.*")
    units = cut(_take_bytes(d, reps, length))
    parts = (_sort_anchors(units.filter(F.col("contents") <= max_contents), length)
             .union(_count_windows(units.filter(F.col("contents") > max_contents), length))
             .union(content.filter("n > 1").select("a", "c", F.lit(0), F.col("rep.n_win"))))
    ranges = cut(parts.groupBy("a", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("r")))
    # a text has at most one block a byte, a block at most length ranges
    spans = b.join(ranges, ["a", "c"]).select("th", "tg", F.transform(
        "r", lambda x: F.struct((F.col("pos") + x["lo"]).alias("lo"),
                                (F.col("pos") + x["hi"] + (length - 1)).alias("hi"))).alias("s"))
    return cut(spans.groupBy("th", "tg").agg(F.flatten(F.collect_list("s")).alias("spans")))


def _merge(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint maximal runs of ``(lo, hi)`` ranges."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _cut_out(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes left, the bytes removed and the number of runs removed."""
    if not spans:
        return text, 0, 0
    runs = _merge(np.array([(s["lo"], s["hi"]) for s in spans], np.int64))
    at, kept = 0, []
    for lo, hi in runs.tolist():
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return b"".join(kept), int((runs[:, 1] - runs[:, 0]).sum()), len(runs)


def removal_digest(docs: DataFrame, length: int = 200, max_contents: int = 4096,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``id, n_bytes, n_removed, n_spans, kept_sha256``."""
    d = _keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, length, max_contents, id_col, text_col)
    j = d.join(spans, ["th", "tg"], "left").select("id", "t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            n, gone, runs, sha = [], [], [], []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                text = (t.as_py() or "").encode()
                kept, removed, k = _cut_out(text, s.as_py())
                n.append(len(text))
                gone.append(removed)
                runs.append(k)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(sha, pa.string())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return j.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 200, max_contents: int = 4096,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their repeated bytes (a character cut in two goes
    whole); a document that loses all its bytes is dropped, documents without
    repeats stay as they are.  A column ``n_chars`` is set to the characters left,
    as a long."""
    spans = repeated_spans(docs, length, max_contents, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), *_hashes(
        F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    j = rows.join(spans, ["th", "tg"], "left")

    @F.arrow_udf("string")
    def left(t: pa.Array, s: pa.Array) -> pa.Array:
        out = pa.array([None if not y.is_valid else _cut_out(
            (x.as_py() or "").encode(), y.as_py())[0].decode("utf-8", "ignore")
            for x, y in zip(t, s, strict=True)], pa.string())
        tx.release()
        return out

    text = F.col(f"row.`{text_col}`").cast("string")
    touched = F.col("spans").isNotNull()
    # only texts that lose something go through Python, and no row is shuffled twice
    out = j.select("row", touched.alias("touched"), left(F.when(touched, text), "spans").alias("cut"))
    out = out.filter("not touched or cut != ''").select(
        "row", F.when(F.col("touched"), F.col("cut")).otherwise(text).alias("kept"))
    cols = [F.col("kept").alias(c) if c == text_col else
            F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`")
            for c in docs.columns]
    return out.select(*cols)
