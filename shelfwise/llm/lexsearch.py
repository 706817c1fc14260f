"""Ranked lexical search by dual trees (operator 12).

Every item of a query set gets its ``k`` documents of highest score, exactly.  A
score is a sum over the item's terms of the term's weight times the document's
saturated term frequency (integers, see ``saturation``), the inner product of an
item vector and a document vector with no negative coordinate.

1. One pass counts the documents, their terms, and the documents that hold each
   term of the items.
2. The items form a hierarchy; every node holds the largest value of each
   coordinate below it.  The hierarchy is sent to the tasks.
3. A task reads its documents in groups, each a hierarchy with coordinate maxima
   as well.  Both trees are walked together: the inner product of two nodes'
   maxima bounds every score between them, and a pair of nodes is dropped once its
   bound is below the weakest kth score of the node's items.  Pairs of leaves are
   scored in falling order of their bounds, so the kth scores rise early; they are
   kept from group to group.
4. A task returns at most ``k`` documents an item; the best of all tasks are ranked.

Coordinates and sums are integers below 2^53 in doubles, so bounds and scores are
exact (larger ones are computed in 64-bit integers).  Words are looked up by hash
and compared as bytes.

The items are a query set: they are sent in blocks of at most ``BLOCK_BYTES`` of
text, each block against all documents; inside a block, trees hold at most
``TREE_ITEMS`` items.

Defined cases: null and empty texts have no terms; an item without a term that
occurs has no rows; every row of the items is an item, repeated ids too; rows of
one document id are ranked each; null document ids come last among equal scores;
an empty table on either side gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import text as tx

BLOCK_BYTES = 8 << 20
TREE_ITEMS = 512
ITEM_LEAF = 8
DOC_LEAF = 16
FANOUT = 4
#: bytes of one group's dense coordinates
GROUP_BYTES = 24 << 20
_FILTER_BITS = 18
_EXACT = 1 << 53
#: fixed values of the score: share of the length in a document's weight (of 100),
#: and the scale of frequencies, weights and lengths
LENGTH_SHARE, SCALE, LENGTH_SCALE = 75, 1000, 8


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (SCALE * tf + LENGTH_SCALE * m)


def length_weight(n: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    """``100 - 75 + 75 n N div L``, whose product may exceed 64 bits on the way."""
    return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * x * n_docs // max(n_terms, 1) for x in n], np.int64)


def _words(raw: np.ndarray, off: np.ndarray) -> tx.Words:
    return tx.words(raw, off, tx.WORD_CHARS)


class Vocabulary:
    """The items' terms, found in documents by hash and compared as bytes."""

    def __init__(self, terms: list[bytes]):
        raw = np.frombuffer(b" ".join(terms), np.uint8)
        w = _words(raw, np.array([0, len(raw)]))
        order = np.argsort(w.hashes(), kind="stable")
        self.hash = w.hashes()[order]
        self.buf, self.start, self.end = w.buf, w.start[order], w.end[order]
        #: place of each of ``terms``
        self.place = {terms[t]: i for i, t in enumerate(order.tolist())}
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.hash)] = True

    def __len__(self) -> int:
        return len(self.hash)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def find(self, w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
        """Words of the vocabulary: their numbers in ``w`` and their terms.  (Terms
        of one hash are searched one after the other.)"""
        h = w.hashes()
        at = np.flatnonzero(self.filter[self._slot(h)])
        k = np.searchsorted(self.hash, h[at])
        words, terms = [], []
        while len(at):
            k_ = np.minimum(k, len(self.hash) - 1)
            same = (k < len(self.hash)) & (self.hash[k_] == h[at])
            at, k = at[same], k[same]
            eq = self._equal(w, at, k)
            words.append(at[eq])
            terms.append(k[eq])
            at, k = at[~eq], k[~eq] + 1
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(words), np.concatenate(terms)

    def _equal(self, w: tx.Words, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        size = w.end[at] - w.start[at]
        out = size == self.end[k] - self.start[k]
        some = np.flatnonzero(out)
        n = size[some]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        diff = (w.buf[np.repeat(w.start[at[some]], n) + step]
                != self.buf[np.repeat(self.start[k[some]], n) + step])
        if diff.any():
            out[some[np.repeat(np.arange(len(some)), n)[diff]]] = False
        return out


def item_terms(text: str | None) -> Counter:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    w = _words(raw, np.array([0, len(raw)]))
    data = w.buf.tobytes()
    return Counter(data[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True))


def _order_alike(m: np.ndarray) -> np.ndarray:
    """Rows in a chain, each followed by the row most like it of those left."""
    unit = m / np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1)[:, None]
    like = unit @ unit.T
    left = np.ones(len(m), bool)
    order = [0]
    for _ in range(len(m) - 1):
        left[order[-1]] = False
        order.append(int(np.where(left, like[order[-1]], -1.0).argmax()))
    return np.array(order)


class Hierarchy:
    """Rows in leaves of ``leaf``, ``FANOUT`` nodes a parent; ``maxima[0]`` are the
    leaves' coordinate maxima, the last level is the root's."""

    def __init__(self, rows: np.ndarray, leaf: int):
        self.leaf = leaf
        self.maxima = [np.maximum.reduceat(rows, np.arange(0, len(rows), leaf))]
        while len(self.maxima[-1]) > 1:
            top = self.maxima[-1]
            self.maxima.append(np.maximum.reduceat(top, np.arange(0, len(top), FANOUT)))

    def at(self, level: int) -> np.ndarray:
        """Maxima at a level; levels above the root are the root."""
        return self.maxima[min(level, len(self.maxima) - 1)]

    def parent(self, level: int) -> np.ndarray:
        """Of each node of a level, the node of the next."""
        n = len(self.at(level))
        return np.arange(n) // FANOUT if level < len(self.maxima) - 1 else np.zeros(n, np.int64)


class ItemTree:
    """A hierarchy of items over their own terms, and the best documents so far."""

    def __init__(self, rows: list[int], counts: list[Counter], vocab: Vocabulary, weight: np.ndarray, k: int):
        used = np.unique(np.array([vocab.place[t] for c in counts for t in c], np.int64))
        #: column of each term of the vocabulary, -1 if no item here holds it
        self.column = np.full(len(vocab), -1)
        self.column[used] = np.arange(len(used))
        vec = np.zeros((len(rows), len(used)), np.int64)
        for i, c in enumerate(counts):
            for t, n in c.items():
                p = vocab.place[t]
                vec[i, self.column[p]] = n * weight[p]
        # a coordinate of a document is below 10^6
        kind = np.float64 if vec.sum(axis=1).max(initial=0) * 1_000_000 < _EXACT and (
            vec.max(axis=0, initial=0).sum() * 1_000_000 < _EXACT) else np.int64
        order = _order_alike(vec.astype(np.float64))
        self.rows = [rows[i] for i in order]
        self.vec = vec[order].astype(kind)
        self.tree = Hierarchy(self.vec, ITEM_LEAF)
        leaves = [self.vec[a:a + ITEM_LEAF] for a in range(0, len(order), ITEM_LEAF)]
        self.cols = [np.flatnonzero(x.any(axis=0)) for x in leaves]
        self.part = [x[:, c] for x, c in zip(leaves, self.cols, strict=True)]
        self.k = k
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in rows]
        self.kth = np.zeros(len(rows), kind)
        #: leaf pairs scored and leaf pairs in all
        self.scored = self.pairs = 0

    def search(self, docs: np.ndarray, null: np.ndarray, rows: np.ndarray, terms: np.ndarray,
               value: np.ndarray) -> None:
        """Walk the items against a group of documents: ids and entries
        ``(document, term, value)``."""
        col = self.column[terms]
        here = col >= 0
        m = np.zeros((len(docs), self.vec.shape[1]), self.vec.dtype)
        m[rows[here], col[here]] = value[here]
        # documents that score best against the same leaf of items lie together
        likeness = m @ self.tree.maxima[0].T
        lead = likeness.argmax(axis=1)
        order = np.lexsort((-likeness[np.arange(len(m)), lead], lead))
        m, docs, null = m[order], docs[order], null[order]
        tree = Hierarchy(m, DOC_LEAF)
        items, level = self.tree, max(len(self.tree.maxima), len(tree.maxima)) - 1
        live = np.ones((1, 1), bool)
        self.pairs += len(items.maxima[0]) * len(tree.maxima[0])
        while True:
            # nodes without a live pair stay out of the product
            r, c = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
            if len(r) == 0:
                return
            bound = np.zeros(live.shape, m.dtype)
            bound[np.ix_(r, c)] = items.at(level)[r] @ tree.at(level)[c].T
            live &= (bound > 0) & (bound >= self._weakest(level)[:, None])
            if level == 0:
                break
            level -= 1
            live = live[np.ix_(items.parent(level), tree.parent(level))]
        i, d = np.nonzero(live)
        for p in np.argsort(-bound[i, d], kind="stable").tolist():
            a, b = int(i[p]), int(d[p])
            first, at = a * ITEM_LEAF, slice(b * DOC_LEAF, (b + 1) * DOC_LEAF)
            part = self.part[a]
            if bound[a, b] < self.kth[first:first + len(part)].min():
                continue
            self.scored += 1
            score = part @ m[at][:, self.cols[a]].T
            self._offer(first, score, docs[at], null[at])

    def _weakest(self, level: int) -> np.ndarray:
        """Of each item node of a level, the weakest kth score below it."""
        size = ITEM_LEAF * FANOUT ** min(level, len(self.tree.maxima) - 1)
        return np.minimum.reduceat(self.kth, np.arange(0, len(self.kth), size))

    def _offer(self, first: int, score: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        good = (score > 0) & (score >= self.kth[first:first + len(score), None])
        for r in np.flatnonzero(good.any(axis=1)).tolist():
            got = np.flatnonzero(good[r])
            best = self.best[first + r]
            best += [(-int(s), bool(n), int(x)) for s, n, x in zip(
                score[r, got].tolist(), null[got].tolist(), docs[got].tolist(), strict=True)]
            best.sort()
            del best[self.k:]
            if len(best) == self.k:
                self.kth[first + r] = -best[-1][0]

    def results(self) -> Iterator[tuple[int, int | None, int]]:
        for row, best in zip(self.rows, self.best, strict=True):
            for s, n, x in best:
                yield row, None if n else x, -s


def _entries(vocab: Vocabulary, raw: np.ndarray, off: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per document, and ``(document, term, frequency)`` of the vocabulary's terms."""
    w = _words(raw, off)
    at, term = vocab.find(w)
    key, tf = np.unique(w.row[at] * max(len(vocab), 1) + term, return_counts=True)
    return w.count, key // max(len(vocab), 1), key % max(len(vocab), 1), tf


def _statistics(docs: DataFrame, vocab: Broadcast) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms, and documents per vocabulary term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        total, df = [0, 0], np.zeros(len(v), np.int64)
        for batch in batches:
            for _, _, raw, off in tx.text_chunks(batch, "t"):
                n, _, term, _ = _entries(v, raw, off)
                total[0] += int((n > 0).sum())
                total[1] += int(n.sum())
                df += np.bincount(term, minlength=len(v))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], some]), pa.int64()),
             pa.array(np.concatenate([total, df[some]]), pa.int64())], names=["term", "n"])

    rows = (docs.select("t").mapInArrow(run, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())  # a row per vocabulary term
    found = {r.term: r.n for r in rows}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(vocab.value))], np.int64)


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most about ``BLOCK_BYTES`` of text."""
    d = items.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null")
    size = d.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = 1 + size // BLOCK_BYTES
    for b in range(n):
        block = d if n == 1 else d.filter(F.pmod(F.xxhash64("t", F.col("i").cast("string")), F.lit(n)) == b)
        rows = [tuple(r) for r in block.toLocalIterator()]
        if rows:
            yield sorted(rows, key=lambda r: (str(r[0]), r[1]))


def _scan(docs: DataFrame, vocab: Broadcast, trees: Broadcast, n_docs: int, n_terms: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, forest = vocab.value, copy.deepcopy(trees.value)
        widest = max(t.vec.shape[1] for t in forest)
        group = max(4 * DOC_LEAF, GROUP_BYTES // (8 * max(widest, 1)))
        held, size = [], 0

        def flush() -> None:
            nonlocal size
            if held:
                shift = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
                docs_, null, rows, terms, value = (np.concatenate(x) for x in zip(*[
                    (h[0], h[1], h[2] + s, h[3], h[4]) for h, s in zip(held, shift.tolist(), strict=True)],
                    strict=True))
                for tree in forest:
                    tree.search(docs_, null, rows, terms, value)
            held.clear()
            size = 0

        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, off in tx.text_chunks(batch, "t"):
                n, row, term, tf = _entries(v, raw, off)
                some, row = np.unique(row, return_inverse=True)  # documents without a term score nothing
                if len(some) == 0:
                    continue
                m = length_weight(n[some].tolist(), n_docs, n_terms)
                key = ids.slice(lo, hi - lo).take(pa.array(some))
                held.append((key.fill_null(0).to_numpy(), ~key.is_valid().to_numpy(zero_copy_only=False),
                             row, term, saturation(tf, m[row])))
                size += len(some)
                if size >= group:
                    flush()
        flush()
        out = [r for t in forest for r in t.results()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)],
            names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` documents of highest
    score above 0, equal scores by ascending document id."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = dict(items.dtypes)[item_col]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(items, item_col, item_text_col):
        counts = [item_terms(t) for _, t in block]
        vocab = Vocabulary(sorted({t for c in counts for t in c}))
        if len(vocab) == 0:
            continue
        sent = spark.sparkContext.broadcast(vocab)
        n_docs, n_terms, df = _statistics(d, sent)
        weight = np.array([term_weight(n_docs, int(x)) for x in df], np.int64)
        rows = [i for i, c in enumerate(counts) if c]
        trees = spark.sparkContext.broadcast([
            ItemTree(part, [counts[i] for i in part], vocab, weight, k)
            for part in (rows[a:a + TREE_ITEMS] for a in range(0, len(rows), TREE_ITEMS))])
        found = _scan(d, sent, trees, n_docs, n_terms)
        # the best of a share of the tasks, then of all
        rank = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("share", F.spark_partition_id() % 64)
        for keys in (["item", "share"], ["item"]):
            found = found.withColumn("rank", F.row_number().over(
                Window.partitionBy(*keys).orderBy(*rank))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item long, item_id {kind}")
        out = out.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
