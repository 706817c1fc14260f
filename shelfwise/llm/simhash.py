"""SimHash near-duplicates: BK-trees over sharded fingerprints (operator 4).

Fingerprint: every ``shingle``-word run of the lower-cased text votes with its
XXH64; a bit is 1 when set in more than half of the votes.

Links: two fingerprints within ``max_bits`` differ in at most ``max_bits`` of
``max_bits + 2`` bit blocks, so two whole blocks agree.  Every pair of blocks
is a shard key; a shard holds the distinct fingerprints that agree on those
two blocks, and its BK-tree (children keyed by the integer distance to their
parent) is searched along the edges within the radius.  All shard trees of a
task are built and searched together, level by level, as numpy arrays.  A
shard above ``max_shard`` is cut into parts and every pair of parts becomes a
unit of its own, so a task never holds more than two parts and no link is
lost.  Each unit returns a spanning star per linked group, not its pairs.

The trees are not broadcast: together they hold every distinct fingerprint,
which has no size bound; members and queries meet in the same shard instead.

Defined cases: null or empty text and text without a word has fingerprint
zero, linked like any other; fewer words than ``shingle`` count as one
shingle; repeated rows and ids link as ordinary rows; a null id never becomes
a component id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import text as tx
from shelfwise.llm.components import connected_components, cut

SEED = 42
_LANES = tx.U(0x0101010101010101)
_MAX_FRONTIER = 1 << 20


def _fingerprints(raw: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of each row of a chunk."""
    w = tx.words(raw, off, tx.NON_SPACE)
    n_rows = len(off) - 1
    out = np.zeros(n_rows, tx.U)
    if len(w.start) == 0:
        return out
    data, start, end = tx.joined(w)
    votes = np.where(w.count > 0, np.maximum(w.count - k + 1, 1), 0)
    row = np.repeat(np.arange(n_rows), votes)
    head = np.concatenate(([0], np.cumsum(votes)[:-1]))
    at = np.arange(len(row)) - head[row]
    a = w.first[row] + at
    b = np.minimum(a + k - 1, w.first[row] + w.count[row] - 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[s:e], SEED) for s, e in
                     zip(start[a].tolist(), end[b].tolist(), strict=True)), tx.U, len(row))
    # bit counts: eight byte-wide lanes per shift, summed over runs of at most 255 votes
    runs = np.flatnonzero(at % 255 == 0)
    run_row = row[runs]
    rows, first_run = np.unique(run_row, return_index=True)
    for shift in range(8):
        lanes = np.add.reduceat((h >> tx.U(shift)) & _LANES, runs).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes, first_run, axis=0, dtype=np.int64)
        for byte in range(8):
            out[rows] |= (2 * ones[:, byte] > votes[rows]).astype(tx.U) << tx.U(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row ``(id, text_hash, fp)`` per input row; ``fp`` is the 64-bit
    fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            parts = [_fingerprints(raw, off, shingle)
                     for _, _, raw, off in tx.text_chunks(batch, "t")]
            if parts:
                fp = pa.array(np.concatenate(parts).view(np.int64))
                yield tx.with_column(batch, ["id", "text_hash"], {"fp": fp})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).cast("string").alias("t")).mapInArrow(
                           run, "id long, text_hash long, fp long")


def _shard_keys(fp: Column, max_bits: int) -> Column:
    """All shard keys of a fingerprint: number of the block pair and its bits."""
    n = max_bits + 2
    edge = [64 * i // n for i in range(n + 1)]

    def block(i: int) -> Column:
        return F.shiftrightunsigned(fp, edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1))

    return F.array(*[F.struct(F.lit(c).alias("pair"),
                              F.shiftleft(block(i), 32).bitwiseOR(block(j)).alias("bits"))
                     for c, (i, j) in enumerate(combinations(range(n), 2))])


def _bk_forest(unit: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Build one BK-tree per unit (rows sorted by unit), all level by level.

    Returns the root row of each unit and the edges as a sorted array
    ``parent row * 65 + distance`` with the child rows beside it.
    """
    n = len(fp)
    head = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    rest = np.ones(n, bool)
    rest[head] = False
    todo = np.flatnonzero(rest)
    where = np.repeat(head, np.diff(np.append(head, n)))[todo]
    keys, kids = [], []
    while len(todo):
        d = np.bitwise_count(fp[todo] ^ fp[where]).astype(np.int64)
        slot = where * 65 + d
        taken, first, back = np.unique(slot, return_index=True, return_inverse=True)
        keys.append(taken)
        kids.append(todo[first])
        stay = np.ones(len(todo), bool)
        stay[first] = False
        where = todo[first][back][stay]
        todo = todo[stay]
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    kid = np.concatenate(kids) if kids else np.zeros(0, np.int64)
    order = np.argsort(key)
    return head, key[order], kid[order]


def _bk_search(fp: np.ndarray, key: np.ndarray, kid: np.ndarray, query: np.ndarray,
               query_fp: np.ndarray, root: np.ndarray, radius: int
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matches ``(query, row)`` within the radius, following only the edges
    whose distance lies within the radius of the query's own."""
    stack = [(query, query_fp, root)]
    while stack:
        q, f, node = stack.pop()
        if len(q) > _MAX_FRONTIER:
            half = len(q) // 2
            stack += [(q[:half], f[:half], node[:half]), (q[half:], f[half:], node[half:])]
            continue
        d = np.bitwise_count(f ^ fp[node]).astype(np.int64)
        hit = d <= radius
        if hit.any():
            yield q[hit], node[hit]
        lo = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0), "left")
        hi = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), "right")
        n = hi - lo
        if n.any():
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            stack.append((np.repeat(q, n), np.repeat(f, n), kid[at]))


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    p = parent[x]
    while True:
        up = parent[p]
        if np.array_equal(up, p):
            return p
        p = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs; the smaller index stays root."""
    while len(a):
        ra, rb = _find(parent, a), _find(parent, b)
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _link_units(unit: np.ndarray, in_tree: np.ndarray, is_query: np.ndarray, fp: np.ndarray,
                radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges ``(fingerprint, root fingerprint)`` of the linked groups of
    each unit; rows are sorted by unit and each unit has a tree member."""
    tree = np.flatnonzero(in_tree)
    if len(tree) == 0:
        return fp[:0], fp[:0]
    heads, key, kid = _bk_forest(unit[tree], fp[tree])
    q = np.flatnonzero(is_query)
    tree_unit = unit[tree][heads]
    at = np.searchsorted(tree_unit, unit[q])
    ok = at < len(tree_unit)
    ok[ok] = tree_unit[at[ok]] == unit[q][ok]
    q, at = q[ok], at[ok]
    parent = np.arange(len(fp))
    for a, b in _bk_search(fp[tree], key, kid, q, fp[q], heads[at], radius):
        _unite(parent, a, tree[b])
    root = _find(parent, np.arange(len(fp)))
    leaf = np.flatnonzero(root != np.arange(len(fp)))
    return fp[leaf], fp[root[leaf]]


def near_links(fps: DataFrame, max_bits: int = 4, max_shard: int = 4096) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints whose connected
    components are those of all pairs within ``max_bits``; ``fps`` has a column
    ``fp`` of distinct fingerprints."""
    rows = fps.select("fp", F.explode(_shard_keys(F.col("fp"), max_bits)).alias("k")).select(
        "fp", "k.pair", "k.bits")
    size = rows.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(size, ["pair", "bits"])
    # parts of a large shard, and every unordered pair of parts as a unit
    rows = rows.withColumn("parts", F.ceil(F.col("n") / max_shard).cast("long"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    unit = F.xxhash64("pair", "bits", F.least("part", "other"), F.greatest("part", "other"))
    rows = rows.select(unit.alias("unit"), (F.col("part") <= F.col("other")).alias("in_tree"),
                       (F.col("part") >= F.col("other")).alias("is_query"), "fp")
    # (two units under one hash would only be searched together: the distance decides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[pa.RecordBatch], n: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).slice(0, n)
            # a row that is both in the tree and a query is one row, also when repeated
            u, v = _link_units(t["unit"].to_numpy(), t["in_tree"].to_numpy(),
                               t["is_query"].to_numpy(), t["fp"].to_numpy().view(tx.U), max_bits)
            return pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        n_held = 0
        for batch in tx.released(batches):
            held.append(batch)
            n_held += batch.num_rows
            if n_held >= 1 << 16:
                t = pa.Table.from_batches(held).combine_chunks()
                units = t["unit"].to_numpy()
                whole = int(np.searchsorted(units, units[-1], "left"))
                if whole:
                    yield solve(t.to_batches(), whole)
                    held = t.slice(whole).to_batches()
                    n_held -= whole
        if n_held:
            yield solve(held, n_held)

    return (rows.repartition("unit").sortWithinPartitions("unit")
            .mapInArrow(run, "u long, v long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(id, text_hash, fp, component_id)`` per document; the
    component is the smallest id reachable over links of at most ``max_bits``."""
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("id")))
    parts = connected_components(near_links(distinct.select("fp"), max_bits), "u", "v")
    groups = distinct.join(parts, distinct.fp == parts.node, "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("component"))
    least = groups.groupBy("component").agg(F.min("id").alias("component_id"))
    groups = groups.join(least, "component").select("fp", "component", "component_id")
    return fps.join(groups, "fp")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each group: the smallest id (null last), then the
    smallest text hash; of rows repeated in full one stays."""
    found = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    best = found.groupBy("component").agg(F.min(F.struct(
        F.col("id").isNull().alias("none"), "id", "text_hash")).alias("best"))
    keep = best.select("best.none", F.coalesce("best.id", F.lit(0)).alias("id"), "best.text_hash")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).isNull().alias("none"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
                       F.xxhash64(text_col).alias("text_hash"))
    key = ["none", "id", "text_hash"]
    one = Window.partitionBy(*key).orderBy(F.lit(0))
    return (rows.join(keep, key, "left_semi").withColumn("n", F.row_number().over(one))
            .filter("n = 1").select("row.*"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
