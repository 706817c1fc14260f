"""Embedding near-duplicates by product quantisation (operator 9).

A coarse codebook cuts space into inverted lists and subspace codebooks
quantise the residuals; both are fitted on a bounded sample of the vectors
(``SAMPLE_BYTES``).  Every distinct vector is indexed in its ``probes``
nearest lists with its residual code and the exact length of what the code
leaves out.  Inside a list, table-lookup distances from the exact query to the
codes, widened by that length, keep every pair that can reach the cosine
(triangle inequality), and the exact cosine in double precision decides.  A
pair in several common lists counts in the first of them.

A list above ``max_list`` is cut into parts; every pair of parts is a unit of
its own, so a task holds two parts at most and no pair of the list is lost.
Equal vectors are one class with a count and never become pairs.  Units return
link counts per class and a spanning star per linked group, not pairs.

Defined cases: vectors that are null, zero or hold null or non-finite
components link with nothing; vectors of another length link among
themselves only; repeated rows are vectors of their own; a null id is counted
but never a component id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import connected_components, cut
from shelfwise.llm.simhash import _find, _unite

SAMPLE_BYTES = 16 << 20
CODES = 64


def _matrix(arr: pa.Array, dim: int) -> np.ndarray:
    flat = arr.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, dim, key, vec)``: ``dim`` is 0 and ``key`` null for vectors that
    link with nothing; equal vectors have equal keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            dims, keys = [], []
            for v in col:
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                dims.append(len(x) if good else 0)
                keys.append(xxhash.xxh3_128_digest(np.ascontiguousarray(x)) if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), col],
                names=["id", "dim", "key", "vec"])

    return vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(
        run, "id long, dim int, key binary, vec array<double>")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two (exact), so that no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sq_dist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_sq_dist(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


@dataclass
class Codebooks:
    coarse: np.ndarray               # (lists, dim)
    parts: list[slice]               # subspaces
    books: list[np.ndarray]          # per subspace (codes, width)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the length of what they leave out."""
        codes = np.empty((len(residual), len(self.parts)), np.uint8)
        left = np.zeros(len(residual))
        for m, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            codes[:, m] = _sq_dist(residual[:, p], b).argmin(1)
            left += ((residual[:, p] - b[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def lookup(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances ``(queries, codes)`` by table lookup."""
        d = np.zeros((len(query), len(codes)))
        for m, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            d += _sq_dist(query[:, p], b)[:, codes[:, m]]
        return np.sqrt(d)


def fit(sample: np.ndarray, n_lists: int, subspaces: int = 8, seed: int = 5) -> Codebooks:
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    coarse = _kmeans(x, n_lists, rng)
    near = np.concatenate([_sq_dist(x[i:i + 4096], coarse).argmin(1) for i in range(0, len(x), 4096)])
    residual = x - coarse[near]
    edges = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return Codebooks(coarse, parts, [_kmeans(residual[:, p], CODES, rng) for p in parts])


def _search_unit(part: np.ndarray, own: np.ndarray, x: np.ndarray, n: np.ndarray, codes: np.ndarray,
                 left: np.ndarray, probes: np.ndarray, list_: int, books: Codebooks, cosine: float
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Links per row and the group root of each row of one unit; rows of
    ``part`` 0 are indexed, rows of part 1 query them (``own``: one part,
    which queries itself)."""
    links = np.zeros(len(x), np.int64)
    parent = np.arange(len(x))
    index = np.flatnonzero(part == 0)
    query = index if own else np.flatnonzero(part == 1)
    reach = np.sqrt(2 - 2 * cosine) + 1e-6
    residual = _unit(x) - books.coarse[list_]
    x = _scaled(x)
    size = np.linalg.norm(x, axis=1)
    for lo in range(0, len(query), 256):
        q = query[lo:lo + 256]
        d = books.lookup(residual[q], codes[index])
        a, b = np.nonzero(d <= reach + left[index][None])
        a, b = q[a], index[b]
        if own:
            a, b = a[a > b], b[a > b]
        for k in range(0, len(a), 1 << 16):
            i, j = a[k:k + (1 << 16)], b[k:k + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[i], x[j]) / (size[i] * size[j]) >= cosine
            i, j = i[ok], j[ok]
            # of several common lists the first counts the pair
            same = probes[i][:, :, None] == probes[j][:, None, :]
            first = np.where(same.any(axis=2), probes[i], np.iinfo(np.int32).max).min(axis=1)
            i, j = i[first == list_], j[first == list_]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            _unite(parent, i, j)
    return links, _find(parent, np.arange(len(x)))


def _search(classes: DataFrame, dim: int, cosine: float, probes: int, list_size: int,
            max_list: int) -> DataFrame:
    """``(u, v, links)``: link counts per class (``v`` null) and star edges."""
    spark = classes.sparkSession
    total = classes.count()
    share = min(1.0, SAMPLE_BYTES / (8 * dim) / max(total, 1))
    picked = classes.filter(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = np.array([r.vec for r in picked.select("vec").toLocalIterator()], np.float64).reshape(-1, dim)
    if len(sample) == 0:
        sample = np.array([classes.select("vec").first().vec], np.float64)
    books = fit(sample, int(np.clip(total // list_size, 1, 1024)))
    shared = spark.sparkContext.broadcast(books)
    p = min(probes, len(books.coarse))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = _unit(_matrix(part.column(2), dim))
                near = np.argsort(_sq_dist(x, b.coarse), axis=1, kind="stable")[:, :p]
                row = np.repeat(np.arange(len(x)), p)
                codes, left = b.encode(x[row] - b.coarse[near.ravel()])
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.ravel().astype(np.int32)), part.column(0).take(pick),
                     part.column(1).take(pick), part.column(2).take(pick),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left),
                     pa.array(list(near.astype(np.int32)[row]), pa.list_(pa.int32()))],
                    names=["list", "cls", "n", "vec", "codes", "left", "probes"])

    rows = classes.select("cls", "n", "vec").mapInArrow(
        assign, "list int, cls long, n long, vec array<double>, codes binary, left double, probes array<int>")
    size = classes.select("cls", "n", "vec").mapInArrow(
        assign, "list int, cls long, n long, vec array<double>, codes binary, left double, probes array<int>"
    ).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / max_list).cast("long").alias("parts"))
    rows = rows.join(F.broadcast(size), "list")          # as many rows as lists
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("parts"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("list", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
                       (F.col("mine") > F.col("other")).cast("int").alias("part"),
                       "cls", "n", "vec", "codes", "left", "probes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value

        def solve(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            cls, n = t["cls"].to_numpy(), t["n"].to_numpy()
            codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(cls), -1)
            links, root = _search_unit(
                t["part"].to_numpy(), t["a"][0] == t["b"][0], _matrix(t["vec"].chunk(0), dim), n, codes,
                t["left"].to_numpy(), np.array(t["probes"].to_pylist()), t["list"][0].as_py(), b, cosine)
            some = np.flatnonzero(links)
            leaf = np.flatnonzero(root != np.arange(len(root)))
            u = np.concatenate([cls[some], cls[leaf]])
            v = pa.array(np.concatenate([cls[some], cls[root[leaf]]]),
                         mask=np.arange(len(u)) < len(some))
            return pa.RecordBatch.from_arrays(
                [pa.array(u), v, pa.array(np.concatenate([links[some], np.zeros(len(leaf), np.int64)]))],
                names=["u", "v", "links"])

        held, key = [], None
        for batch in batches:
            k = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            head = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1)))) if len(k) else []
            for lo, hi in zip(head, np.append(head[1:], len(k)) if len(k) else [], strict=True):
                if held and tuple(k[lo]) != key:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                key = tuple(k[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield solve(pa.Table.from_batches(held))

    return (rows.repartition("list", "a", "b").sortWithinPartitions("list", "a", "b")
            .mapInArrow(run, "u long, v long, links long"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, probes: int = 4, list_size: int = 200,
                    max_list: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row ``(id, n_links, component_id, kept)`` per vector."""
    rows = _classes(vectors, id_col, vec_col)
    classes = (rows.filter("dim > 0").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("vec").alias("vec"),
        F.first("dim").alias("dim")))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    found = None
    for r in classes.groupBy("dim").count().collect():        # lengths of vectors, one as a rule
        one = _search(classes.filter(F.col("dim") == r.dim), r.dim, cosine, probes, list_size, max_list)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = cut(found)
    links = found.filter("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("v is not null"), "u", "v")
    c = classes.select("key", "n", "least", "cls")
    c = c.join(links, c.cls == links.u, "left").join(parts, c.cls == parts.node, "left").select(
        "key", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "cls").alias("component"))
    least = c.groupBy("component").agg(F.min("least").alias("component_id"))
    c = c.join(least, "component").select("key", "n_links", "component_id")
    out = rows.select("id", "key").join(c, "key", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
