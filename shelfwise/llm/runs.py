"""Periodic run detection (operator 13).

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical) and at least ``max(min_length, min_exponent * q)`` words
that no neighbouring word extends.  Per text:

1. A suffix automaton is built over the words; its suffix links form a tree in
   which the path from the state of a prefix to the root holds all suffixes of
   the prefix.
2. The words are appended once more, and each accesses its prefix's state in a
   link-cut tree over that tree.  A preferred path is a segment whose strings
   all ended last at one word, its colour; the access recolours every segment
   above the state.  A segment of the suffixes of ``lo + 1`` to ``hi`` words that
   last ended at word ``e`` shows a square of period ``d = i - e`` ending at word
   ``i`` exactly when ``lo < d <= hi``: the suffix of ``d`` words then ends at both,
   and as it ended nowhere between, it is primitive.  The number of segments
   over all words is O(n log n).
3. Squares of one period that end at consecutive words are one run; it begins
   where the first square does and has that smallest period.

Before that, words that no run can hold are set aside, so most texts never
reach the automaton: every run of ``k + q`` words repeats each of its stretches
of ``k`` words one period away (``k`` is the largest length this holds for), and
holds each of its words ``min_exponent`` times.  What remains is cut into
stretches, each with an automaton of its own; words are compared as bytes
there, hashes only decide what is set aside (a collision sets nothing aside).

Defined cases: null and empty texts have no words and no run; a text shorter
than ``min_length`` words has none; repeated rows and ids are judged each; an
empty table gives an empty result; other columns do not matter.  A text is
handled whole in one task, with memory in proportion to its longest stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import text as tx

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """``(length, link, state of each prefix)``; states count from 1, the root."""
    length, link, prefix = [0, 0], [0, 0], []
    # most states have one transition; only branching ones hold a table
    only, to, table = [-1, -1], [0, 0], {}
    last = 1
    for c in words:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(1)
        only.append(-1)
        to.append(0)
        prefix.append(cur)
        p, last = last, cur
        q = 0
        while p:
            if only[p] == c:
                q = to[p]
                break
            t = table.get(p)
            if t is not None:
                q = t.get(c, 0)
                if q:
                    break
                t[c] = cur
            elif only[p] < 0:
                only[p], to[p] = c, cur
            else:
                table[p] = {c: cur}
            p = link[p]
        if not q:
            continue
        if length[p] + 1 == length[q]:
            link[cur] = q
            continue
        clone = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        only.append(only[q])
        to.append(to[q])
        if q in table:
            table[clone] = table[q].copy()
        while p:
            if only[p] == c and to[p] == q:
                to[p] = clone
            else:
                t = table.get(p)
                if t is None or t.get(c) != q:
                    break
                t[c] = clone
            p = link[p]
        link[q] = link[cur] = clone
    return length, link, prefix


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """``(end, period)`` of every square with a primitive root, by end."""
    length, up, prefix = suffix_automaton(words)
    # auxiliary splay trees of the preferred paths; a root's up is its path parent
    n = len(length)
    left, right, colour = [0] * n, [0] * n, [-1] * n

    def splay(x: int) -> None:
        top = x
        while True:
            p = up[x]
            if left[p] != x and right[p] != x:
                break
            g = up[p]
            top = p
            if left[g] == p or right[g] == p:
                # the parent turns first when all three are in line
                top = g
                a = p if (left[g] == p) == (left[p] == x) else x
                for y in (a, x):
                    z = up[y]
                    w = up[z]
                    if left[z] == y:
                        b = left[z] = right[y]
                        right[y] = z
                    else:
                        b = right[z] = left[y]
                        left[y] = z
                    if b:
                        up[b] = z
                    if left[w] == z:
                        left[w] = y
                    elif right[w] == z:
                        right[w] = y
                    up[z], up[y] = y, w
            else:
                if left[p] == x:
                    b = left[p] = right[x]
                    right[x] = p
                else:
                    b = right[p] = left[x]
                    left[x] = p
                if b:
                    up[b] = p
                up[p], up[x] = x, g
        colour[x] = colour[top]

    for i, v in enumerate(prefix):
        below, x = 0, v
        while x:
            splay(x)
            e, cut, above = colour[x], right[x], up[x]
            if e >= 0 and length[above] < i - e <= length[x]:
                yield i, i - e
            if cut:
                colour[cut] = e     # the deeper part keeps its colour
            right[x] = below
            if below:
                up[below] = x
            below, x = x, above
        colour[below] = i


def runs_of(words: list[int], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs, by start and period."""
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    out = []

    def close(d: int) -> None:
        n = last[d] - first[d] + 2 * d
        if n >= max(min_length, min_exponent * d):
            out.append((first[d] - 2 * d + 1, n, d))

    for i, d in squares(words):
        if last.get(d) != i - 1:
            if d in last:
                close(d)
            first[d] = i
        last[d] = i
    for d in last:
        close(d)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _repeated_stretch(min_length: int, min_exponent: int) -> int:
    """The most words ``k`` of which every stretch in a run repeats one period away."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 2))


def _stretches(live: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of live words inside one row."""
    at = np.flatnonzero(live)
    if len(at) == 0:
        return at, at
    new = np.concatenate(([True], (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])))
    lo = at[new]
    return lo, at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + 1


def candidates(h: np.ndarray, row: np.ndarray, min_length: int, min_exponent: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges outside of which no run has a word, from word hashes."""
    none = np.zeros(0, np.int64)
    k = _repeated_stretch(min_length, min_exponent)
    gram, at = tx.shingle_hashes(h, row, k)
    gram = gram ^ tx.mix(row[at].astype(tx.U))
    order = np.argsort(gram)
    same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    if len(same) == 0:
        return none, none
    edge = np.zeros(len(h) + 1, np.int64)
    twice = at[np.unique(np.concatenate([order[same], order[same + 1]]))]
    edge[twice] += 1
    edge[twice + k] -= 1
    live = np.cumsum(edge[:-1]) > 0
    while True:
        lo, hi = _stretches(live, row)
        long = hi - lo >= min_length
        lo, hi = lo[long], hi[long]
        size = hi - lo
        if len(lo) == 0:
            return none, none
        # every word of a run occurs min_exponent times in its stretch
        unit = np.repeat(np.arange(len(lo)), size)
        pos = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size) + lo[unit]
        key = h[pos] ^ tx.mix(unit.astype(tx.U))
        _, code, n = np.unique(key, return_inverse=True, return_counts=True)
        enough = n[code] >= min_exponent
        if enough.all():
            return lo, hi
        live = np.zeros(len(h), bool)
        live[pos[enough]] = True


def _chunk_runs(w: tx.Words, min_length: int, min_exponent: int) -> list[tuple[int, int, int, int]]:
    """``(row, start, length, period)`` of the runs of a chunk; starts are word
    numbers of the chunk."""
    out = []
    if len(w.start) < min_length:
        return out
    lo, hi = candidates(w.hashes(), w.row, min_length, min_exponent)
    data = w.buf.tobytes() if len(lo) else b""
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        code: dict[bytes, int] = {}
        words = [code.setdefault(data[x:y], len(code))
                 for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
        row = int(w.row[a])
        out += [(row, a + s, n, q) for s, n, q in runs_of(words, min_length, min_exponent)]
    return out


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, runs, collapsed)`` per row: the runs by start and period
    (word numbers from 0) and the text's words, joined by one space, without
    those a run holds after its first period."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run holds at least two periods and two words")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in tx.text_chunks(batch, "t"):
                w = tx.words(raw, off, tx.NON_SPACE, tx.IDENTITY)
                found = _chunk_runs(w, min_length, min_exponent)
                per: list[list[dict]] = [[] for _ in range(hi - lo)]
                gone = np.zeros(len(w.start) + 1, np.int64)
                for row, s, n, q in found:
                    per[row].append({"start": s - int(w.first[row]), "length": n, "period": q})
                    gone[s + q] += 1
                    gone[s + n] -= 1
                kept, count = w, w.count
                if found:
                    stay = np.cumsum(gone[:-1]) == 0
                    count = np.bincount(w.row[stay], minlength=hi - lo)
                    kept = tx.Words(w.buf, w.start[stay], w.end[stay], w.row[stay],
                                    np.concatenate(([0], np.cumsum(count)[:-1])), count)
                data, start, end = tx.joined(kept)
                # rows follow each other in the joined bytes, one space between
                edge = np.concatenate(([0], np.cumsum(count)))
                collapsed = [data[start[a]:end[b - 1]] if b > a else b""
                             for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(w.count.astype(np.int64)),
                     pa.array(per, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"])

    kind = dict(d.dtypes)["id"]
    return d.mapInArrow(run, f"id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run with most words, the first and then the shortest period on ties."""
    return F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))


def digest(found: DataFrame) -> DataFrame:
    """The figures of each text's runs and the SHA-256 of both results."""
    best = longest_run(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    b = found.withColumn("best", best)
    return b.select(
        "id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / (-F.col("best.short"))).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with periodic ends in about a tenth of them: with
    ``h = crc32(id)``, ``g = floor(h / 10)``, ``h % 10 = 0`` and ``n`` words, each word
    ``i >= a`` is word ``a + (i - a) % p`` of the original, where ``a = g % n`` and
    ``p = 1 + floor((n - a) / (3 + g % 8))``.  Null ids and texts without words stay."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    # a one-element array binds each value, so that it is computed once a row
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def changed(w: Column) -> Column:
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return bound(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(
            w, lambda c, i: F.when(i < x["a"], c).otherwise(
                F.element_at(w, (x["a"] + (i - x["a"]) % x["p"] + 1).cast("int")))), " "))

    words = F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda c: c != "")
    text = F.when((h % 10 == 0) & F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), bound(words, changed)
                  ).otherwise(F.col(text_col))
    return docs.select(F.col(id_col).alias(id_col), text.alias(text_col))
