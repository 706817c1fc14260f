"""Periodic runs against all pairs of words and periods."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import docs_of, table  # noqa: F401
from shelfwise.llm import runs
from shelfwise.llm.queries import QUERIES


def brute(s, min_length=6, min_exponent=4):
    """Every maximal stretch of every period, smaller periods ruled out by comparison."""
    n, out = len(s), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if size >= max(min_length, min_exponent * q):
                part = s[i:i + size]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def row(doc_id, w):
    """The query's row from the words of a document."""
    found = brute(w)
    stay = [not any(s + q <= i < s + n for s, n, q in found) for i in range(len(w))]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = best or (None,) * 3
    return (doc_id, len(found), start, length, period, best and 1000 * length // period,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for x, k in zip(w, stay, strict=True) if k).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 6), st.integers(0, 30),
       st.sampled_from([(6, 4), (2, 2), (9, 3)]))
def test_runs_of(s, period, start, limits):
    s = [x if i < start else s[start + (i - start) % period] if start + period <= len(s) else x
         for i, x in enumerate(s)]
    assert runs.runs_of(s, *limits) == brute(s, *limits)


def test_squares_have_primitive_roots():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 30))]
        want = {(e, d) for e in range(len(s)) for d in range(1, (e + 1) // 2 + 1)
                if s[e - 2 * d + 1:e - d + 1] == s[e - d + 1:e + 1]
                and not any(d % r == 0 and s[e - d + 1:e - d + 1 + r] * (d // r) == s[e - d + 1:e + 1]
                            for r in range(1, d))}
        assert set(runs.squares(s)) == want


def test_automaton_accepts_every_stretch():
    s = [0, 1, 1, 0, 1, 1, 0, 2, 0, 1]
    length, link, prefix = runs.suffix_automaton(s)
    # one state per class of strings with equal end places
    ends = {}
    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            ends.setdefault(tuple(s[a:b]), set()).add(b)
    assert len(length) - 2 == len({frozenset(x) for x in ends.values()})
    assert [length[p] for p in prefix] == list(range(1, len(s) + 1))
    assert all(length[link[v]] < length[v] for v in range(2, len(length)))


def test_documents(spark, table):
    docs = table("documents")
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect())
    rows = docs.select("doc_id", "text").collect()
    assert [r[:1] for r in got] == sorted((r.doc_id,) for r in rows)
    short = {r.doc_id: planted(*r) for r in rows if len(words(r.text)) <= 2500}
    assert len(short) > 150
    assert [r for r in got if r[0] in short] == sorted(row(i, w) for i, w in short.items())
    assert sum(r[1] > 0 for r in got) >= 10


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(2)
    text = lambda n, k=400: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    unit = text(60)
    return [(1, None), (2, ""), (3, " \t\r\n"), (4, "one"), (5, "a " * 5), (6, "a " * 6), (7, "a\tb\n" * 4),
            (8, "a b " * 3 + "a"), (9, "x" * 300_000), (10, " ".join([unit] * 5)), (10, " ".join([unit] * 5)),
            (None, "é è " * 9), (11, text(4000, 30)), (12, f"{text(300)} {unit} {unit} {unit} {text(200)}"),
            (13, f"{text(40)} {unit} {unit} {unit} {unit} y {unit} {unit} {unit} {unit}"),
            (14, "a b a b a b a b b b b b b b a b a b a b a b")]


def test_edge_cases(docs_of, awkward, spark):
    key = lambda r: str(r)
    got = sorted((tuple(r) for r in runs.digest(runs.periodic_runs(docs_of(awkward))).collect()), key=key)
    assert got == sorted((row(i, words(t)) for i, t in awkward), key=key)
    assert runs.periodic_runs(docs_of(awkward[:0])).collect() == []
    odd = spark.createDataFrame([(1, "a " * 9, 7, "k")], "doc_id long, text string, runs int, collapsed string")
    assert [tuple(x) for x in runs.periodic_runs(odd).select("n_words", "runs", "collapsed").collect()] == [
        (9, [(0, 9, 1)], "a")]


def test_planted_repeats(docs_of, awkward):
    rows = [(i, f"w{i} " + "p q r s t u v " * (i % 40)) for i in range(300)] + awkward
    got = sorted(((r.doc_id, words(r.text)) for r in runs.planted_repeats(docs_of(rows)).collect()), key=str)
    assert got == sorted(((i, planted(i, t)) for i, t in rows), key=str)


def test_nothing_a_run_needs_is_set_aside():
    """The whole text's automaton finds no run beyond the candidates'."""
    rng = random.Random(6)
    for _ in range(60):
        w = [f"{rng.randrange(6)}" for _ in range(rng.randint(0, 120))]
        raw = runs.np.frombuffer(" ".join(w).encode(), runs.np.uint8)
        found = runs._chunk_runs(runs.tx.words(raw, runs.np.array([0, len(raw)]), runs.tx.NON_SPACE), 6, 4)
        assert [r[1:] for r in found] == brute(w)


def test_limits_are_checked(docs_of):
    with pytest.raises(ValueError, match="two periods"):
        runs.periodic_runs(docs_of([]), min_exponent=1)
