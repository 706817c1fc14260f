"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
from llm_fixtures import docs_of, table  # noqa: F401
from shelfwise.llm import suffix


def brute(rows, length=200):
    """rows: (id, text); sorted (id, n_bytes, n_removed, n_spans, sha)."""
    seen = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, **kw):
    return sorted((tuple(r) for r in suffix.removal_digest(docs, **kw).collect()), key=str)


def test_documents(table):
    docs = table("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert found(docs) == want
    assert sum(r[2] for r in want) > 0


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(90)
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 199), (5, "b" * 200), (6, "c" * 201),
            (7, "d" * 3000), (8, "xyz" * 300), (9, text(3000)), (9, text(50)), (None, text(100))]
    rows += [(20 + k, text(rng.randint(0, 30)) + " " + passage[:rng.choice([150, 199, 200, 260, 400])]
              + text(rng.randint(0, 60))) for k in range(25)]
    rows += [(60, passage), (61, passage), (61, passage), (62, passage + "!" + passage)]
    return rows


@pytest.mark.parametrize("max_contents", [4096, 2])
def test_edge_cases(docs_of, awkward, max_contents):
    assert found(docs_of(awkward), max_contents=max_contents) == brute(awkward)


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_counted_windows_by_join_and_by_broadcast(docs_of, awkward, sent, monkeypatch):
    monkeypatch.setattr(suffix._count_windows, "__defaults__", (sent,))
    assert found(docs_of(awkward), max_contents=1) == brute(awkward)


def sharing(sizes):
    """Two documents for each size that share a passage of so many bytes."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    out = []
    for i in sizes:
        common = text(i)
        out += [(2 * i, f"{text(400)}x{common}y{text(300)}"), (2 * i + 1, f"{text(250)}z{common}w{text(500)}")]
    return out


@pytest.mark.parametrize("sizes", [[150], [1, 39, 40, 41, 150, 199, 200, 201, 229]])
def test_documents_that_share_some_bytes(docs_of, sizes):
    rows = sharing(sizes)
    assert found(docs_of(rows)) == brute(rows)


def test_one_common_passage_in_many_documents(docs_of):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for size in (150, 229):
        common = text(size)
        rows = [(i, f"{i}!{text(rng.randint(90, 260))}<{common}>{text(rng.randint(90, 260))}") for i in range(600)]
        assert found(docs_of(rows)) == brute(rows)
        assert found(docs_of(rows), max_contents=50) == brute(rows)


def test_repeated_rows_stay_linear(docs_of, awkward):
    """Equal rows and null ids with one text give one row of spans."""
    rows = [(1, awkward[-1][1])] * 5000 + [(None, awkward[-2][1])] * 5000 + [(3, awkward[8][1])]
    spans = suffix.repeated_spans(docs_of(rows)).collect()
    assert len(spans) == 2 and max(len(r.spans) for r in spans) < 300
    got = found(docs_of(rows))
    few = brute([rows[0], rows[0], rows[5000], rows[5000], rows[-1]])
    assert len(got) == 10_001 and sorted(set(got), key=str) == sorted(set(few), key=str)


def test_long_text_in_pieces(docs_of, awkward, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 700)
    b = np.frombuffer(awkward[8][1].encode() * 2, np.uint8)
    whole = [len(b) // 2, len(b) // 2]
    piece = np.concatenate([b[p:p + 700 + 199] for p in range(0, len(b), 700)])
    assert len(piece) > len(b) and sum(whole) == len(b)
    rows = [(1, awkward[8][1]), (2, "zz" + awkward[8][1][300:9000])]
    assert found(docs_of(rows)) == brute(rows)


def test_remove_keeps_clean_documents(docs_of, awkward, spark):
    rows = awkward
    got = sorted(((r.doc_id, r.text) for r in suffix.remove_repeats(docs_of(rows)).collect()), key=str)
    lost = {r[0] for r in brute(rows) if r[1] and r[1] == r[2]}
    clean = [(i, t) for i, t in rows if (i, 0) in {(r[0], r[2]) for r in brute(rows)}]
    assert all(x in got for x in clean)
    assert not lost & {i for i, _ in got}
    assert suffix.remove_repeats(docs_of(rows)).columns == docs_of(rows).columns
    assert suffix.remove_repeats(docs_of(rows[:0])).count() == 0
    assert found(docs_of(rows[:0])) == []
    odd = spark.createDataFrame([(1, "t" * 500, 7, "k", 3), (2, "plain", 8, "k", 4)],
                                "doc_id long, text string, id int, spans string, th int")
    assert [tuple(r) for r in suffix.remove_repeats(odd).collect()] == [(2, "plain", 8, "k", 4)]


def test_a_hash_collision_removes_nothing(monkeypatch):
    """With a useless hash every comparison ties; the bytes decide."""
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 100, 4000).astype(np.uint8)
    buf[3000:3300] = buf[100:400]
    order = suffix.SuffixOrder(buf, 200)
    pos = np.arange(3801)
    want = sorted(p for p in range(3801) if 100 <= p <= 200 or 3000 <= p <= 3100)
    assert order.repeats(pos, np.zeros(3801, np.int64)).tolist() == want
    order.sums[:] = 0
    assert order.repeats(pos, np.zeros(3801, np.int64)).tolist() == want
