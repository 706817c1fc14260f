"""Decontamination, license scan, language ID, mixing and the pipeline."""

import re
import zlib

import pytest
from pyspark.sql import functions as F
from llm_fixtures import docs_of, table  # noqa: F401
from shelfwise.llm import decontam, langcrf, licenses, mixing

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def best_windows(docs, items, theta=0.8):
    """All windows of all items: {(doc, item): best similarity}."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            iw = words(it)
            k = min(5, len(iw))
            if not k:
                continue
            a = [tuple(iw[x:x + k]) for x in range(len(iw) - k + 1)]
            b = [tuple(w[x:x + k]) for x in range(len(w) - k + 1)]
            size = min(len(a), len(b))
            vocab = set(a)
            hit = [x in vocab for x in b]
            for s in range(len(b) - size + 1):
                if not any(hit[s:s + size]):
                    continue
                win = b[s:s + size]
                both = sum(min(a.count(x), win.count(x)) for x in set(win))
                sim = both / (len(a) + len(win) - both)
                if sim >= theta:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def found(docs, bench):
    rows = decontam.contamination(docs, bench).collect()
    return {(r.id, r.item_id): r.similarity for r in rows}


def test_decontamination_of_the_tables(table):
    docs, bench = table("documents"), table("benchmark")
    want = best_windows([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = found(docs, bench)
    assert want and got == pytest.approx(want)


def test_decontamination_edge_cases(docs_of, spark, table, monkeypatch):
    item = " ".join(f"w{i % 37}x{i}" for i in range(60))
    edited = item.replace("w5x5 ", "other ", 1)
    rows = [(1, None), (2, ""), (3, "pre " + item + " post"), (4, "PRE, " + edited.upper() + "!"),
            (5, item[:len(item) // 2]), (6, "say short one now"), (6, "say short one now"), (7, item[8:]),
            (None, item), (8, ("filler " * 3000) + item), (9, item.replace("x1", "y1"))]
    items = [(1, item), (2, "Short one"), (3, None), (4, ""), (5, item), (6, "a a a a a a a a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(rows)
    want = best_windows(rows, items)
    assert found(docs, bench) == pytest.approx(want)
    assert (3, 2) not in want and (6, 2) in want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    assert found(docs, bench) == pytest.approx(want)
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in rows if i and not any(d == i for d, _ in want))
    assert found(docs.limit(0), bench) == {} and found(docs, bench.limit(0)) == {}


def naive_license(t, theta=0.8):
    w = words(t)
    places, labels = [], set()
    for p, label in licenses.PHRASES.items():
        pw = p.encode().split()
        at = [i for i in range(len(w)) if w[i:i + len(pw)] == pw]
        places += at
        labels |= {label} if at else set()
    base = ",".join(sorted(labels))
    score = 1.0 if places else 0.0
    for label, tpl in licenses.TEMPLATES.items():
        tw = tpl.encode().split()
        s = set(tw)
        best = max([len(s & set(w[b:b + 2 * len(tw)])) / len(s) for b in range(0, len(w), len(tw))], default=0)
        if best >= theta:
            labels.add(label)
            score = max(score, best)
    return (len(w), len(places), min(places, default=None), max(places, default=None), base,
            ",".join(sorted(labels)), pytest.approx(score))


def test_licenses(docs_of, table):
    full = licenses.TEMPLATES["mit-notice"]
    rows = [(1, None), (2, ""), (3, "MIT License. mit-license mit  license"), (4, "x " * 500 + full.upper()),
            (5, full.replace("free", "gratis").replace("charge", "cost")), (6, full[:60]), (7, "GENERAL public license"),
            (7, "GENERAL public license"), (8, "all rights. reserved mit"), (9, "émit license mit licenseé mit license"),
            (10, "Apache License " * 400), (None, "mit license")]
    docs = docs_of(rows)
    for d in (docs, table("documents")):
        texts = sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
        got = sorted((tuple(r) for r in licenses.scan(d).collect()), key=lambda r: str((r[0], "")))
        assert len(got) == len(texts)
        want = {(i, *[str(x) for x in naive_license(t)[:6]]) for i, t in texts}
        assert {(r[0], *[str(x) for x in r[1:7]]) for r in got} == want
        assert all(r[7] == naive_license(dict(texts)[r[0]])[6] for r in got if r[0] != 7)
    assert licenses.scan(docs.limit(0)).count() == 0
    assert any("mit-notice" in r.labels for r in licenses.scan(docs).collect())


def test_language_id(docs_of, table):
    docs = table("documents", "0.01")
    got = {r.id: r for r in langcrf.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 .. 45", None), (4, "the", None), (5, "é", None), (6, "日本", None)]
    rows += [(i, "ab cd " * i, "xx" if i % 2 else "yy") for i in range(10, 30)]
    edge = {r.id: r for r in langcrf.identify(docs_of(rows)).collect()}
    assert [edge[i].lang_pred == "und" for i in range(1, 7)] == [True, True, True, False, False, False]
    none = langcrf.identify(docs_of([(1, "words", None)])).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert langcrf.identify(docs_of([])).count() == 0
    kept = langcrf.drop_unidentified(docs_of(rows + [(None, "x y", "en")]))
    assert kept.columns == docs.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_marginals_are_exact():
    """Against the sum over all label sequences."""
    from itertools import product

    import numpy as np
    rng = np.random.default_rng(0)
    count = np.array([5, 0, 1, 7])
    e, start, trans = rng.normal(size=(13, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    first = np.array([0, 5, 5, 6])
    for run in (2, 32):
        old, langcrf.RUN = langcrf.RUN, run
        got, _ = langcrf.marginals(e, first, count, start, trans)
        langcrf.RUN = old
        for f, n in zip(first, count, strict=True):
            want = np.zeros((n, 3))
            for seq in product(range(3), repeat=int(n)):
                s = sum(e[f + t, y] for t, y in enumerate(seq))
                s += sum(trans[a, b] for a, b in zip(seq, seq[1:], strict=False)) + (start[seq[0]] if n else 0)
                for t, y in enumerate(seq):
                    want[t, y] += np.exp(s)
            if n:
                np.testing.assert_allclose(got[f:f + n], want / want.sum(axis=1, keepdims=True), atol=1e-9)


def test_mixing(docs_of):
    big = "w " * 4000
    rows = ([(i, "a b c", None, "s1") for i in range(40)] + [(100 + i, big, None, "s2") for i in range(5)]
            + [(200 + i, "x\ty\u00a0z", None, None) for i in range(30)] + [(300, None, None, "s0"), (301, "", None, "s0"),
               (302, "q", None, "S"), (302, "q", None, "S"), (None, "n", None, "é")])
    docs = docs_of(rows)
    p = mixing.plan(docs).select("id", "size", "source_size", "target", "copies").collect()
    assert len(p) == len(rows)
    total = sum(r.size for r in p)
    assert all(r.target <= 3 * r.source_size + 1e-9 and 0 <= r.copies <= 3 for r in p)
    per = {(r.source_size, r.target) for r in p}
    assert sum(t for _, t in per) <= total + 1e-6
    assert sorted(map(str, p)) == sorted(map(str, mixing.plan(docs.repartition(7)).select(
        "id", "size", "source_size", "target", "copies").collect()))
    for size, target in per:
        mine = [r for r in p if (r.source_size, r.target) == (size, target)]
        assert abs(sum(r.size * r.copies for r in mine) - target) <= max(r.size for r in mine)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in p)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [(5, 2, 1), (1, 1, 1), (7, 3)])
def test_sources_come_near_their_targets(docs_of, weights):
    """Sizes of a long tail: every source within its longest document of its target."""
    import random
    rng = random.Random(9)
    rows = [(i, "w " * int(rng.paretovariate(0.8)), None, f"s{i % 5}") for i in range(1500)]
    rows = [r if len(r[1]) < 40_000 else (r[0], "w " * 20_000, *r[2:]) for r in rows]
    p = mixing.plan(docs_of(rows), weights=weights).select("row.source", "size", "target", "copies", "source_size").collect()
    for s in {r.source for r in p}:
        mine = [r for r in p if r.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= max(r.size for r in mine)
        rate = mine[0].target / mine[0].source_size
        assert {r.copies for r in mine} <= {int(rate), int(rate) + 1}


def test_pipeline(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = cp.run(spark, d)
    assert out.columns == docs.columns and 0 < out.count()
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, d)
        assert empty.columns == docs.columns
    assert empty.count() == 0
    odd = docs.limit(30).withColumns({"id": F.lit(1), "row": F.lit("x"), "n": F.lit(2), "th": F.lit(None).cast("int")})
    for _, stage in cp.STAGES:
        odd = stage(spark, odd, d)
    assert odd.columns == [*docs.columns, "id", "row", "n", "th"] and odd.count() > 0
