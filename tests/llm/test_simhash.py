"""SimHash near-duplicates against all pairs in plain Python."""

import random
import re

import numpy as np
import xxhash

from llm_fixtures import docs_of, table  # noqa: F401
from shelfwise.llm import simhash as sh


def fingerprint(text, k=4):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    runs = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    out = 0
    for bit in range(64):
        n = sum(xxhash.xxh64_intdigest(r, 42) >> bit & 1 for r in runs)
        out |= (2 * n > len(runs)) << bit
    return out


def components(fps, radius):
    """fps: (id, fp); smallest reachable id by repeated passes."""
    comp = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= radius and comp[j] < comp[i]:
                    comp[i] = comp[j]
                    changed = True
    return comp


def result(docs):
    return {r.id: (r.fp & (2**64 - 1), r.component_id) for r in sh.near_duplicates(docs).collect()}


def test_documents_against_all_pairs(table):
    docs = table("documents")
    fps = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    comp = components(fps, 4)
    assert result(docs) == {i: (f, comp[i]) for i, f in fps}
    assert len(set(comp.values())) < len(comp)


def test_edge_cases(docs_of, spark):
    docs = docs_of([(5, None), (4, ""), (9, " \t\n"), (7, "One two"), (8, "one  TWO"), (8, "one  TWO"),
                    (1, "été à la" + " mot" * 5000), (2, "x"), (None, "x")])
    fps = [(r.doc_id, fingerprint(r.text)) for r in docs.collect() if r.doc_id is not None]
    comp = components(fps, 4)
    got = sh.near_duplicates(docs).collect()
    assert len(got) == 9
    assert {(r.id, r.fp & (2**64 - 1), r.component_id) for r in got if r.id is not None} == {
        (i, f, comp[i]) for i, f in fps}
    assert [r.component_id for r in got if r.id is None] == [2]
    kept = sh.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))
    assert sh.near_duplicates(docs.limit(0)).count() == 0
    assert sh.drop_near_duplicates(docs.limit(0)).count() == 0


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "a b", 3, 4, "z"), (2, "a b", 5, 6, "y")],
                               "doc_id long, text string, id long, n int, fp string")
    assert sh.drop_near_duplicates(df).collect() == df.filter("doc_id = 1").collect()


def test_shards_split_without_loss(spark):
    """A tight cluster, cut into many parts, links like all pairs do."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        x = centre
        for _ in range(rng.randint(1, 9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    rows = [(int(np.array(f, np.uint64).view(np.int64)),) for f in fps]
    df = spark.createDataFrame(rows, "fp long")
    want = components([(r[0], r[0] & (2**64 - 1)) for r in rows], 4)
    for size in (7, 4096):
        edges = sh.near_links(df, 4, max_shard=size)
        got = {r.node: r.component for r in sh.connected_components(edges, "u", "v").collect()}
        assert {i: got.get(i, i) for i, in rows} == want
