"""Embedding near-duplicates against all pairs in double precision."""

import numpy as np
import pytest
from llm_fixtures import table  # noqa: F401
from shelfwise.llm import pq


def brute(rows, cosine=0.95):
    ids = [i for i, _ in rows]
    x = [None if v is None or any(c is None for c in v) else np.array(v, float) for _, v in rows]
    ok = [v is not None and len(v) > 0 and np.isfinite(v).all() and v.any() for v in x]
    n = np.zeros(len(rows), int)
    comp = list(ids)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and len(x[i]) == len(x[j])
             and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= cosine]
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    for _ in rows:
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return sorted(zip(ids, n.tolist(), comp, [i == c for i, c in zip(ids, comp, strict=True)], strict=True))


def result(df, **kw):
    return sorted(tuple(r) for r in pq.near_duplicates(df, **kw).collect())


def test_recall_on_near_copies(table, spark):
    """The embeddings and noisy copies of them, with cosines around the limit."""
    rng = np.random.default_rng(1)
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in table("embeddings", "0.01").collect()]
    for i, v in list(rows):
        noise = rng.normal(size=len(v)) * np.linalg.norm(v) / np.sqrt(len(v))
        rows.append((1000 + i, (np.array(v) + noise * rng.uniform(0.1, 0.4)).tolist()))
    want = brute(rows)
    got = result(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list_size=40)
    links, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert links > 300 and found >= 0.95 * links
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("max_list", [2048, 5])
def test_dense_cluster_and_edge_cases(spark, max_list):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.15).tolist()) for i in range(40)]
    rows += [(100 + i, rng.normal(size=16).tolist()) for i in range(60)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (201, rows[3][1]), (202, [2.5 * c for c in rows[4][1]]),
             (300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [None] + [1.0] * 15),
             (304, [float("inf")] * 16), (305, []), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [1e300] * 16),
             (309, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                               "vec_id long, embedding array<double>, key string, n int")
    assert result(df, max_list=max_list, probes=64) == brute(
        [(i, [1.0] * 16 if i == 308 else v) for i, v in rows])
    assert result(df.limit(0)) == []
    assert result(df.filter("vec_id = 300")) == [(300, 0, 300, True)]
