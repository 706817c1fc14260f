"""Fits read a frame that was written once, not the joins behind it."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import customers as C
from shelfwise.operators import factors as M
from shelfwise.operators import fraud as G
from shelfwise.operators import isoforest as IF
from shelfwise.operators import merchandising as MM
from shelfwise.operators import pricing as PR
from shelfwise.operators import returns as RT
from shelfwise.plans import QUERIES


class Seen(Exception):
    pass


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("star"))
    day = lambda i: datetime.date(2023, 1, 1) + datetime.timedelta(days=i)
    tables = {
        "lineitem": ([(o, 1 + (o * 3 + n) % 7, 1 + o % 3, n, float(1 + (o + n) % 9), 0.01 * (o % 10), 0.02, "NRA"[o % 3])
                      for o in range(1, 41) for n in (1, 2)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_discount double, l_tax double, l_returnflag string"),
        "orders": ([(o, 1 + o % 6, day(o * 9)) for o in range(1, 41)], "o_orderkey long, o_custkey long, o_orderdate date"),
        "part": ([(p, f"type {p % 2}", 10.0 * p) for p in range(1, 8)], "p_partkey long, p_type string, p_retailprice double"),
        "customer": ([(c, "BUILDING", 0) for c in range(1, 8)], "c_custkey long, c_mktsegment string, c_nationkey int"),
        "nation": ([(0, 0)], "n_nationkey int, n_regionkey int")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def has_join(df):
    return "Join" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query, module, fit", [
    ("churn_model", C, "train_churn_model"), ("fitted_customer_value", C, "train_churn_model"),
    ("hazard_model", C, "hazard_model"), ("return_model", RT, "train_return_model"),
    ("score_returns", RT, "train_return_model"), ("return_importance", RT, "train_return_model"),
    ("fraud_classifier", G, "train_fraud_classifier"), ("fitted_fraud_scores", G, "train_fraud_classifier"),
    ("pseudo_labels", G, "pseudo_labels"), ("isolation_forest", IF, "isolation_forest"),
    ("als_factors", M, "als_factors"), ("recommend_cf", M, "als_factors"), ("nmf_factors", M, "nmf_factors")])
def test_fits_read_written_frames(spark, star, monkeypatch, query, module, fit):
    def stop(frame, *args, **kw):
        assert not has_join(frame) and frame.count() > 0
        raise Seen

    monkeypatch.setattr(module, fit, stop)
    with pytest.raises(Seen):
        QUERIES[query](spark, star)


def test_trend_model_reads_months_once(spark, star, monkeypatch):
    def stop(frame, *args, **kw):
        assert not any(x in frame._jdf.queryExecution().optimizedPlan().toString() for x in ("Join", "Window", "parquet"))
        raise Seen

    monkeypatch.setattr(MM, "train_trend_model", stop)
    for query in ("buying_horizon", "trend_model"):
        with pytest.raises(Seen):
            QUERIES[query](spark, star)


def test_demand_price_rows_are_written_once(spark):
    t = spark.createDataFrame([(f"t{i}", datetime.date(2024, 1 + i % 12, 1), i % 5, 9.0 - i % 3, i % 4) for i in range(80)],
                              "transaction_id string, date date, product_id long, unit_price double, quantity int")
    p = spark.createDataFrame([(i, 10.0, f"c{i % 2}") for i in range(5)], "product_id long, price double, category string")
    _, test = PR.train_demand_price(PR.demand_price_frame(t, p), PR.BoostParams(max_iter=1, max_depth=1))
    assert not has_join(test) and test.count() > 0


def test_isolation_forest_scores_rows_once(spark, monkeypatch):
    d = spark.range(300).select(F.col("id"), (F.col("id") % 17).cast("double").alias("a"),
                                F.when(F.col("id") % 11 > 0, F.col("id") * 0.5).alias("b"))
    params = IF.IForestParams(n_trees=6, sample_size=32)
    model = IF.train_isolation_forest(d, ["a", "b"], "id", params)
    want = sorted(map(tuple, IF.score_anomalies(model, d).collect()), key=str)
    calls, score = [], IF.score_isolation_forest
    monkeypatch.setattr(IF, "score_isolation_forest", lambda *a: calls.append(1) or score(*a))
    got = IF.isolation_forest(d, ["a", "b"], "id", params)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len(calls) == 1


def test_walk_equals_a_plain_descent():
    import pandas as pd
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 4, 500).astype(float), rng.standard_normal(500), np.zeros(500)])
    rows = [r for t in range(5) for r in IF._grow(t, x[rng.choice(500, 64)], 6, 1)]
    table = pd.DataFrame(rows, columns=[f.name for f in IF.NODE_SCHEMA.fields])
    want = np.zeros(len(x))
    for _, tree in table.groupby("tree"):
        nodes = tree.set_index("node")
        for i, v in enumerate(x):
            n = nodes.loc[0]
            while n.feature >= 0:
                n = nodes.loc[n.left if v[int(n.feature)] < n.threshold else n.right]
            want[i] += n.depth + IF.avg_path([n["size"]])[0]
    assert np.allclose(IF._Walk.of(table, 5, 1.0, 3).lengths(x), want, rtol=0, atol=1e-9)


def test_als_drops_each_iterations_shuffle_files(spark, monkeypatch):
    seen, als = {}, M.ALS
    monkeypatch.setattr(M, "ALS", lambda **kw: seen.update(kw) or als(**kw))
    inter = spark.createDataFrame([(u, i, 1 + u % 3) for u in range(6) for i in range(4) if (u + i) % 2],
                                  "customer_id long, product_id long, quantity int")
    M.als_factors(inter, M.ALSParams(rank=2, max_iter=2))
    assert seen["checkpointInterval"] == 1


def test_nmf_sends_only_rows_with_purchases(spark):
    cells = M._cell_blocks(spark.createDataFrame([(3, 1, 2.0), (500, 2, 1.0), (700, 0, 4.0)], "u long, i long, x double"), 512)
    h = M._first_factors(spark, 5, 2, 1.0, 7, 512)
    parts = M._products(cells, "ub", "ib", h, 2, 512)
    assert "Broadcast" not in parts._jdf.queryExecution().executedPlan().toString()
    f = np.frombuffer(h.first()["m"]).reshape(-1, 2)
    got = {r["b"]: (np.frombuffer(r["r"], np.int32).tolist(), np.frombuffer(r["m"]).reshape(-1, 2)) for r in parts.collect()}
    assert {b: r for b, (r, _) in got.items()} == {0: [3, 500], 1: [188]}
    assert np.allclose(got[0][1], [2 * f[1], f[2]]) and np.allclose(got[1][1], [4 * f[0]])
