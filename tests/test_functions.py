"""Shared expressions and distributed statistics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions.exprs import band, calendar_columns, safe_div
from shelfwise.functions.stats import exact_quantiles, roc_auc


def test_band_is_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.05, 0.1, 0.1000001, 0.3, 0.5, 1.0, 1.5, -1.0]],
                               "x double")
    out = df.select("x", band("x", [0.0, 0.1, 0.3, 0.5, 1.0], ["L", "M", "H", "VH"]).alias("b"))
    got = {r.x: r.b for r in out.collect()}
    assert got[0.0] is None                      # left-open
    assert got[0.05] == "L" and got[0.1] == "L"  # right-closed
    assert got[0.1000001] == "M"
    assert got[0.3] == "M" and got[0.5] == "H" and got[1.0] == "VH"
    assert got[1.5] is None and got[-1.0] is None


def test_band_arity():
    with pytest.raises(ValueError):
        band("x", [0, 1], ["a", "b"])


def test_safe_div(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r.q for r in df.select(safe_div("a", "b").alias("q")).collect()] == [0.0, 0.0, 1.5]


def test_calendar_monday_is_zero(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-06",), ("2024-11-30",)], "d string")
    out = calendar_columns(df.select(F.to_date("d").alias("date"))).collect()
    assert [r.day_of_week for r in out] == [0, 5, 5]
    assert [r.is_weekend for r in out] == [0, 1, 1]
    assert out[2].is_holiday_season == 1 and out[2].is_fall == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_match_numpy(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in ("a", "b", "c"):
        n = rng.randint(1, 400)
        for _ in range(n):
            # many ties and a heavy value to stress single cells
            v = rng.choice([rng.random() * 100, 7.0, 7.0, 1e6 if rng.random() < 0.01 else 3.0])
            rows.append((g, v))
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r.g, r.q): r.value for r in exact_quantiles(df, "v", qs, by=["g"]).collect()}
    for g in ("a", "b", "c"):
        vals = np.array([v for gg, v in rows if gg == g])
        for q in qs:
            assert math.isclose(got[(g, q)], float(np.quantile(vals, q)), rel_tol=1e-12, abs_tol=1e-9)


def test_roc_auc_matches_pairwise(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(600)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = roc_auc(df, "y", "s").first()[0]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    assert math.isclose(got, wins / (len(pos) * len(neg)), rel_tol=1e-12)


def test_roc_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert roc_auc(df, "y", "s").first()[0] is None


def test_exact_quantiles_refine_dense_cluster_with_outliers(spark):
    """A tight cluster plus far outliers lands in one level-1 cell; the cell is
    re-binned until it is small, and the result stays exact."""
    rng = random.Random(7)
    rows = [("a" if i % 3 else "b", 1.0 + rng.random() * 1e-9) for i in range(3000)]
    rows += [("a", 1e12), ("b", -1e9)]
    df = spark.createDataFrame(rows, "g string, v double")
    for by in ([], ["g"]):
        for r in exact_quantiles(df, "v", [0.0, 0.3, 0.5, 0.99, 1.0], by=by,
                                 max_cell_rows=50).collect():
            vals = np.array([v for g, v in rows if not by or g == r["g"]])
            assert r.value == float(np.quantile(vals, r.q))
