"""Findings of round 3 on time and shuffles: the plans and helpers that a cost hangs on."""

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators import demand as D
from shelfwise.operators import fulfilment as H
from shelfwise.operators import recommend as E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _stock_and_orders(spark):
    stock = spark.createDataFrame(
        [(p, f"Store_{s:03d}" if s else None, (7 * p + 3 * s) % 11) for p in range(6) for s in range(12)],
        "product_id long, store_id string, stock_level long")
    orders = spark.createDataFrame(
        [(f"o{i}", i % 7, (i % 9) if i % 10 else None, ["Local", "Regional", "National", None][i % 4],
          f"Store_{i % 14:03d}" if i % 5 else None) for i in range(200)],
        "order_id string, product_id long, quantity int, customer_location string, preferred_store string")
    return orders, stock


def test_best_only_keeps_three_options_and_the_same_choice(spark):
    orders, stock = _stock_and_orders(spark)
    kept = H._option_array(orders, stock, best_only=True).agg(F.max(F.size("_opts"))).first()[0]
    assert kept == 3
    assert H._option_array(orders, stock).agg(F.max(F.size("_opts"))).first()[0] > 3
    cols = ["order_id", "source", "type", "cost", "delivery_time_days", "store_id", "score"]
    got = {tuple(r) for r in H.allocate_orders(orders, stock).select(*cols).collect()}
    want = {tuple(r) for r in H.best_source(H.fulfilment_options(orders, stock)).select(*cols).collect()}
    assert got == want and len(got) == 200


def test_seasons_read_the_days_once_and_shuffle_no_terms(spark):
    days = spark.createDataFrame([(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), i % 5) for k in "abc"
                                  for i in range(40)], "k string, date date, quantity int")
    plan = _plan(D.fit_seasons(days, ["k"]))
    assert "Join" not in plan
    assert "SIN" not in plan[plan.rindex("Exchange"):]


def test_quantiles_write_distinct_values(spark, monkeypatch):
    from shelfwise.functions import stats
    written, real = [], stats._materialise
    monkeypatch.setattr(stats, "_materialise", lambda df: written.append(real(df)) or written[-1])
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    got = {(r.g, r.q): r.value for r in stats.exact_quantiles(df, "v", [0.25, 0.5], by=["g"], max_cell_rows=100).collect()}
    assert written[0].count() == 14
    assert got == {(g, q): {0.25: 1.0, 0.5: 3.0}[q] for g in (0, 1) for q in (0.25, 0.5)}


def test_best_source_sends_a_store_name_once(spark):
    opts = spark.createDataFrame(
        [("a", "Warehouse", "warehouse", 6.0, 3, None), ("a", "S2", "store", 8.0, 1, "S2"), ("a", "S1", "store", 8.0, 1, "S1"),
         ("b", "Depot", "store", 1.0, 1, "S9"), ("c", None, "store", 1.0, 1, None), ("d", None, "store", 1.0, 1, "S3")],
        "order_id string, source string, type string, cost double, delivery_time_days int, store_id string")
    best = H.best_source(opts)
    assert best.columns == [*opts.columns, "score"]
    assert {(r.order_id, r.source, r.store_id) for r in best.collect()} == {
        ("a", "S1", "S1"), ("b", "Depot", "S9"), ("c", None, None), ("d", None, "S3")}
    assert "_same" in _plan(best).split("Exchange", 1)[1]


def test_demand_forest_fits_stored_rows_on_all_cores(spark, monkeypatch):
    seen, fit = [], D.Pipeline.fit

    def recorded(self, df):
        seen.append((df.rdd.getNumPartitions(), df.storageLevel.useMemory, self.getStages()[-1].getCacheNodeIds()))
        return fit(self, df)

    monkeypatch.setattr(D.Pipeline, "fit", recorded)
    rows = spark.range(200, numPartitions=1).select(
        *[(F.col("id") % (k + 2)).alias(c) for k, c in enumerate(D.FEATURES)], (F.col("id") % 7).alias("quantity"))
    model = D.train_demand(rows, params=D.ForestParams(num_trees=2, max_depth=3))
    assert seen == [(spark.sparkContext.defaultParallelism, True, True)]
    assert model.stages[-1].getNumTrees == 2 and model.transform(rows).count() == 200


def test_recent_history_sorts_once_and_keeps_no_table_of_series(spark):
    days = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), i * i % 11, 2.0) for i in range(40)]
    days += [("b", dt.date(2024, 1, 1) + dt.timedelta(days=3 * i), i, 1.0) for i in range(8)]
    days += [(None, dt.date(2024, 1, 1), 5, 3.0)]
    out = D.recent_history(spark.createDataFrame(days, "k string, date date, quantity long, price double"), ["k"])
    plan = _plan(out)
    assert "HashAggregate" not in plan and "WindowGroupLimit" not in plan and plan.count("Sort [") == 1
    got = {r.k: r for r in out.collect()}
    q = [i * i % 11 for i in range(40)]
    assert len(got) == 3 and got["a"].lag_1 == q[-1] and got[None].lag_1 == got[None].lag_30 == 5.0
    for rows, c in ((7, "lag_7"), (14, "lag_14"), (30, "lag_30"), (7, "rolling_mean_7")):
        assert abs(got["a"][c] - sum(q[-rows:]) / rows) < 1e-12
    assert abs(got["b"].rolling_std_7 - (28 / 6) ** 0.5) < 1e-12 and got["b"].lag_14 == 0.0
    assert got[None].rolling_std_7 == got[None].lag_7 == 0.0 and got["a"].group_mean_price == 2.0


def _small_shop(spark):
    products = spark.createDataFrame([(i, "ABC"[i % 3], float(10 + 7 * i % 40)) for i in range(60)],
                                     "product_id long, category string, price double")
    bought = spark.createDataFrame([(c, (c * 7 + k * k) % 60, 1) for c in range(12) for k in range(1 + 3 * c)],
                                   "customer_id long, product_id long, quantity int")
    return bought, products


def test_recommend_content_joins_blocks_and_leaves_purchases_out_in_the_row(spark, monkeypatch):
    bought, products = _small_shop(spark)
    out = E.recommend_content(bought, products, 5)
    assert "LeftAnti" not in _plan(out)
    rows = {tuple(r) for r in out.collect()}
    assert len(rows) == 60
    for own, chunk in ((2, 64), (64, 4)):            # long lists are joined, ranges span blocks: the same rows
        monkeypatch.setattr(E, "OWN", own)
        monkeypatch.setattr(E, "CHUNK", chunk)
        other = E.recommend_content(bought, products, 5)
        assert ("LeftAnti" in _plan(other)) == (own == 2)
        assert {tuple(r) for r in other.collect()} == rows


def test_near_sends_a_range_once_per_block(spark):
    items = spark.range(300).select(F.lit("A").alias("category"), F.col("id").alias("pos"),
                                    (1000 + F.col("id")).alias("product_id"), F.lit(0.5).alias("price_norm"))
    ranges = spark.createDataFrame([("A", 5, 40), ("A", 60, 70), ("A", 9, 9)], "category string, lo long, hi long")
    got = sorted(sorted(e.product_id - 1000 for e in r._near) for r in E._near(ranges, items, "pos").collect())
    assert got == [list(range(5, 40)), list(range(60, 64)), list(range(64, 70))]


def test_similar_products_ranks_in_the_row(spark):
    _, products = _small_shop(spark)
    out = E.similar_products(products, 4)
    assert "windowspecdefinition(product_id" not in _plan(out)      # no sort of all candidates
    rows = out.collect()
    assert len(rows) == 240 and all(r.product_id != r.similar_product_id for r in rows)


def test_similar_products_with_rows_that_come_twice(spark):
    """Both rows of a product bring the same partners: each comes twice for it and its partners."""
    one = [(1, "A", 10.0), (2, "A", 20.0), (3, "A", 40.0), (4, "B", 5.0)]
    pdf = spark.createDataFrame([*one, one[1]], "product_id long, category string, price double")
    got = {}
    for r in E.similar_products(pdf, 3).orderBy("product_id", "rank").collect():
        got.setdefault(r.product_id, []).append(r.similar_product_id)
    assert got[1] == [2, 2, 4] and got[2] == [1, 1, 3] and got[3][:2] == [2, 2]
