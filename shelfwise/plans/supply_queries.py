"""Queries H1–H6 (fulfilment), I1–I8 (merchandising) and J1–J5 (metrics)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from shelfwise.functions.stats import _materialise
from shelfwise.operators import fulfilment as H
from shelfwise.operators import merchandising as M
from shelfwise.operators import metrics as J
from shelfwise.operators import profile as P
from shelfwise.operators import returns as RT
from shelfwise.plans.catalog import finish, query
from shelfwise.plans.risk_queries import RET_P_SQL, RET_SQL, fixed_return_p
from shelfwise.sources.adapter import RetailTables


def _cost_values() -> str:
    rows = []
    for src, c in H.COSTS.items():
        for zone, ship in c["ship"].items():
            rows.append(f"('{src}', '{zone}', {c['pick'] + c['pack'] + ship}::DOUBLE, {H.DAYS[src][zone]})")
    return ", ".join(rows)


def _ful_sql(key: str) -> str:
    """Options and best sources; ``key`` names an order: its row (``rid``) or, in
    the form over exploded options, its id."""
    return f"""
, sstock AS (
  SELECT product_id, store_id, arg_max(stock_level, date) AS stock_level FROM inventory GROUP BY 1, 2
), costs AS (
  SELECT * FROM (VALUES {_cost_values()}) c(type, customer_location, cost, days)
), fo AS MATERIALIZED (
  SELECT *, row_number() OVER () AS rid FROM fulfilment_orders   -- order ids may repeat
), opts0 AS (
  SELECT rid, order_id, product_id, quantity, customer_location, preferred_store,
         'Warehouse' AS source, 'warehouse' AS type, CAST(NULL AS VARCHAR) AS store_id
  FROM fo
  UNION ALL
  SELECT o.rid, o.order_id, o.product_id, o.quantity, o.customer_location, o.preferred_store,
         s.store_id, 'store', s.store_id
  FROM fo o JOIN sstock s ON o.product_id = s.product_id AND s.stock_level >= o.quantity
), opts AS (
  SELECT o.rid, o.order_id, o.product_id, o.quantity, o.customer_location, o.source, o.type, c.cost,
         CASE WHEN o.type = 'store' AND o.store_id = o.preferred_store THEN 1 ELSE c.days END AS delivery_time_days,
         TRUE AS inventory_available, TRUE AS feasible, o.store_id
  FROM opts0 o LEFT JOIN costs c USING (type, customer_location)
), oscored AS (
  SELECT *, 0.7::DOUBLE * cost / max(cost) OVER (PARTITION BY {key})
            + 0.3::DOUBLE * CAST(delivery_time_days AS DOUBLE)
              / max(delivery_time_days) OVER (PARTITION BY {key}) AS score
  FROM opts
), alloc AS (
  SELECT source, type, cost, delivery_time_days, inventory_available, feasible, store_id, score,
         order_id, product_id, quantity
  FROM (SELECT *, row_number() OVER (PARTITION BY {key}
                    ORDER BY score, CAST(type = 'store' AS INTEGER), store_id NULLS FIRST) AS rn
        FROM oscored) WHERE rn = 1
)
"""


FUL_SQL = _ful_sql("rid")


def _rt(spark, sf_dir):
    return RetailTables.of(spark, sf_dir)


def _alloc(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    stock = P.latest_stock(rt.inventory, per_store=True)
    return H.allocate_orders(rt.fulfilment_orders, stock, H.cost_table(spark))


@query("cost_table", sql=FUL_SQL + """
SELECT o.order_id, c.type AS source_type, c.cost, c.days
FROM fulfilment_orders o JOIN costs c ON c.customer_location = o.customer_location""")
def cost_table(spark, sf_dir):
    """Cost and days of both source types for every order's delivery zone."""
    o = _rt(spark, sf_dir).fulfilment_orders.select("order_id", "customer_location")
    c = H.cost_table(spark).withColumnRenamed("zone", "customer_location")
    return o.join(F.broadcast(c), "customer_location").select(        # 6-row side
        "order_id", "source_type", "cost", "days")


@query("expected_demand", sql="""
, pairs AS (SELECT DISTINCT product_id, preferred_store AS store_id FROM fulfilment_orders)
, ps AS (SELECT product_id, store_id, avg(quantity) AS m FROM transactions GROUP BY 1, 2)
, pc AS (SELECT product_id, min(category) AS cat FROM transactions GROUP BY 1)
, cmq AS (SELECT category AS cat, avg(quantity) AS cmean FROM transactions GROUP BY 1)
SELECT p.product_id, p.store_id, coalesce(ps.m, cmq.cmean, 1.0) AS expected_demand
FROM pairs p LEFT JOIN ps USING (product_id, store_id) LEFT JOIN pc USING (product_id)
     LEFT JOIN cmq USING (cat)""", rounded=["expected_demand"])
def expected_demand(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    pairs = rt.fulfilment_orders.select("product_id", F.col("preferred_store").alias("store_id")).distinct()
    return finish(H.expected_demand(pairs, rt.transactions))


OPT_COLS = ["order_id", "product_id", "quantity", "customer_location", "source", "type", "cost",
            "delivery_time_days", "inventory_available", "feasible", "store_id"]


@query("fulfilment_options", sql=FUL_SQL + "SELECT " + ", ".join(OPT_COLS) + " FROM opts")
def fulfilment_options(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    stock = P.latest_stock(rt.inventory, per_store=True)
    return H.fulfilment_options(rt.fulfilment_orders, stock, H.cost_table(spark)).select(*OPT_COLS)


@query("best_source", sql=_ful_sql("order_id") + "SELECT order_id, source, type, cost, delivery_time_days, score FROM alloc",
       rounded=["score"])
def best_source(spark, sf_dir):
    """The row form: best option per order over the exploded option table."""
    rt = _rt(spark, sf_dir)
    stock = P.latest_stock(rt.inventory, per_store=True)
    opts = H.fulfilment_options(rt.fulfilment_orders, stock)
    return finish(H.best_source(opts).select("order_id", "source", "type", "cost",
                                             "delivery_time_days", "score"))


@query("allocate_orders", sql=FUL_SQL + "SELECT * FROM alloc", rounded=["score"])
def allocate_orders(spark, sf_dir):
    return finish(_alloc(spark, sf_dir))


@query("allocate_with_stock")
def allocate_with_stock(spark, sf_dir):
    """All orders against the stock of each store and 1,000 units a store."""
    rt = _rt(spark, sf_dir)
    stock = P.latest_stock(rt.inventory, per_store=True)
    return finish(H.allocate_with_stock(rt.fulfilment_orders, stock, H.cost_table(spark),
                                        max_capacity_per_store=1000))


@query("fulfilment_metrics", sql=FUL_SQL + """
SELECT count(*) AS total_orders, sum(cost) AS total_cost, avg(cost) AS avg_cost_per_order,
       avg(delivery_time_days) AS avg_delivery_time,
       count(CASE WHEN type = 'warehouse' THEN 1 END) AS warehouse_fulfillments,
       count(CASE WHEN type = 'store' THEN 1 END) AS store_fulfillments,
       count(CASE WHEN delivery_time_days <= 5 THEN 1 END) / count(*) AS on_time_rate
FROM alloc""", rounded=["total_cost", "avg_cost_per_order", "avg_delivery_time", "on_time_rate"])
def fulfilment_metrics(spark, sf_dir):
    return finish(H.fulfilment_metrics(_alloc(spark, sf_dir), _rt(spark, sf_dir).fulfilment_orders))


# ---------------------------------------------------------------------------
# Merchandising

MERCH_SQL = """
, ms AS (
  SELECT category, CAST(date_trunc('month', date) AS DATE) AS year_month,
         CAST(sum(quantity) AS BIGINT) AS quantity, sum(total_amount) AS revenue,
         count(*) AS transaction_count
  FROM transactions GROUP BY 1, 2
), tr0 AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY year_month DESC) AS rn,
         count(*) OVER (PARTITION BY category) AS n FROM ms
), trends AS (
  SELECT category, recent, prev, (recent - prev) / (prev + 1) * 100 AS growth_rate FROM (
    SELECT category, avg(CASE WHEN rn <= 3 THEN quantity END) AS recent,
           avg(CASE WHEN rn <= least(n, 6) AND rn > least(n, 6) - 3 THEN quantity END) AS prev,
           max(n) AS n
    FROM tr0 GROUP BY category) WHERE n >= 2
), mf AS (
  SELECT category, year_month, quantity, revenue, transaction_count,
         CAST(month(year_month) AS INTEGER) AS month, CAST(year(year_month) AS INTEGER) AS year,
         CAST(quarter(year_month) AS INTEGER) AS quarter,
         coalesce(lag(quantity, 1) OVER w, 0) AS lag_1, coalesce(lag(quantity, 3) OVER w, 0) AS lag_3,
         coalesce(lag(quantity, 6) OVER w, 0) AS lag_6, coalesce(lag(quantity, 12) OVER w, 0) AS lag_12,
         avg(quantity) OVER (PARTITION BY category ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_mean_3,
         avg(quantity) OVER (PARTITION BY category ORDER BY year_month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rolling_mean_6,
         coalesce(CASE WHEN lag(quantity, 12) OVER w <> 0 THEN quantity / lag(quantity, 12) OVER w END - 1, 0) AS yoy_growth
  FROM ms WINDOW w AS (PARTITION BY category ORDER BY year_month)
), base AS (
  SELECT t.category, CAST((SELECT max(year_month) FROM ms) + INTERVAL (i) MONTH AS DATE) AS year_month,
         CAST(month((SELECT max(year_month) FROM ms) + INTERVAL (i) MONTH) AS INTEGER) AS month,
         CAST(t.recent AS DOUBLE) AS base_forecast
  FROM trends t, range(1, 7) r(i)
)
"""


def _monthly(spark, sf_dir):
    return M.monthly_sales(_rt(spark, sf_dir).transactions)


@query("monthly_sales", sql=MERCH_SQL + "SELECT * FROM ms", rounded=["revenue"])
def monthly_sales(spark, sf_dir):
    return finish(_monthly(spark, sf_dir))


@query("category_trends", sql=MERCH_SQL + """
SELECT category, growth_rate,
       CASE WHEN growth_rate > 10 THEN 'Rising' WHEN growth_rate < -10 THEN 'Declining' ELSE 'Stable' END AS trend_direction,
       recent AS recent_volume, growth_rate AS momentum FROM trends""",
       rounded=["growth_rate", "recent_volume", "momentum"])
def category_trends(spark, sf_dir):
    return finish(M.category_trends(_monthly(spark, sf_dir)))


MF_ROUND = ["revenue", "rolling_mean_3", "rolling_mean_6", "yoy_growth"]


@query("monthly_features", sql=MERCH_SQL + "SELECT * FROM mf", rounded=MF_ROUND)
def monthly_features(spark, sf_dir):
    return finish(M.monthly_features(_monthly(spark, sf_dir)))


@query("external_signals", sql=MERCH_SQL + """
SELECT mf.*, coalesce(e.signal, 0) AS signal FROM mf LEFT JOIN external_signals e USING (year_month)""",
       rounded=MF_ROUND + ["signal"])
def external_signals(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    return finish(M.monthly_features(M.monthly_sales(rt.transactions), rt.external_signals))


_Z = [NormalDist().inv_cdf((k - 0.5) / M.N_SCENARIOS) for k in range(1, M.N_SCENARIOS + 1)]
SCEN_SQL = f"""
, draws AS (
  SELECT b.*, greatest(0, b.base_forecast + b.base_forecast * 0.3 * z.z) AS v
  FROM base b, (SELECT unnest([{", ".join(repr(x) for x in _Z)}]::DOUBLE[]) AS z) z
), scen AS (
  SELECT category, year_month, month, base_forecast, avg(v) AS mean,
         quantile_cont(v, 0.10) AS p10, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median,
         quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.90) AS p90, stddev_pop(v) AS std
  FROM draws GROUP BY 1, 2, 3, 4
)
"""
SCEN_ROUND = ["base_forecast", "mean", "p10", "p25", "median", "p75", "p90", "std"]


def _scenarios(spark, sf_dir):
    return M.scenarios(M.baseline_horizon(_monthly(spark, sf_dir)), draws="stratified")


@query("scenarios", sql=MERCH_SQL + SCEN_SQL + "SELECT * FROM scen", rounded=SCEN_ROUND)
def scenarios(spark, sf_dir):
    """Scenario statistics on the deterministic baseline with stratified draws."""
    return finish(_scenarios(spark, sf_dir))


@query("forecast_risk", sql=MERCH_SQL + SCEN_SQL + """
SELECT *, p90 - p10 AS uncertainty_range, (p90 - p10) / (mean + 1) * 100 AS uncertainty_pct,
       CASE WHEN (p90 - p10) / (mean + 1) * 100 > 0 AND (p90 - p10) / (mean + 1) * 100 <= 20 THEN 'Low'
            WHEN (p90 - p10) / (mean + 1) * 100 > 20 AND (p90 - p10) / (mean + 1) * 100 <= 40 THEN 'Medium'
            WHEN (p90 - p10) / (mean + 1) * 100 > 40 AND (p90 - p10) / (mean + 1) * 100 <= 60 THEN 'High'
            WHEN (p90 - p10) / (mean + 1) * 100 > 60 AND (p90 - p10) / (mean + 1) * 100 <= 100 THEN 'Very High' END AS risk_level,
       (mean - p10) / (mean + 1) * 100 AS downside_risk
FROM scen""", rounded=SCEN_ROUND + ["uncertainty_range", "uncertainty_pct", "downside_risk"])
def forecast_risk(spark, sf_dir):
    return finish(M.forecast_risk(_scenarios(spark, sf_dir)))


@query("trend_model")
def trend_model(spark, sf_dir):
    """In-sample fit of the monthly trend forest."""
    f = _materialise(M.monthly_features(_monthly(spark, sf_dir)))    # one row a category and month
    model = M.train_trend_model(f)
    return finish(model.transform(f.fillna(0)).select(
        "category", "year_month", "quantity", F.col("_pred").alias("prediction")))


@query("buying_horizon")
def buying_horizon(spark, sf_dir):
    """Recursive 6-month forecast per category with Monte Carlo scenarios."""
    f = _materialise(M.monthly_features(_monthly(spark, sf_dir)))    # one row a category and month
    model = M.train_trend_model(f)
    base = M.buying_horizon(model, f, 6)
    return finish(M.forecast_risk(M.scenarios(base)))


# ---------------------------------------------------------------------------
# Metrics

FVA_SQL = MERCH_SQL + """
, fva AS (
  SELECT a.category, a.year_month, CAST(a.quantity AS DOUBLE) AS actual,
         CAST(b.quantity AS DOUBLE) AS forecast, CAST(b.quantity AS DOUBLE) * 0.7 AS lower,
         CAST(b.quantity AS DOUBLE) * 1.3 AS upper
  FROM ms a JOIN ms b ON a.category = b.category
                     AND b.year_month = CAST(a.year_month - INTERVAL 12 MONTH AS DATE)
)
"""


def _fva(spark, sf_dir):
    """Forecast-vs-actual fixture: a month's units against the same month a
    year earlier, with ±30 % bounds."""
    m = _monthly(spark, sf_dir)
    prev = m.select("category", F.add_months("year_month", 12).alias("year_month"),
                    F.col("quantity").cast("double").alias("forecast"))
    return (m.select("category", "year_month", F.col("quantity").cast("double").alias("actual"))
             .join(prev, ["category", "year_month"])
             .withColumn("lower", F.col("forecast") * 0.7)
             .withColumn("upper", F.col("forecast") * 1.3))


@query("forecast_metrics", sql=FVA_SQL + """
SELECT avg(abs(actual - forecast)) AS "MAE", sqrt(avg((actual - forecast) * (actual - forecast))) AS "RMSE",
       1 - sum((actual - forecast) * (actual - forecast))
           / sum((actual - (SELECT avg(actual) FROM fva)) * (actual - (SELECT avg(actual) FROM fva))) AS "R2",
       avg(abs((actual - forecast) / (actual + 1))) * 100 AS "MAPE",
       avg(CAST(actual >= lower AND actual <= upper AS DOUBLE)) AS "Coverage"
FROM fva""", rounded=['"MAE"', '"RMSE"', '"R2"', '"MAPE"', '"Coverage"'])
def forecast_metrics(spark, sf_dir):
    return finish(J.forecast_metrics(_fva(spark, sf_dir), "actual", "forecast", "lower", "upper"))


@query("interval_coverage", sql=FVA_SQL + """
SELECT avg(CAST(actual >= lower AND actual <= upper AS DOUBLE)) AS "Coverage" FROM fva""",
       rounded=['"Coverage"'])
def interval_coverage(spark, sf_dir):
    return finish(J.interval_coverage(_fva(spark, sf_dir), "actual", "lower", "upper"))


CLS_SQL = RET_SQL + f"""
, cls AS (SELECT is_returned AS actual, CAST({RET_P_SQL} > 0.5 AS INTEGER) AS predicted,
                 {RET_P_SQL} AS score FROM rfeat)
, cnt AS (SELECT count(CASE WHEN actual = 1 AND predicted = 1 THEN 1 END) AS tp,
                 count(CASE WHEN actual = 0 AND predicted = 1 THEN 1 END) AS fp,
                 count(CASE WHEN actual = 1 AND predicted = 0 THEN 1 END) AS fn,
                 count(CASE WHEN actual = 0 AND predicted = 0 THEN 1 END) AS tn FROM cls)
"""


def _cls(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    f = RT.return_flag(rt.transactions, rt.returns)
    p = fixed_return_p()
    return f.select(F.col("is_returned").alias("actual"), (p > 0.5).cast("int").alias("predicted"),
                    p.alias("score"))


@query("class_metrics", sql=CLS_SQL + """
SELECT coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS "Accuracy",
       coalesce(tp / nullif(tp + fp, 0), 0) AS "Precision",
       coalesce(tp / nullif(tp + fn, 0), 0) AS "Recall",
       coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS "F1" FROM cnt""",
       rounded=['"Accuracy"', '"Precision"', '"Recall"', '"F1"'])
def class_metrics(spark, sf_dir):
    return finish(J.class_metrics(_cls(spark, sf_dir)))


@query("roc_auc", sql=CLS_SQL + """
, rk AS (SELECT actual, score, row_number() OVER (ORDER BY score) AS rn FROM cls)
, gr AS (SELECT score, avg(rn) AS ar, sum(actual) AS p, count(*) AS c FROM rk GROUP BY score)
SELECT (sum(ar * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(c) - sum(p))) AS "ROC_AUC" FROM gr""",
       rounded=['"ROC_AUC"'])
def roc_auc(spark, sf_dir):
    return finish(J.roc_auc(_cls(spark, sf_dir), "actual", "score"))


@query("class_report", sql=CLS_SQL + """
SELECT 1 AS class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
       coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM cnt
UNION ALL
SELECT 0, coalesce(tn / nullif(tn + fn, 0), 0), coalesce(tn / nullif(tn + fp, 0), 0),
       coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0), tn + fp FROM cnt""",
       rounded=["precision", "recall", "f1"])
def class_report(spark, sf_dir):
    return finish(J.class_report(_cls(spark, sf_dir)))
