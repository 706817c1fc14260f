"""Queries F1–F14 (returns) and G1–G12 (fraud, except the forest in G6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import fraud as G
from shelfwise.operators import returns as RT
from shelfwise.plans.catalog import finish, query
from shelfwise.sources.adapter import RetailTables

# Deterministic stand-in scores (fixed values of the fixtures).
def fixed_return_p():
    return ((F.col("customer_id") * 7919 + F.col("product_id") * 31) % 1000).cast("double") / 1000


RET_P_SQL = "CAST((customer_id * 7919 + product_id * 31) % 1000 AS DOUBLE) / 1000"
FRAUD_P_SQL = "CAST((customer_id * 7919) % 1000 AS DOUBLE) / 1000"
ANOM_SQL = "CAST((product_id * 7919) % 1000 AS DOUBLE) / 1000"

RET_SQL = """
, rf AS (
  SELECT t.transaction_id, t.date, t.customer_id, t.product_id, t.store_id, t.channel, t.quantity,
         t.unit_price, t.total_amount, t.discount_applied, p.category, p.price,
         CASE WHEN r.transaction_id IS NOT NULL THEN 1 ELSE 0 END AS is_returned,
         coalesce(r.return_reason, 'Not Returned') AS return_reason,
         coalesce(r.is_fraud, 0) AS is_fraud
  FROM transactions t
  LEFT JOIN products p USING (product_id)
  LEFT JOIN (SELECT transaction_id, min(return_reason) AS return_reason,
                    max(CAST(is_fraud AS INTEGER)) AS is_fraud FROM returns GROUP BY 1) r USING (transaction_id)
), crh AS (
  SELECT customer_id, count(*) AS total_transactions, CAST(sum(CAST(round(total_amount * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS total_spend,
         (CAST(sum(CAST(round(total_amount * 10000) AS BIGINT)) AS DOUBLE) / 10000) / count(total_amount) AS avg_order_value, CAST(sum(is_returned) AS BIGINT) AS historical_returns,
         sum(is_returned) / (count(*) + 1) AS historical_return_rate
  FROM rf GROUP BY 1
), prh AS (
  SELECT product_id, avg(is_returned) AS product_return_rate, avg(quantity) AS avg_quantity FROM rf GROUP BY 1
), rfeat AS (
  SELECT rf.*, crh.total_transactions, crh.total_spend, crh.avg_order_value, crh.historical_returns,
         crh.historical_return_rate, prh.product_return_rate,
         (price - unit_price) / (price + 0.000001) AS discount_pct,
         CAST((price - unit_price) / (price + 0.000001) > 0.05 AS INTEGER) AS is_discounted,
         CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
         CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend,
         CAST(month(date) IN (11, 12) AS INTEGER) AS is_holiday_season,
         CAST(channel = 'Online' AS INTEGER) AS is_online
  FROM rf LEFT JOIN crh USING (customer_id) LEFT JOIN prh USING (product_id)
)
"""


def _rt(spark, sf_dir):
    return RetailTables.of(spark, sf_dir)


def _ret_features(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    return RT.return_features(rt.transactions, rt.returns, rt.products)


@query("return_flag", sql=RET_SQL + "SELECT transaction_id, is_returned FROM rf")
def return_flag(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    return RT.return_flag(rt.transactions, rt.returns).select("transaction_id", "is_returned")


@query("return_details", sql=RET_SQL + "SELECT transaction_id, is_returned, return_reason, is_fraud FROM rf")
def return_details(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    f = RT.return_details(RT.return_flag(rt.transactions, rt.returns), rt.returns)
    return f.select("transaction_id", "is_returned", "return_reason", "is_fraud")


@query("customer_return_history", sql=RET_SQL + "SELECT * FROM crh")
def customer_return_history(spark, sf_dir):
    """Exact money sums and count ratios: compared unrounded."""
    rt = _rt(spark, sf_dir)
    return RT.customer_return_history(RT.return_flag(rt.transactions, rt.returns))


@query("product_return_history", sql=RET_SQL + "SELECT * FROM prh",
       rounded=["product_return_rate", "avg_quantity"])
def product_return_history(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    return finish(RT.product_return_history(RT.return_flag(rt.transactions, rt.returns)))


TXF = ["transaction_id", "discount_pct", "is_discounted", "month", "day_of_week", "is_weekend",
       "is_holiday_season", "is_online"]


@query("txn_return_features", sql=RET_SQL + "SELECT " + ", ".join(TXF) + " FROM rfeat",
       rounded=["discount_pct"])
def txn_return_features(spark, sf_dir):
    return finish(_ret_features(spark, sf_dir).select(*TXF))


@query("encode_category", sql=RET_SQL + """
SELECT transaction_id, coalesce(category, 'Unknown') AS category,
       CAST(dense_rank() OVER (ORDER BY coalesce(category, 'Unknown')) - 1 AS DOUBLE) AS category_encoded
FROM rfeat""")
def encode_category(spark, sf_dir):
    enc, _ = RT.encode_category(_ret_features(spark, sf_dir))
    return enc.select("transaction_id", "category", "category_encoded")


RISK_SQL = """CASE WHEN p > 0 AND p <= 0.1 THEN 'Low' WHEN p > 0.1 AND p <= 0.3 THEN 'Medium'
                   WHEN p > 0.3 AND p <= 0.5 THEN 'High' WHEN p > 0.5 AND p <= 1.0 THEN 'Very High' END"""


@query("high_return_risk", sql=RET_SQL + f"""
SELECT transaction_id, customer_id, product_id, date, p AS return_probability, {RISK_SQL} AS return_risk
FROM (SELECT *, {RET_P_SQL} AS p FROM rfeat) WHERE p > 0.3""", rounded=["return_probability"])
def high_return_risk(spark, sf_dir):
    f = _ret_features(spark, sf_dir).withColumn("return_probability", fixed_return_p())
    s = RT.return_risk_band(f).select("transaction_id", "customer_id", "product_id", "date",
                                      "return_probability", "return_risk")
    return finish(RT.high_return_risk(s))


def _factor_sql():
    parts = []
    for c in RT.FACTOR_COLUMNS:
        parts.append(f"""SELECT '{c}' AS "column",
               CAST(avg(CASE WHEN is_returned = 1 THEN {c} END) AS DOUBLE) AS returned_mean,
               CAST(avg(CASE WHEN is_returned = 0 THEN {c} END) AS DOUBLE) AS not_returned_mean,
               CAST(avg(CASE WHEN is_returned = 1 THEN {c} END) AS DOUBLE)
                 - CAST(avg(CASE WHEN is_returned = 0 THEN {c} END) AS DOUBLE) AS difference
        FROM rfeat""")
    return "\nUNION ALL\n".join(parts)


@query("return_factors", sql=RET_SQL + _factor_sql(),
       rounded=["returned_mean", "not_returned_mean", "difference"])
def return_factors(spark, sf_dir):
    return finish(RT.return_factors(_ret_features(spark, sf_dir)))


@query("category_return_rate", sql=RET_SQL + """
SELECT category, avg(is_returned) AS return_rate FROM rfeat GROUP BY category""",
       rounded=["return_rate"])
def category_return_rate(spark, sf_dir):
    return finish(RT.category_return_rate(_ret_features(spark, sf_dir)))


@query("return_reason_share", sql=RET_SQL + """
SELECT return_reason, count(*) / (SELECT count(*) FROM rfeat WHERE is_returned = 1) AS share
FROM rfeat WHERE is_returned = 1 GROUP BY return_reason""", rounded=["share"])
def return_reason_share(spark, sf_dir):
    return finish(RT.return_reason_share(_ret_features(spark, sf_dir)))


@query("stratified_split", sql=RET_SQL + """
, drawn AS (
  SELECT transaction_id, is_returned,
         CAST(('0x' || substr(md5('42:' || CAST(transaction_id AS VARCHAR)), 1, 13)) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS h
  FROM rfeat
), cuts AS (SELECT is_returned, quantile_cont(h, 0.8) AS c FROM drawn GROUP BY 1)
SELECT transaction_id, is_returned, CASE WHEN h <= c THEN 'train' ELSE 'test' END AS split
FROM drawn JOIN cuts USING (is_returned)""")
def stratified_split(spark, sf_dir):
    f = _ret_features(spark, sf_dir)
    return RT.stratified_split(f, "is_returned", "transaction_id").select(
        "transaction_id", "is_returned", "split")


def _return_model(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    f = RT.model_frame(RT.return_features(rt.transactions, rt.returns, rt.products, as_of=True))
    return RT.train_return_model(f)


@query("return_model")
def return_model(spark, sf_dir):
    """Held-out test rows scored by the boosted classifier."""
    _, test = _return_model(spark, sf_dir)
    return finish(test)


@query("score_returns")
def score_returns(spark, sf_dir):
    """Score every transaction with the fitted model (as-of features)."""
    rt = _rt(spark, sf_dir)
    f = RT.model_frame(RT.return_features(rt.transactions, rt.returns, rt.products, as_of=True))
    model, _ = RT.train_return_model(f)
    return finish(RT.score_returns(model, f))


@query("return_importance")
def return_importance(spark, sf_dir):
    model, _ = _return_model(spark, sf_dir)
    return finish(RT.return_importance(model, spark))


# ---------------------------------------------------------------------------
# Fraud

FRAUD_SQL = """
, ri AS (
  SELECT transaction_id, max(CAST(is_fraud AS INTEGER)) AS is_fraud, min(return_date) AS return_date
  FROM returns GROUP BY 1
), cs AS (
  SELECT customer_id, count(*) AS transaction_count, CAST(sum(CAST(round(total_amount * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS total_spend,
         (CAST(sum(CAST(round(total_amount * 10000) AS BIGINT)) AS DOUBLE) / 10000) / count(total_amount) AS avg_order_value, stddev_samp(total_amount) AS order_value_std,
         CAST(sum(quantity) AS BIGINT) AS total_quantity, min(date) AS first_purchase,
         max(date) AS last_purchase,
         CAST(coalesce(date_diff('day', min(date), max(date)), 0) AS INTEGER) AS customer_tenure
  FROM transactions GROUP BY 1
), crt AS (
  SELECT customer_id, count(return_id) AS return_count,
         CAST(sum(CAST(is_fraud AS INTEGER)) AS BIGINT) AS fraud_count FROM returns GROUP BY 1
), fhist AS (
  SELECT cs.*, coalesce(crt.return_count, 0) AS return_count, coalesce(crt.fraud_count, 0) AS fraud_count,
         coalesce(crt.return_count, 0) / (cs.transaction_count + 1) AS return_rate
  FROM cs LEFT JOIN crt USING (customer_id)
), ff AS (
  SELECT t.*, p.price, coalesce(ri.is_fraud, 0) AS is_fraud, ri.return_date,
         CAST(ri.return_date IS NOT NULL AS INTEGER) AS has_return,
         h.transaction_count, h.total_spend, h.avg_order_value, h.order_value_std,
         h.first_purchase, h.last_purchase, h.customer_tenure, h.return_count, h.fraud_count, h.return_rate
  FROM transactions t LEFT JOIN products p USING (product_id)
  LEFT JOIN ri USING (transaction_id) LEFT JOIN fhist h USING (customer_id)
), fi AS (
  SELECT *, CAST(total_amount > avg_order_value * 2 AS INTEGER) AS high_value_order,
         CAST(quantity > 5 AS INTEGER) AS unusual_quantity, 0 AS hour, 0 AS is_late_night,
         coalesce(CAST((price - unit_price) / (price + 0.000001) > 0.5 AS INTEGER), 0) AS high_discount,
         CAST(has_return = 1 AND return_rate > 0.3 AND transaction_count < 5 AS INTEGER) AS wardrobing_risk,
         CAST(transaction_count > 10 AS INTEGER) AS rapid_purchases
  FROM ff
), fscored AS (
  SELECT *, 0.6 * fp + 0.4 * an AS fraud_risk_score, an > 0.7 AS actual
  FROM (SELECT *, {fp} AS fp, {an} AS an FROM fi)
)
""".replace("{fp}", FRAUD_P_SQL).replace("{an}", ANOM_SQL)


def _fraud_features(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    return G.fraud_features(rt.transactions, rt.returns, rt.products)


def _fixed_fraud_scores(df):
    return df.withColumns({
        "fraud_probability": RetailTables.fixed_score("customer_id"),
        "anomaly_score": RetailTables.fixed_score("product_id"),
    })


@query("txn_return_info", sql=FRAUD_SQL + "SELECT transaction_id, is_fraud, return_date, has_return FROM ff")
def txn_return_info(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    return G.txn_return_info(rt.transactions, rt.returns).select(
        "transaction_id", "is_fraud", "return_date", "has_return")


EXACT_MONEY = ["total_spend", "avg_order_value", "return_rate"]


@query("customer_stats", sql=FRAUD_SQL + "SELECT * FROM cs", rounded=["order_value_std"])
def customer_stats(spark, sf_dir):
    return finish(G.customer_stats(_rt(spark, sf_dir).transactions), exact=EXACT_MONEY)


@query("customer_returns", sql=FRAUD_SQL + "SELECT * FROM fhist", rounded=["order_value_std"])
def customer_returns(spark, sf_dir):
    rt = _rt(spark, sf_dir)
    return finish(G.customer_returns(G.customer_stats(rt.transactions), rt.returns),
                  exact=EXACT_MONEY)


IND = ["transaction_id", "high_value_order", "unusual_quantity", "hour", "is_late_night",
       "high_discount", "rapid_purchases"]


@query("fraud_indicators", sql=FRAUD_SQL + "SELECT " + ", ".join(IND) + " FROM fi")
def fraud_indicators(spark, sf_dir):
    return _fraud_features(spark, sf_dir).select(*IND)


@query("wardrobing_flag", sql=FRAUD_SQL + """
SELECT transaction_id, has_return, return_rate, transaction_count, wardrobing_risk FROM fi""",
       rounded=["return_rate"])
def wardrobing_flag(spark, sf_dir):
    return finish(_fraud_features(spark, sf_dir).select(
        "transaction_id", "has_return", "return_rate", "transaction_count", "wardrobing_risk"))


@query("pseudo_labels", sql=FRAUD_SQL + """
, ps AS (
  SELECT transaction_id, CAST(wardrobing_risk * 3 + return_rate * 2 + high_discount
                              + CAST(transaction_count < 3 AS INTEGER) AS DOUBLE) AS risk_score FROM fi
)
SELECT transaction_id, risk_score,
       CAST(risk_score > (SELECT quantile_cont(risk_score, 0.95) FROM ps) AS INTEGER) AS pseudo_label
FROM ps""", rounded=["risk_score"])
def pseudo_labels(spark, sf_dir):
    f = G.model_frame(_fraud_features(spark, sf_dir), "transaction_id", "wardrobing_risk", "return_rate",
                      "high_discount", "transaction_count")
    return finish(G.pseudo_labels(f).select(
        "transaction_id", "risk_score", "pseudo_label"))


FRISK_SQL = """CASE WHEN fraud_risk_score > 0 AND fraud_risk_score <= 0.2 THEN 'Low'
                    WHEN fraud_risk_score > 0.2 AND fraud_risk_score <= 0.5 THEN 'Medium'
                    WHEN fraud_risk_score > 0.5 AND fraud_risk_score <= 0.8 THEN 'High'
                    WHEN fraud_risk_score > 0.8 AND fraud_risk_score <= 1.0 THEN 'Very High' END"""


@query("score_fraud", sql=FRAUD_SQL + f"""
SELECT transaction_id, customer_id, product_id, date, total_amount, fraud_risk_score,
       an AS anomaly_score, fp AS fraud_probability,
       CAST(fraud_risk_score > 0.5 AS INTEGER) AS is_fraud_predicted, {FRISK_SQL} AS fraud_risk_level
FROM fscored""", rounded=["total_amount", "fraud_risk_score", "anomaly_score", "fraud_probability"])
def score_fraud(spark, sf_dir):
    s = G.score_fraud(_fixed_fraud_scores(_fraud_features(spark, sf_dir)))
    return finish(s.select("transaction_id", "customer_id", "product_id", "date", "total_amount",
                           "fraud_risk_score", "anomaly_score", "fraud_probability",
                           "is_fraud_predicted", "fraud_risk_level"))


@query("fraud_patterns", sql=FRAUD_SQL + """
SELECT 'wardrobing' AS pattern, count(*) AS "count",
       coalesce(CAST(avg(return_rate) AS DOUBLE), 0) AS avg_return_rate, CAST(NULL AS DOUBLE) AS avg_discount,
       coalesce(CAST(avg(transaction_count) AS DOUBLE), 0) AS avg_transaction_count
FROM fi WHERE return_rate > 0.5 AND transaction_count < 5
UNION ALL
SELECT 'promotion_abuse', count(*), NULL, coalesce(avg((price - unit_price) / (price + 0.000001)), 0), NULL
FROM fi WHERE high_discount = 1
UNION ALL
SELECT 'rapid_purchases', count(*), NULL, NULL, coalesce(CAST(avg(transaction_count) AS DOUBLE), 0)
FROM fi WHERE rapid_purchases = 1""", rounded=["avg_return_rate", "avg_discount", "avg_transaction_count"])
def fraud_patterns(spark, sf_dir):
    return finish(G.fraud_patterns(_fraud_features(spark, sf_dir)))


_TH_VALUES = ", ".join(f"({t}::DOUBLE)" for t in G.THRESHOLDS)


@query("threshold_cost", sql=FRAUD_SQL + f"""
, tc AS (
  SELECT th.t AS threshold,
         count(CASE WHEN s.fraud_risk_score > th.t AND NOT s.actual THEN 1 END) AS false_positives,
         count(CASE WHEN NOT (s.fraud_risk_score > th.t) AND s.actual THEN 1 END) AS false_negatives
  FROM fscored s, (VALUES {_TH_VALUES}) th(t) GROUP BY th.t
)
SELECT threshold, false_positives, false_negatives,
       false_positives * 10 + false_negatives * 100 AS total_cost,
       CAST(row_number() OVER (ORDER BY false_positives * 10 + false_negatives * 100, threshold) = 1 AS INTEGER) AS is_optimal
FROM tc""")
def threshold_cost(spark, sf_dir):
    s = G.score_fraud(_fixed_fraud_scores(_fraud_features(spark, sf_dir)))
    s = s.withColumn("actual", F.col("anomaly_score") > G.ANOMALY_TRUTH_ABOVE)
    return G.threshold_cost(s)


@query("confusion_matrix", sql=FRAUD_SQL + """
SELECT CAST(is_fraud AS INTEGER) AS actual, CAST(fraud_risk_score > 0.5 AS INTEGER) AS predicted,
       count(*) AS "count" FROM fscored GROUP BY 1, 2""")
def confusion_matrix(spark, sf_dir):
    s = G.score_fraud(_fixed_fraud_scores(_fraud_features(spark, sf_dir)))
    return G.confusion_matrix(s, "is_fraud", "is_fraud_predicted")


@query("fraud_classifier")
def fraud_classifier(spark, sf_dir):
    """Held-out rows scored by the class-balanced forest (labels: is_fraud)."""
    f = G.model_frame(_fraud_features(spark, sf_dir), "transaction_id", "is_fraud", *G.CLASSIFIER_FEATURES)
    _, test = G.train_fraud_classifier(f, "is_fraud")
    return finish(test.select("transaction_id", "is_fraud", "fraud_probability"))


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    """Distributed isolation forest over the ten behaviour features."""
    from shelfwise.operators import isoforest as IF
    f = G.model_frame(_fraud_features(spark, sf_dir), "transaction_id", *G.ANOMALY_FEATURES)
    out = IF.isolation_forest(f, G.ANOMALY_FEATURES, "transaction_id")
    return finish(out.select("transaction_id", "iso_score", "decision", "anomaly_score",
                             "is_anomaly"))


@query("fitted_fraud_scores")
def fitted_fraud_scores(spark, sf_dir):
    """Classifier and isolation forest fitted, stored, loaded again and blended."""
    from shelfwise import modelstore as S
    from shelfwise.operators import isoforest as IF
    from shelfwise.sources.readers import scratch_path
    f = G.model_frame(_fraud_features(spark, sf_dir), "transaction_id", "is_fraud", *G.CLASSIFIER_FEATURES)
    store = scratch_path(spark, "fraud-models")
    classifier, _ = G.train_fraud_classifier(f, "is_fraud")
    S.save(spark, f"{store}/classifier", classifier, G.CLASSIFIER_FEATURES)
    S.save(spark, f"{store}/forest", IF.train_isolation_forest(f, G.ANOMALY_FEATURES, "transaction_id"))
    out = G.score_fitted_fraud(
        S.load(spark, f"{store}/classifier", "pipeline", G.CLASSIFIER_FEATURES, columns=f.columns),
        S.load(spark, f"{store}/forest", "forest", G.ANOMALY_FEATURES, columns=f.columns), f)
    return finish(out.select("transaction_id", "is_fraud", "fraud_probability", "anomaly_score",
                             "fraud_risk_score", "is_fraud_predicted", "fraud_risk_level"))
