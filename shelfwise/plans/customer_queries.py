"""Queries D1–D12 (customer value and retention)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.stats import _materialise
from shelfwise.operators import customers as C
from shelfwise.plans.catalog import finish, query
from shelfwise.sources.adapter import RetailTables

# Customer metrics as SQL views (appended after the adapter views).
CM_SQL = """
, cm0 AS (
  SELECT customer_id, max(date) AS last_purchase, min(date) AS first_purchase,
         count(*) AS frequency, CAST(sum(CAST(round(total_amount * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS monetary_total,
         (CAST(sum(CAST(round(total_amount * 10000) AS BIGINT)) AS DOUBLE) / 10000) / count(total_amount) AS monetary_avg, CAST(sum(quantity) AS BIGINT) AS quantity_total,
         count(DISTINCT category) AS category_diversity,
         avg(CASE WHEN channel = 'Online' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS online_ratio
  FROM transactions WHERE customer_id IS NOT NULL GROUP BY customer_id
), cm1 AS (
  SELECT *, CAST(date_diff('day', last_purchase, (SELECT max(date) FROM transactions)) AS INTEGER) AS recency,
            CAST(date_diff('day', first_purchase, last_purchase) AS INTEGER) AS tenure
  FROM cm0
), cm AS (
  SELECT cm1.*, CAST(tenure AS DOUBLE) / (frequency + 1) AS avg_days_between, c.segment
  FROM cm1 LEFT JOIN customers c USING (customer_id)
), clv AS (
  SELECT *, monetary_total AS historical_clv,
         CASE WHEN segment = 'High-Value' THEN 24 WHEN segment = 'Medium' THEN 12 ELSE 6 END AS estimated_months_remaining,
         frequency * monetary_avg * (CASE WHEN segment = 'High-Value' THEN 24 WHEN segment = 'Medium' THEN 12 ELSE 6 END)
           / (avg_days_between / 30 + 1) AS predicted_future_value
  FROM cm
), clv2 AS (
  SELECT *, historical_clv + predicted_future_value AS total_clv FROM clv
), scored AS (
  SELECT *, CAST((customer_id * 7919) % 1000 AS DOUBLE) / 1000 AS churn_probability FROM clv2
)
"""

CLV_BAND_SQL = """CASE WHEN total_clv > 0 AND total_clv <= 100 THEN 'Low'
            WHEN total_clv > 100 AND total_clv <= 500 THEN 'Medium'
            WHEN total_clv > 500 AND total_clv <= 2000 THEN 'High'
            WHEN total_clv > 2000 THEN 'Very High' END"""


def _metrics(spark, sf_dir):
    rt = RetailTables.of(spark, sf_dir)
    return C.customer_metrics(rt.transactions, rt.customers)


def _stored_metrics(spark, sf_dir):
    """The metrics written once, for queries that read them many times."""
    return _materialise(_metrics(spark, sf_dir))


def _scored(spark, sf_dir):
    clv = C.clv_components(_metrics(spark, sf_dir))
    return clv.withColumn("churn_probability", RetailTables.fixed_score("customer_id"))


RFM_COLS = ["customer_id", "last_purchase", "first_purchase", "frequency", "monetary_total",
            "monetary_avg", "quantity_total", "recency", "tenure", "avg_days_between"]


# Money columns come from exact fixed-point sums and are compared unrounded.
@query("rfm", sql=CM_SQL + "SELECT " + ", ".join(RFM_COLS) + " FROM cm")
def rfm(spark, sf_dir):
    return _metrics(spark, sf_dir).select(*RFM_COLS)


@query("category_diversity", sql=CM_SQL + "SELECT customer_id, category_diversity FROM cm")
def category_diversity(spark, sf_dir):
    return _metrics(spark, sf_dir).select("customer_id", "category_diversity")


@query("online_ratio", sql=CM_SQL + "SELECT customer_id, online_ratio FROM cm")
def online_ratio(spark, sf_dir):
    return _metrics(spark, sf_dir).select("customer_id", "online_ratio")


METRIC_COLS = RFM_COLS + ["category_diversity", "online_ratio", "segment"]


@query("attach_segment", sql=CM_SQL + "SELECT " + ", ".join(METRIC_COLS) + " FROM cm")
def attach_segment(spark, sf_dir):
    return _metrics(spark, sf_dir).select(*METRIC_COLS)


@query("clv_components",
       sql=CM_SQL + """SELECT customer_id, segment, historical_clv, estimated_months_remaining,
                             predicted_future_value, total_clv FROM clv2""")
def clv_components(spark, sf_dir):
    clv = C.clv_components(_metrics(spark, sf_dir))
    return clv.select("customer_id", "segment", "historical_clv",
                      "estimated_months_remaining", "predicted_future_value", "total_clv")


@query("churn_label",
       sql=CM_SQL + "SELECT customer_id, recency, CAST(recency > 90 AS INTEGER) AS is_churned FROM cm")
def churn_label(spark, sf_dir):
    return C.churn_label(_metrics(spark, sf_dir)).select("customer_id", "recency", "is_churned")


@query("customer_value",
       sql=CM_SQL + f"""SELECT customer_id, segment, historical_clv, predicted_future_value, total_clv,
                             predicted_future_value * (1 - churn_probability) AS risk_adjusted_clv,
                             churn_probability, {CLV_BAND_SQL} AS clv_segment FROM scored""")
def customer_value(spark, sf_dir):
    return C.customer_value(_scored(spark, sf_dir))


@query("at_risk",
       sql=CM_SQL + """SELECT customer_id, segment, total_clv, churn_probability, recency, frequency,
                             monetary_avg FROM scored
                      WHERE churn_probability > 0.5 AND total_clv > 100""")
def at_risk(spark, sf_dir):
    return C.at_risk_customers(_scored(spark, sf_dir))


def _impact_sql(r):
    return (f"historical_clv + predicted_future_value * 1.2 * (1 - churn_probability * (1 - {r}))")


@query("intervention_impact",
       sql=CM_SQL + f"""SELECT customer_id, total_clv AS current_clv,
                             {_impact_sql(0.3)} AS new_clv,
                             {_impact_sql(0.3)} - total_clv AS impact,
                             ({_impact_sql(0.3)} - total_clv) / total_clv * 100 AS impact_pct,
                             churn_probability AS current_churn_prob,
                             churn_probability * (1 - 0.3) AS new_churn_prob,
                             {_impact_sql(0.2)} - total_clv AS impact_low,
                             {_impact_sql(0.4)} - total_clv AS impact_high,
                             'retention_campaign' AS intervention_type FROM scored""")
def intervention_impact(spark, sf_dir):
    return C.intervention_impact(_scored(spark, sf_dir))


@query("kaplan_meier",
       sql=CM_SQL + """, km0 AS (
             SELECT recency AS timeline, count(*) AS removed,
                    sum(CAST(recency > 90 AS INTEGER)) AS observed FROM cm GROUP BY recency
           ), km1 AS (
             SELECT *, sum(removed) OVER (ORDER BY timeline DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk
             FROM km0
           ), km2 AS (
             SELECT *, max(CAST(CAST(observed AS DOUBLE) / at_risk >= 1 AS INTEGER)) OVER w AS z,
                       sum(CASE WHEN CAST(observed AS DOUBLE) / at_risk < 1
                                THEN ln(1 - CAST(observed AS DOUBLE) / at_risk) ELSE 0 END) OVER w AS lg
             FROM km1 WINDOW w AS (ORDER BY timeline ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           )
           SELECT CAST(timeline AS BIGINT) AS timeline, CAST(at_risk AS BIGINT) AS at_risk,
                  CAST(observed AS BIGINT) AS observed, CAST(removed - observed AS BIGINT) AS censored,
                  CASE WHEN z = 1 THEN 0 ELSE exp(lg) END AS survival FROM km2""",
       rounded=["survival"])
def kaplan_meier(spark, sf_dir):
    return finish(C.kaplan_meier(_metrics(spark, sf_dir)))


# -- fitted models: rows-only checks ----------------------------------------------

@query("churn_model")
def churn_model(spark, sf_dir):
    """Held-out customers scored by the churn classifier."""
    _, test = C.train_churn_model(_stored_metrics(spark, sf_dir))
    return finish(test.select("customer_id", "recency", "churn_probability"))


@query("hazard_model")
def hazard_model(spark, sf_dir):
    """Cox proportional hazards of time to churn, every customer scored."""
    _, out = C.hazard_model(_stored_metrics(spark, sf_dir))
    return finish(out)


@query("fitted_customer_value")
def fitted_customer_value(spark, sf_dir):
    """Churn model fitted, stored and loaded again; value, risk and campaign impact of
    every customer by its probabilities."""
    from shelfwise import modelstore as S
    from shelfwise.sources.readers import scratch_path
    m = _stored_metrics(spark, sf_dir)
    model, _ = C.train_churn_model(m)
    store = scratch_path(spark, "churn-model")
    S.save(spark, store, model, [*C.CHURN_FEATURES, "segment"])
    model = S.load(spark, store, "pipeline", [*C.CHURN_FEATURES, "segment"], columns=m.columns)
    scored = C.score_churn(model, C.clv_components(m))
    risk = C.at_risk_customers(scored).select("customer_id", F.lit(1).alias("at_risk"))
    impact = C.intervention_impact(scored).select("customer_id", "new_clv", "impact", "impact_pct")
    out = C.customer_value(scored).join(impact, "customer_id").join(risk, "customer_id", "left")
    return finish(out.fillna(0, ["at_risk"]))
