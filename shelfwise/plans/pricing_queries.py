"""Queries C1–C8 (markdown and pricing)."""

from __future__ import annotations

from shelfwise.operators import pricing as PR
from shelfwise.operators import profile as P
from shelfwise.plans.catalog import finish, query
from shelfwise.sources.adapter import RetailTables

PRICING_SQL = """
, disc AS (
  SELECT t.*, p.price AS original_price,
         round((p.price - t.unit_price) / p.price, 6) AS discount_pct
  FROM transactions t LEFT JOIN (SELECT product_id, price FROM products) p USING (product_id)
), disc2 AS (
  SELECT *, CASE WHEN discount_pct > -0.01 AND discount_pct <= 0.01 THEN 'No Discount'
                 WHEN discount_pct > 0.01 AND discount_pct <= 0.15 THEN 'Small (0-15%)'
                 WHEN discount_pct > 0.15 AND discount_pct <= 0.30 THEN 'Medium (15-30%)'
                 WHEN discount_pct > 0.30 AND discount_pct <= 0.50 THEN 'Large (30-50%)'
                 WHEN discount_pct > 0.50 AND discount_pct <= 1.0 THEN 'Very Large (50%+)' END AS discount_bucket
  FROM disc
), bstats AS (
  SELECT product_id, discount_bucket, avg(unit_price) AS avg_price, avg(quantity) AS avg_quantity,
         CAST(sum(quantity) AS BIGINT) AS total_quantity, count(*) AS n_transactions
  FROM disc2 WHERE discount_bucket IS NOT NULL GROUP BY 1, 2
), bnext AS (
  SELECT *, lead(avg_price) OVER w AS p1, lead(total_quantity) OVER w AS q1
  FROM bstats WINDOW w AS (PARTITION BY product_id ORDER BY avg_price, discount_bucket)
), elas AS (
  SELECT product_id,
         sum(CASE WHEN p1 IS NOT NULL THEN CAST(total_quantity AS DOUBLE) *
               (((q1 - CAST(total_quantity AS DOUBLE)) / (CAST(total_quantity AS DOUBLE) + 1))
                / ((p1 - avg_price) / avg_price + 0.000001)) END)
         / sum(CASE WHEN p1 IS NOT NULL THEN CAST(total_quantity AS DOUBLE) END) AS price_elasticity,
         avg(avg_price) AS avg_price
  FROM bnext GROUP BY product_id
  HAVING count(*) >= 2 AND sum(CASE WHEN p1 IS NOT NULL THEN total_quantity END) > 0
), upl0 AS (
  SELECT t.product_id, t.quantity, t.unit_price < p.price * 0.95 AS md,
         (p.price - t.unit_price) / p.price AS pct
  FROM transactions t LEFT JOIN products p USING (product_id)
), upl AS (
  SELECT product_id,
         avg(CASE WHEN md THEN quantity END) - avg(CASE WHEN NOT md THEN quantity END) AS uplift,
         (avg(CASE WHEN md THEN quantity END) - avg(CASE WHEN NOT md THEN quantity END))
           / (avg(CASE WHEN NOT md THEN quantity END) + 1) * 100 AS uplift_pct,
         avg(CASE WHEN md THEN pct END) AS avg_discount,
         avg(CASE WHEN NOT md THEN quantity END) AS normal_sales,
         avg(CASE WHEN md THEN quantity END) AS markdown_sales
  FROM upl0 GROUP BY product_id
  HAVING count(CASE WHEN md THEN 1 END) > 0 AND count(CASE WHEN NOT md THEN 1 END) > 0
), stock AS (
  SELECT product_id, arg_max(stock_level, (date, store_id)) AS stock_level FROM inventory GROUP BY 1
)
"""


def _mk_sql(days: int) -> str:
    high = "TRUE" if days < 30 else "FALSE"
    return f"""
, mk0 AS (
  SELECT p.product_id, p.category, p.price, e.price_elasticity, u.uplift_pct,
         coalesce(CAST(s.stock_level AS DOUBLE), 0) AS stock_level
  FROM products p LEFT JOIN elas e USING (product_id) LEFT JOIN upl u USING (product_id)
       LEFT JOIN stock s USING (product_id)
), mk1 AS (
  SELECT mk0.*, o.m,
         10 * (1 + CASE WHEN price_elasticity < 0 THEN price_elasticity * ((price * (1 - o.m) - price) / price)
                        ELSE (CASE WHEN o.m > 0 THEN uplift_pct / 100 ELSE 0 END) END) AS ed
  FROM mk0, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE)) o(m)
), mk2 AS (
  SELECT *, CASE WHEN ed IS NOT NULL THEN price * (1 - m) * least(ed, stock_level)
            - greatest(0, stock_level - ed) * price * 0.001 * {days} END AS net
  FROM mk1
), best AS (
  SELECT product_id, m, net FROM (
    SELECT product_id, m, net, row_number() OVER (PARTITION BY product_id ORDER BY net DESC, m) AS rn
    FROM mk2 WHERE net > 0) WHERE rn = 1
)
SELECT mk0.product_id, mk0.category, mk0.price AS current_price,
       coalesce(b.m, 0) AS recommended_markdown,
       mk0.price * (1 - coalesce(b.m, 0)) AS recommended_price,
       coalesce(b.net, 0) AS expected_revenue, mk0.stock_level,
       CASE WHEN mk0.stock_level > 50 AND {high} THEN 'High'
            WHEN mk0.stock_level > 20 THEN 'Medium' ELSE 'Low' END AS urgency,
       mk0.price_elasticity, mk0.uplift_pct
FROM mk0 LEFT JOIN best b USING (product_id)
"""


MK_ROUND = ["current_price", "recommended_markdown", "recommended_price", "expected_revenue",
            "stock_level", "price_elasticity", "uplift_pct"]


def _tables(spark, sf_dir):
    return RetailTables.of(spark, sf_dir)


def _stats(rt):
    return PR.bucket_stats(PR.with_discount(rt.transactions, rt.products))


@query("discount_bucket", sql=PRICING_SQL + """
SELECT transaction_id, product_id, unit_price, original_price, discount_pct, discount_bucket FROM disc2""",
       rounded=["unit_price", "original_price", "discount_pct"])
def discount_bucket(spark, sf_dir):
    rt = _tables(spark, sf_dir)
    return finish(PR.with_discount(rt.transactions, rt.products).select(
        "transaction_id", "product_id", "unit_price", "original_price", "discount_pct",
        "discount_bucket"))


@query("bucket_stats", sql=PRICING_SQL + "SELECT * FROM bstats", rounded=["avg_price", "avg_quantity"])
def bucket_stats(spark, sf_dir):
    return finish(_stats(_tables(spark, sf_dir)))


@query("price_elasticity", sql=PRICING_SQL + "SELECT * FROM elas",
       rounded=["price_elasticity", "avg_price"])
def price_elasticity(spark, sf_dir):
    return finish(PR.price_elasticity(_stats(_tables(spark, sf_dir))))


@query("markdown_uplift", sql=PRICING_SQL + "SELECT * FROM upl",
       rounded=["uplift", "uplift_pct", "avg_discount", "normal_sales", "markdown_sales"])
def markdown_uplift(spark, sf_dir):
    rt = _tables(spark, sf_dir)
    return finish(PR.markdown_uplift(rt.transactions, rt.products))


def _optimal(spark, sf_dir, days):
    rt = _tables(spark, sf_dir)
    el = PR.price_elasticity(_stats(rt))
    up = PR.markdown_uplift(rt.transactions, rt.products)
    stock = P.latest_stock(rt.inventory)
    return finish(PR.optimal_markdown(rt.products, el, up, stock, days_until_end_of_season=days))


@query("optimal_markdown", sql=PRICING_SQL + _mk_sql(30), rounded=MK_ROUND)
def optimal_markdown(spark, sf_dir):
    return _optimal(spark, sf_dir, 30)


@query("markdown_urgency", sql=PRICING_SQL + _mk_sql(14), rounded=MK_ROUND)
def markdown_urgency(spark, sf_dir):
    """Two weeks before season end: all three urgency levels occur."""
    return _optimal(spark, sf_dir, 14)


@query("counterfactual", sql=PRICING_SQL + """
, cf0 AS (
  SELECT p.product_id, p.price, a.avg_q, coalesce(e.price_elasticity, -1.5) AS e, s.markdown_pct
  FROM products p
  LEFT JOIN (SELECT product_id, avg(quantity) AS avg_q FROM transactions GROUP BY 1) a USING (product_id)
  LEFT JOIN elas e USING (product_id),
  (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE)) s(markdown_pct)
), cf1 AS (
  SELECT *, price * (1 - markdown_pct) AS new_price,
         avg_q * (1 + CASE WHEN e < 0 THEN e * ((price * (1 - markdown_pct) - price) / price) ELSE 0 END) AS expected_quantity
  FROM cf0
)
SELECT product_id, markdown_pct, new_price, expected_quantity,
       new_price * expected_quantity AS expected_revenue,
       new_price * expected_quantity - price * avg_q AS revenue_change,
       (new_price * expected_quantity - price * avg_q) / (price * avg_q + 1) * 100 AS revenue_change_pct
FROM cf1""", rounded=["markdown_pct", "new_price", "expected_quantity", "expected_revenue",
                      "revenue_change", "revenue_change_pct"])
def counterfactual(spark, sf_dir):
    rt = _tables(spark, sf_dir)
    el = PR.price_elasticity(_stats(rt))
    return finish(PR.counterfactual(rt.transactions, rt.products, el))


@query("demand_price_model")
def demand_price_model(spark, sf_dir):
    """Held-out predictions of the boosted demand–price model (rows only)."""
    rt = _tables(spark, sf_dir)
    _, test = PR.train_demand_price(PR.demand_price_frame(rt.transactions, rt.products))
    return finish(test.select("transaction_id", "product_id", "quantity", "prediction"))
