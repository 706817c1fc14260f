"""The star-schema adapter written once more, independently, as DuckDB SQL.

Every oracle query is ``WITH <adapter views> <query>``; DuckDB inlines the
views it needs and drops the rest.  The views mirror
``shelfwise.sources.adapter.RetailTables`` column for column.
"""

from __future__ import annotations

ADAPTER_CTES = """
tx_wide AS (
  SELECT
    concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR),
                   CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR)) AS transaction_id,
    CAST(o.o_orderdate AS DATE) AS date,
    o.o_custkey AS customer_id,
    l.l_partkey AS product_id,
    'Store_' || lpad(CAST(l.l_suppkey % 50 + 1 AS VARCHAR), 3, '0') AS store_id,
    CASE WHEN l.l_orderkey % 10 < 4 THEN 'Online' ELSE 'In-Store' END AS channel,
    CAST(l.l_quantity AS INTEGER) AS quantity,
    round(p.p_retailprice * (1 - l.l_discount * 5), 4) AS unit_price,
    round(p.p_retailprice * (1 - l.l_discount * 5) * l.l_quantity, 4) AS total_amount,
    p.p_type AS category,
    round(p.p_retailprice - round(p.p_retailprice * (1 - l.l_discount * 5), 4), 4) AS discount_applied,
    p.p_retailprice AS price,
    l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_tax, l.l_returnflag
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
transactions AS (
  SELECT transaction_id, date, customer_id, product_id, store_id, channel, quantity,
         unit_price, total_amount, category, discount_applied
  FROM tx_wide
),
products AS (
  SELECT p_partkey AS product_id, p_type AS category, p_retailprice AS price FROM part
),
customers AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_mktsegment IN ('BUILDING') THEN 'High-Value'
              WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'Medium'
              ELSE 'Low' END AS segment
  FROM customer
),
returns AS (
  SELECT 'RET-' || transaction_id AS return_id, transaction_id,
         date + CAST(3 + product_id % 28 AS INTEGER) AS return_date,
         CASE WHEN l_orderkey % 10 <= 3 THEN 'Size/Fit'
              WHEN l_orderkey % 10 <= 6 THEN 'Changed Mind'
              WHEN l_orderkey % 10 = 7 THEN 'Defective'
              WHEN l_orderkey % 10 = 8 THEN 'Not as Described'
              ELSE 'Other' END AS return_reason,
         (product_id * 31 + customer_id * 17) % 50 = 0 AS is_fraud,
         customer_id, product_id, total_amount AS amount_returned
  FROM tx_wide
  WHERE l_returnflag = 'R'
),
inventory AS (
  SELECT date, store_id, product_id,
         CASE WHEN product_id % 20 = 0 THEN CAST(0 AS BIGINT) ELSE q END AS stock_level,
         product_id % 20 = 0 AS is_stockout
  FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS date, store_id, product_id,
               CAST(sum(quantity) AS BIGINT) AS q
        FROM tx_wide GROUP BY 1, 2, 3)
),
fulfilment_orders AS (
  SELECT t.transaction_id AS order_id, t.product_id, t.quantity,
         CASE WHEN n.n_regionkey = 0 THEN 'Local'
              WHEN n.n_regionkey IN (1, 2) THEN 'Regional'
              ELSE 'National' END AS customer_location,
         'Store_' || lpad(CAST(t.customer_id % 50 + 1 AS VARCHAR), 3, '0') AS preferred_store,
         t.customer_id, t.date, t.category
  FROM tx_wide t
  LEFT JOIN customer c ON t.customer_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
external_signals AS (
  SELECT CAST(date_trunc('month', date) AS DATE) AS year_month, avg(l_tax) AS signal
  FROM tx_wide GROUP BY 1
),
invoices AS (
  SELECT CASE WHEN l_orderkey % 50 = 0 THEN 'C' || CAST(l_orderkey AS VARCHAR)
              ELSE CAST(l_orderkey AS VARCHAR) END AS "InvoiceNo",
         CAST(product_id AS VARCHAR) AS "StockCode",
         category AS "Description",
         CASE WHEN product_id % 97 = 0 THEN -quantity ELSE quantity END AS "Quantity",
         strftime(date, '%Y-%m-%d %H:%M:%S') AS "InvoiceDate",
         unit_price AS "UnitPrice",
         customer_id AS "CustomerID",
         'United Kingdom' AS "Country"
  FROM tx_wide
)
"""

