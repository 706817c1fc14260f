"""Queries A1–A8 (sources, sinks, preparation, profiles)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from shelfwise.operators import profile as P
from shelfwise.plans.catalog import finish, query
from shelfwise.sources import readers as R
from shelfwise.sources.adapter import RetailTables

TABLES = ["products", "customers", "transactions", "returns", "inventory"]


def _tables(spark, sf_dir):
    rt = RetailTables.of(spark, sf_dir)
    return {n: getattr(rt, n) for n in TABLES}


def _columns(n):
    return R.SCHEMAS[n].fieldNames()


@query("read_tables", sql="SELECT " + ", ".join(_columns("transactions")) + " FROM transactions",
       rounded=["unit_price", "total_amount", "discount_applied"])
def read_tables(spark, sf_dir):
    """Round trip: write the transactions as month-partitioned CSV to the shared
    scratch folder, read them back through the quarantine."""
    path, cols = R.scratch_path(spark, "tables-csv"), _columns("transactions")
    R.write_tables({"transactions": RetailTables.of(spark, sf_dir).transactions.select(*cols)}, path, fmt="csv")
    back, _ = R.read_tables_checked(spark, path, fmt="csv", names=("transactions",))
    return finish(back["transactions"].select(*cols))


@query("write_tables", sql="""
SELECT 'customers' AS table_name, count(*) AS n_rows FROM customers UNION ALL
SELECT 'inventory', count(*) FROM inventory UNION ALL
SELECT 'products', count(*) FROM products UNION ALL
SELECT 'returns', count(*) FROM returns UNION ALL
SELECT 'transactions', count(*) FROM transactions""")
def write_tables(spark, sf_dir):
    rt = RetailTables.of(spark, sf_dir)
    tables = {"products": rt.products, "customers": rt.customers, "transactions": rt.transactions,
              "returns": rt.returns, "inventory": rt.inventory}
    path = R.scratch_path(spark, "tables-parquet")
    R.write_tables(tables, path, fmt="parquet")
    back = R.read_tables(spark, path, fmt="parquet")
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n, df in back.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


NORM_COLS = ["invoiceno", "product_id", "product_name", "quantity", "date", "unit_price",
             "customer_id", "country", "total_amount", "category", "store_id", "channel"]

NORM_SQL = """
, inv_norm AS (
  SELECT "InvoiceNo" AS invoiceno, "StockCode" AS product_id, "Description" AS product_name,
         "Quantity" AS quantity, try_strptime("InvoiceDate", '%Y-%m-%d %H:%M:%S') AS date,
         "UnitPrice" AS unit_price, "CustomerID" AS customer_id, "Country" AS country,
         "Quantity" * "UnitPrice" AS total_amount, 'General' AS category,
         'Online' AS store_id, 'Online' AS channel
  FROM invoices
  WHERE NOT coalesce(starts_with("InvoiceNo", 'C'), false) AND "Quantity" > 0
)
"""


def _normalized(spark, sf_dir):
    return R.normalize_invoices(RetailTables.of(spark, sf_dir).invoices)


@query("normalize_invoices", sql=NORM_SQL + "SELECT " + ", ".join(NORM_COLS) + " FROM inv_norm",
       rounded=["unit_price", "total_amount"])
def normalize_invoices(spark, sf_dir):
    return finish(_normalized(spark, sf_dir).select(*NORM_COLS))


@query("product_dim", sql=NORM_SQL + """
SELECT CAST(product_id AS VARCHAR) AS product_id,
       arg_min(product_name, (date, invoiceno)) AS product_name,
       (CAST(sum(CAST(round(unit_price * 10000) AS BIGINT)) AS DOUBLE) / 10000) / count(unit_price) AS unit_price,
       arg_min(category, (date, invoiceno)) AS category
FROM inv_norm GROUP BY 1""")
def product_dim(spark, sf_dir):
    return R.product_dim(_normalized(spark, sf_dir))


@query("customer_dim", sql=NORM_SQL + """
SELECT customer_id, min(date) AS first_purchase_date, max(date) AS last_purchase_date,
       CAST(sum(CAST(round(total_amount * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS total_spent
FROM inv_norm WHERE customer_id IS NOT NULL GROUP BY 1""")
def customer_dim(spark, sf_dir):
    return R.customer_dim(_normalized(spark, sf_dir))


@query("dataset_summary", sql="""
SELECT (SELECT count(*) FROM products) AS n_products,
       (SELECT count(*) FROM customers) AS n_customers,
       count(*) AS n_transactions,
       (SELECT count(*) FROM returns) AS n_returns,
       count(DISTINCT customer_id) AS active_customers,
       count(DISTINCT product_id) AS active_products,
       CAST(sum(CAST(round(total_amount * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS total_revenue,
       (CAST(sum(CAST(round(total_amount * 10000) AS BIGINT)) AS DOUBLE) / 10000) / count(total_amount) AS avg_order_value,
       (SELECT count(*) FROM returns) / count(*) * 100 AS return_rate_pct,
       min(date) AS first_date, max(date) AS last_date
FROM transactions""")
def dataset_summary(spark, sf_dir):
    rt = RetailTables.of(spark, sf_dir)
    return P.dataset_summary(rt.transactions, rt.products, rt.customers, rt.returns)


@query("latest_stock", sql="""
SELECT product_id, arg_max(stock_level, (date, store_id)) AS stock_level, max(date) AS snapshot_date
FROM inventory GROUP BY product_id""")
def latest_stock(spark, sf_dir):
    return P.latest_stock(RetailTables.of(spark, sf_dir).inventory)


def _numeric(n):
    return [f.name for f in R.SCHEMAS[n].fields if isinstance(f.dataType, P._NUMERIC)]


def _profile_sql():
    parts = []
    for n in TABLES:
        for c in _numeric(n):
            x = f"CAST({c} AS DOUBLE)"
            parts.append(f"""SELECT '{n}' AS table_name, '{c}' AS "column", count(*) AS n_rows, count({x}) AS "count",
               avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS "min", max({x}) AS "max",
               quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75
        FROM {n}""")
    return "\nUNION ALL\n".join(parts)


@query("preview_profile", sql=_profile_sql(),
       rounded=["mean", "std", '"min"', '"max"', "p25", "p50", "p75"])
def preview_profile(spark, sf_dir):
    """Every numeric column of the five tables, with exact quartiles."""
    return finish(P.profile_tables({n: df.select(*_numeric(n)) for n, df in _tables(spark, sf_dir).items()}))
