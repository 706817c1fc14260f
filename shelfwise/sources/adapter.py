"""Star schema → retail tables.

The test inputs are TPC-H style tables (lineitem, orders, part, customer,
nation).  This adapter shapes them into the five retail tables the analytics
expect (transactions, products, customers, returns, inventory) plus the
fulfilment order batch, external signals and an invoice-style raw table.

Everything is a lazy projection / join / aggregate of the parquet scans, so
filters and column pruning reach the files.  The one fact join
(lineitem ⨝ orders) is a shuffle join on the order key; part is joined by
part key and left to AQE to broadcast when its runtime size is small.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the adapter (they define the fixtures; both the Spark
# tables and the SQL oracle use them):
N_STORES = 50
ONLINE_SHARE_MOD = 10       # l_orderkey % 10 < 4 → Online (40 %)
ONLINE_BELOW = 4
DISCOUNT_SCALE = 5          # l_discount 0..0.10 → discounts 0..50 %
FRAUD_MOD = 50              # is_fraud = (product_id*31 + customer_id*17) % 50 = 0
STOCKOUT_MOD = 20           # product_id % 20 = 0 → stock 0, stock-out
CANCEL_MOD = 50             # invoice number gets prefix 'C' when l_orderkey % 50 = 0
NEGATIVE_QTY_MOD = 97       # negative invoice quantity when l_partkey % 97 = 0
SEGMENT_HIGH = ("BUILDING",)
SEGMENT_MEDIUM = ("MACHINERY", "FURNITURE")


def store_label(key: Column) -> Column:
    return F.concat(F.lit("Store_"), F.lpad((key % N_STORES + 1).cast("string"), 3, "0"))


@dataclass
class StarSchema:
    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:          # one file listing / footer read per table
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]


_OPEN: dict[tuple[int, str], "RetailTables"] = {}


class RetailTables:
    """Lazy retail views over one star-schema folder.

    ``RetailTables.of(spark, dir)`` returns one shared instance per session and
    folder, so every query of a session reuses the same (lazy) DataFrames
    instead of re-opening the files and rebuilding the adapter plan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.star = StarSchema(spark, sf_dir)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "RetailTables":
        key = (id(spark), sf_dir)
        inst = _OPEN.get(key)
        if inst is None or inst.spark is not spark:
            inst = _OPEN[key] = cls(spark, sf_dir)
        return inst

    # -- transactions -------------------------------------------------------
    @cached_property
    def _tx_wide(self) -> DataFrame:
        li = self.star.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_discount", "l_tax", "l_returnflag")
        od = self.star.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        pt = self.star.table("part").select("p_partkey", "p_type", "p_retailprice")
        j = (li.join(od, li.l_orderkey == od.o_orderkey)
               .join(pt, li.l_partkey == pt.p_partkey))
        eff = F.col("p_retailprice") * (1 - F.col("l_discount") * DISCOUNT_SCALE)
        return j.select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in
                               ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
                        ).alias("transaction_id"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("product_id"),
            store_label(F.col("l_suppkey")).alias("store_id"),
            F.when(F.col("l_orderkey") % ONLINE_SHARE_MOD < ONLINE_BELOW, "Online")
             .otherwise("In-Store").alias("channel"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.round(eff, 4).alias("unit_price"),
            F.round(eff * F.col("l_quantity"), 4).alias("total_amount"),
            F.col("p_type").alias("category"),
            F.round(F.col("p_retailprice") - F.round(eff, 4), 4).alias("discount_applied"),
            F.col("p_retailprice").alias("price"),
            F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"),
            F.col("l_tax"), F.col("l_returnflag"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        """transaction_id, date, customer_id, product_id, store_id, channel,
        quantity, unit_price, total_amount, category, discount_applied."""
        return self._tx_wide.select(
            "transaction_id", "date", "customer_id", "product_id", "store_id", "channel",
            "quantity", "unit_price", "total_amount", "category", "discount_applied")

    # -- dimensions ---------------------------------------------------------
    @cached_property
    def products(self) -> DataFrame:
        return self.star.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("price"))

    @cached_property
    def customers(self) -> DataFrame:
        seg = (F.when(F.col("c_mktsegment").isin(*SEGMENT_HIGH), "High-Value")
                .when(F.col("c_mktsegment").isin(*SEGMENT_MEDIUM), "Medium")
                .otherwise("Low"))
        return self.star.table("customer").select(
            F.col("c_custkey").alias("customer_id"), seg.alias("segment"))

    # -- returns ------------------------------------------------------------
    @cached_property
    def returns(self) -> DataFrame:
        t = self._tx_wide.filter(F.col("l_returnflag") == "R")
        k = F.col("l_orderkey") % 10
        reason = (F.when(k <= 3, "Size/Fit").when(k <= 6, "Changed Mind")
                   .when(k == 7, "Defective").when(k == 8, "Not as Described")
                   .otherwise("Other"))
        return t.select(
            F.concat(F.lit("RET-"), F.col("transaction_id")).alias("return_id"),
            "transaction_id",
            F.date_add("date", (3 + F.col("product_id") % 28).cast("int")).alias("return_date"),
            reason.alias("return_reason"),
            ((F.col("product_id") * 31 + F.col("customer_id") * 17) % FRAUD_MOD == 0)
            .alias("is_fraud"),
            "customer_id", "product_id",
            F.col("total_amount").alias("amount_returned"))

    # -- inventory ----------------------------------------------------------
    @cached_property
    def inventory(self) -> DataFrame:
        """Monthly snapshot per (store, product): units sold that month."""
        out = F.col("product_id") % STOCKOUT_MOD == 0
        g = (self._tx_wide
             .groupBy(F.trunc("date", "month").alias("date"), "store_id", "product_id")
             .agg(F.sum("quantity").alias("_q")))
        return g.select(
            "date", "store_id", "product_id",
            F.when(out, F.lit(0).cast("bigint")).otherwise(F.col("_q")).alias("stock_level"),
            out.alias("is_stockout"))

    # -- fulfilment batch ---------------------------------------------------
    @cached_property
    def fulfilment_orders(self) -> DataFrame:
        tx = self._tx_wide
        cust = self.star.table("customer").select("c_custkey", "c_nationkey")
        nat = self.star.table("nation").select("n_nationkey", "n_regionkey")
        loc = (F.when(F.col("n_regionkey") == 0, "Local")
                .when(F.col("n_regionkey").isin(1, 2), "Regional")
                .otherwise("National"))
        return (tx
                .join(cust, tx.customer_id == cust.c_custkey, "left")
                .join(nat, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                .select(F.col("transaction_id").alias("order_id"), "product_id", "quantity",
                        loc.alias("customer_location"),
                        store_label(F.col("customer_id")).alias("preferred_store"),
                        "customer_id", "date", "category"))

    # -- merchandising side inputs -------------------------------------------
    @cached_property
    def external_signals(self) -> DataFrame:
        return (self._tx_wide.groupBy(F.trunc("date", "month").alias("year_month"))
                .agg(F.avg("l_tax").alias("signal")))

    @cached_property
    def invoices(self) -> DataFrame:
        """Raw invoice-style rows (upper/mixed-case names, cancellations,
        negative quantities) for the invoice normaliser."""
        t = self._tx_wide
        inv_no = F.when(F.col("l_orderkey") % CANCEL_MOD == 0,
                        F.concat(F.lit("C"), F.col("l_orderkey").cast("string"))
                        ).otherwise(F.col("l_orderkey").cast("string"))
        qty = F.when(F.col("product_id") % NEGATIVE_QTY_MOD == 0, -F.col("quantity")
                     ).otherwise(F.col("quantity"))
        return t.select(
            inv_no.alias("InvoiceNo"),
            F.col("product_id").cast("string").alias("StockCode"),
            F.col("category").alias("Description"),
            qty.alias("Quantity"),
            F.date_format(F.col("date"), "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"),
            F.col("unit_price").alias("UnitPrice"),
            F.col("customer_id").alias("CustomerID"),
            F.lit("United Kingdom").alias("Country"))

    # -- deterministic companions -------------------------------------------
    @staticmethod
    def fixed_score(id_col: str | Column) -> Column:
        """Deterministic stand-in probability ((id*7919) % 1000)/1000 for
        checking banding / ranking of fitted models with SQL."""
        c = F.col(id_col) if isinstance(id_col, str) else id_col
        return ((c * 7919) % 1000).cast("double") / 1000.0
