"""Run batch operators over arriving data with Structured Streaming.

The reference scores finished frames only; here the same operators are applied
to a stream without new logic:

* order allocation (H5) is a stream–static join (orders ⨝ per-product stock
  arrays) plus in-row array expressions, so it runs as a plain streaming query;
* fraud scoring (G4 + G9) joins arriving transactions to a static customer
  history table and computes flags and the blended score per row.

Progress and state live in a checkpoint folder under the shared
``spark.checkpoint.dir``, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfwise.operators import fraud as G
from shelfwise.operators import fulfilment as H
from shelfwise.sources.readers import scratch_path

ORDER_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.IntegerType()), T.StructField("customer_location", T.StringType()),
    T.StructField("preferred_store", T.StringType()),
])


def _sink(df: DataFrame, path: str, checkpoint: str | None, available_now: bool) -> StreamingQuery:
    spark = df.sparkSession
    ckpt = checkpoint or scratch_path(spark, "stream-ckpt")
    w = (df.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", ckpt).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def allocate_stream(spark: SparkSession, orders_path: str, store_stock: DataFrame,
                    sink_path: str, checkpoint: str | None = None,
                    available_now: bool = True, max_files_per_trigger: int = 100) -> StreamingQuery:
    """Allocate every order file that lands in ``orders_path`` (parquet)."""
    orders = (spark.readStream.schema(ORDER_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger).parquet(orders_path))
    return _sink(H.allocate_orders(orders, store_stock), sink_path, checkpoint, available_now)


def score_fraud_stream(spark: SparkSession, transactions_path: str, schema: T.StructType,
                       returns: DataFrame, products: DataFrame, history: DataFrame,
                       sink_path: str, checkpoint: str | None = None,
                       available_now: bool = True, threshold: float = 0.5,
                       anomaly: str | None = None, probability: str | None = None) -> StreamingQuery:
    """Flag arriving transactions against a stored customer history (G2 + G3).

    ``probability`` / ``anomaly`` name score columns already on the stream (for
    example written by a model-serving step); without them the rule-based
    flags alone are emitted.
    """
    tx = spark.readStream.schema(schema).parquet(transactions_path)
    feats = G.fraud_features(tx, returns, products, history=history)
    if probability and anomaly:
        feats = G.score_fraud(feats, probability, anomaly, threshold)
    cols = ["transaction_id", "customer_id", "product_id", "date", "total_amount",
            "high_value_order", "unusual_quantity", "high_discount", "wardrobing_risk",
            "rapid_purchases"]
    if probability and anomaly:
        cols += ["fraud_risk_score", "is_fraud_predicted", "fraud_risk_level"]
    return _sink(feats.select(*cols), sink_path, checkpoint, available_now)


def run_to_completion(query: StreamingQuery, timeout_sec: int = 600) -> None:
    """Block until an ``availableNow`` query has drained its input; a query
    still running after the time limit is stopped and reported as an error."""
    query.awaitTermination(timeout_sec)
    if query.isActive:
        query.stop()
        raise TimeoutError(f"stopped after {timeout_sec} s with input left")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
