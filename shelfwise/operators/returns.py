"""Returns prediction and analysis.

Return flags are an existence join against the *distinct* returned ids
(dedupe first, so a transaction with two return rows is not doubled).
Customer / product histories are grouped aggregates joined back on their key.
For the model, "history" means strictly earlier days: rows are first summed
per (customer, day) — a series bounded by the calendar — and the running
window runs over those daily rows, never over raw transactions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.functions.exprs import band, money_avg, money_sum, weekday0
from shelfwise.functions.stats import _materialise, exact_quantiles
from shelfwise.operators.trees import BoostedClassifier

# Fixed values of the returns model:
RISK_EDGES = [0.0, 0.1, 0.3, 0.5, 1.0]
RISK_LABELS = ["Low", "Medium", "High", "Very High"]
DISCOUNTED_ABOVE = 0.05
PRICE_EPS = 1e-6
NOT_RETURNED = "Not Returned"
MODEL_FEATURES = ["quantity", "unit_price", "discount_pct", "is_discounted",
                  "total_transactions", "total_spend", "avg_order_value",
                  "historical_return_rate", "product_return_rate", "month", "day_of_week",
                  "is_weekend", "is_holiday_season", "is_online", "category_encoded"]
FACTOR_COLUMNS = ["quantity", "unit_price", "discount_pct", "total_transactions",
                  "historical_return_rate"]


def return_flag(transactions: DataFrame, returns: DataFrame) -> DataFrame:
    """is_returned = the transaction id occurs in the returns table."""
    ids = returns.select("transaction_id").distinct().withColumn("_r", F.lit(1))
    return (transactions.join(ids, "transaction_id", "left")
            .withColumn("is_returned", F.coalesce(F.col("_r"), F.lit(0))).drop("_r"))


def return_details(flagged: DataFrame, returns: DataFrame) -> DataFrame:
    """one reason / fraud flag per transaction (deterministic dedupe),
    defaults 'Not Returned' / 0."""
    one = returns.groupBy("transaction_id").agg(
        F.min("return_reason").alias("return_reason"),
        F.max(F.col("is_fraud").cast("int")).alias("is_fraud"))
    return (flagged.join(one, "transaction_id", "left")
            .withColumn("return_reason", F.coalesce(F.col("return_reason"), F.lit(NOT_RETURNED)))
            .withColumn("is_fraud", F.coalesce(F.col("is_fraud"), F.lit(0))))


def customer_return_history(flagged: DataFrame) -> DataFrame:
    """per customer count, spend, mean order, returns, rate = returns/(n+1)."""
    g = flagged.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        money_sum("total_amount").alias("total_spend"),
        money_avg("total_amount").alias("avg_order_value"),
        F.sum("is_returned").alias("historical_returns"))
    return g.withColumn("historical_return_rate",
                        F.col("historical_returns") / (F.col("total_transactions") + 1))


def product_return_history(flagged: DataFrame) -> DataFrame:
    """per product return rate and mean units."""
    return flagged.groupBy("product_id").agg(
        F.avg("is_returned").alias("product_return_rate"),
        F.avg("quantity").alias("avg_quantity"))


def prior_day_history(flagged: DataFrame, key: str, prefix: str) -> DataFrame:
    """As-of history of ``key`` from strictly earlier days: n, spend, returns."""
    day = flagged.groupBy(key, "date").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("total_amount").alias("_amt"),
        F.sum("is_returned").alias("_ret"))
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return day.select(
        key, "date",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"{prefix}_n"),
        F.coalesce(F.sum("_amt").over(w), F.lit(0.0)).alias(f"{prefix}_amt"),
        F.coalesce(F.sum("_ret").over(w), F.lit(0)).alias(f"{prefix}_ret"))


def txn_return_features(df: DataFrame) -> DataFrame:
    """discount share, discounted flag, calendar flags, online flag."""
    pct = (F.col("price") - F.col("unit_price")) / (F.col("price") + PRICE_EPS)
    return df.withColumns({
        "discount_pct": pct,
        "is_discounted": (pct > DISCOUNTED_ABOVE).cast("int"),
        "month": F.month("date"),
        "day_of_week": weekday0("date"),
        "is_weekend": (weekday0("date") >= 5).cast("int"),
        "is_holiday_season": F.month("date").isin(11, 12).cast("int"),
        "is_online": (F.col("channel") == "Online").cast("int"),
    })


def return_features(transactions: DataFrame, returns: DataFrame, products: DataFrame,
                    as_of: bool = False) -> DataFrame:
    """F1–F5 joined: one row per transaction.

    ``as_of=False`` gives the reported (whole-history) customer and product
    rates; ``as_of=True`` uses strictly earlier days only (model training).
    The product's category comes from the product table.
    """
    p = products.select("product_id", F.col("category").alias("_pcat"), "price")
    tx = transactions.drop("category").join(p, "product_id", "left").withColumnRenamed("_pcat", "category")
    f = return_details(return_flag(tx, returns), returns)
    if as_of:
        c = prior_day_history(f, "customer_id", "_c")
        pr = prior_day_history(f, "product_id", "_p")
        f = (f.join(c, ["customer_id", "date"], "left").join(pr, ["product_id", "date"], "left")
              .withColumns({
                  "total_transactions": F.col("_c_n"),
                  "total_spend": F.col("_c_amt"),
                  "avg_order_value": F.coalesce(F.try_divide("_c_amt", "_c_n"), F.lit(0.0)),
                  "historical_return_rate": F.col("_c_ret") / (F.col("_c_n") + 1),
                  "product_return_rate": F.coalesce(F.try_divide("_p_ret", "_p_n"), F.lit(0.0)),
              }).drop("_c_n", "_c_amt", "_c_ret", "_p_n", "_p_amt", "_p_ret"))
    else:
        f = (f.join(customer_return_history(f), "customer_id", "left")
              .join(product_return_history(f).select("product_id", "product_return_rate"),
                    "product_id", "left"))
    return txn_return_features(f)


def encode_category(df: DataFrame, col: str = "category") -> tuple[DataFrame, object]:
    """alphabetical label encoding (null → 'Unknown', unseen → extra index)."""
    d = df.withColumn(col, F.coalesce(F.col(col), F.lit("Unknown")))
    model = StringIndexer(inputCol=col, outputCol=f"{col}_encoded", stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(d)
    return model.transform(d), model


def split_draw(id_col: str, seed: int = 42) -> Column:
    """A draw in [0, 1) per id: the first 52 bits of the MD5 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def stratified_split(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """deterministic stratified split.

    Each row draws by its id; within every label value the rows whose draw lies
    at or below that label's exact (1 − test) quantile go to training.  Quantiles come
    from the distributed two-level histogram, so no label group is ever gathered into one
    task, and the cut-offs (one per label value) are one scalar map read in each row,
    so nothing is joined on the label.  They are computed once, however often the split
    rows are read.
    """
    key = F.coalesce(F.col(label).cast("string"), F.lit(""))
    d = df.withColumn("_h", split_draw(id_col, seed))
    cuts = _materialise(exact_quantiles(d.select(key.alias("_label"), "_h"), "_h", [1 - test_fraction], by=["_label"])).agg(
        F.map_from_entries(F.collect_list(F.struct("_label", "value")))).scalar()
    return (d.withColumn("split", F.when(F.col("_h") <= F.element_at(cuts, key), "train").otherwise("test"))
             .drop("_h"))


@dataclass
class BoostParams:
    max_iter: int = 100
    max_depth: int = 5
    step_size: float = 0.1
    seed: int = 42


def model_frame(features: DataFrame) -> DataFrame:
    """The columns that training and scoring read, written once: every pass of a fit
    would otherwise repeat the joins and running sums behind the features."""
    return _materialise(features.select("transaction_id", "customer_id", "product_id", "date", "is_returned",
                                        "category", *MODEL_FEATURES[:-1]))


def train_return_model(features: DataFrame, params: BoostParams = BoostParams()
                       ) -> tuple[PipelineModel, DataFrame]:
    """F8: scaled boosted classifier on the 15 features; returns the model and
    the held-out (test) rows scored."""
    d = features.withColumn("category", F.coalesce(F.col("category"), F.lit("Unknown")))
    d = stratified_split(d, "is_returned", "transaction_id")
    pipe = Pipeline(stages=[
        StringIndexer(inputCol="category", outputCol="category_encoded",
                      stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=MODEL_FEATURES, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        BoostedClassifier(featuresCol="_x", labelCol="is_returned", maxIter=params.max_iter,
                      maxDepth=params.max_depth, stepSize=params.step_size, seed=params.seed),
    ])
    train = d.filter(F.col("split") == "train").fillna(0, MODEL_FEATURES[:-1])
    test = d.filter(F.col("split") == "test").fillna(0, MODEL_FEATURES[:-1])
    model = pipe.fit(train)
    return model, score_returns(model, test, keep=("is_returned",))


def score_returns(model: PipelineModel, features: DataFrame, keep=()) -> DataFrame:
    """return probability and risk band per transaction."""
    s = model.transform(features.fillna(0, MODEL_FEATURES[:-1]))
    p = vector_to_array(F.col("probability"))[1]
    return s.select("transaction_id", "customer_id", "product_id", "date", *keep,
                    p.alias("return_probability"),
                    band(p, RISK_EDGES, RISK_LABELS).alias("return_risk"))


def return_risk_band(df: DataFrame, p: str = "return_probability") -> DataFrame:
    return df.withColumn("return_risk", band(p, RISK_EDGES, RISK_LABELS))


def high_return_risk(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """transactions above the threshold, riskiest first."""
    return (scored.filter(F.col("return_probability") > threshold)
            .orderBy(F.desc("return_probability"), "transaction_id"))


def return_factors(features: DataFrame, cols=FACTOR_COLUMNS) -> DataFrame:
    """mean of each factor for returned vs kept rows (one pass, unpivoted)."""
    r = F.col("is_returned") == 1
    aggs = []
    for c in cols:
        aggs += [F.avg(F.when(r, F.col(c))).alias(f"{c}__r"),
                 F.avg(F.when(~r, F.col(c))).alias(f"{c}__n")]
    wide = features.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__r").cast("double").alias("returned_mean"),
                     F.col(f"{c}__n").cast("double").alias("not_returned_mean")) for c in cols]
    long = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.withColumn("difference", F.col("returned_mean") - F.col("not_returned_mean"))


def category_return_rate(features: DataFrame) -> DataFrame:
    """mean return flag per category, highest first."""
    return (features.groupBy("category").agg(F.avg("is_returned").alias("return_rate"))
            .orderBy(F.desc("return_rate"), "category"))


def return_reason_share(features: DataFrame) -> DataFrame:
    """share of each reason among returned transactions."""
    ret = features.filter(F.col("is_returned") == 1)
    total = ret.agg(F.count(F.lit(1))).scalar()
    return (ret.groupBy("return_reason").agg(F.count(F.lit(1)).alias("n"))
            .select("return_reason", (F.col("n") / total).alias("share"))
            .orderBy(F.desc("share"), "return_reason"))


def return_importance(model: PipelineModel, spark) -> DataFrame:
    """feature → importance of the boosted classifier."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(MODEL_FEATURES, [float(x) for x in imp])),
                                 "feature string, importance double")
