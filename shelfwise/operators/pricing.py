"""Markdown and pricing.

Per-product work is expressed as grouped aggregates keyed by product_id; the
elasticity step orders at most five discount buckets per product.  The
markdown search evaluates the six options inside each product row with array
higher-order functions (``transform`` / ``filter`` / ``array_max``), so it
needs neither a cross join nor a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.functions.exprs import band
from shelfwise.functions.stats import _materialise
from shelfwise.operators.trees import BoostedRegressor

# Fixed values of the markdown model:
DISCOUNT_EDGES = [-0.01, 0.01, 0.15, 0.30, 0.50, 1.0]
DISCOUNT_LABELS = ["No Discount", "Small (0-15%)", "Medium (15-30%)", "Large (30-50%)",
                   "Very Large (50%+)"]
MARKDOWN_OPTIONS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]
SCENARIOS = [0.1, 0.2, 0.3, 0.4, 0.5]
MARKDOWN_RATIO = 0.95          # paid below 95 % of list = markdown
BASE_DEMAND = 10.0
DEFAULT_ELASTICITY = -1.5
ELASTICITY_EPS = 1e-6


def with_discount(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """List price joined; discount_pct rounded to 6 places; right-closed bucket."""
    p = products.select("product_id", F.col("price").alias("original_price"))
    d = transactions.join(p, "product_id", "left")
    pct = F.round((F.col("original_price") - F.col("unit_price")) / F.col("original_price"), 6)
    return (d.withColumn("discount_pct", pct)
             .withColumn("discount_bucket", band("discount_pct", DISCOUNT_EDGES, DISCOUNT_LABELS)))


def bucket_stats(discounted: DataFrame) -> DataFrame:
    """Per product × bucket mean paid price, mean / total units, count."""
    return (discounted.filter(F.col("discount_bucket").isNotNull())
            .groupBy("product_id", "discount_bucket").agg(
                F.avg("unit_price").alias("avg_price"),
                F.avg("quantity").alias("avg_quantity"),
                F.sum("quantity").alias("total_quantity"),
                F.count(F.lit(1)).alias("n_transactions")))


def price_elasticity(stats: DataFrame) -> DataFrame:
    """Arc elasticity between consecutive buckets (ordered by mean price),
    averaged with weight = units of the lower bucket; ≥ 2 buckets and a
    positive weight sum required."""
    w = Window.partitionBy("product_id").orderBy("avg_price", "discount_bucket")
    s = stats.withColumns({"_p1": F.lead("avg_price").over(w),
                           "_q1": F.lead("total_quantity").over(w)})
    q0, p0 = F.col("total_quantity").cast("double"), F.col("avg_price")
    e = ((F.col("_q1") - q0) / (q0 + 1)) / ((F.col("_p1") - p0) / p0 + ELASTICITY_EPS)
    has_next = F.col("_p1").isNotNull()
    g = s.groupBy("product_id").agg(
        F.sum(F.when(has_next, q0 * e)).alias("_we"),
        F.sum(F.when(has_next, q0)).alias("_w"),
        F.count(F.lit(1)).alias("_nb"),
        F.avg("avg_price").alias("avg_price"))
    return (g.filter((F.col("_nb") >= 2) & (F.col("_w") > 0))
             .select("product_id", (F.col("_we") / F.col("_w")).alias("price_elasticity"),
                     "avg_price"))


def markdown_uplift(transactions: DataFrame, products: DataFrame,
                    ratio: float = MARKDOWN_RATIO) -> DataFrame:
    """Mean units with vs without markdown for products that have both."""
    p = products.select("product_id", F.col("price").alias("_list"))
    d = transactions.join(p, "product_id", "left")
    md = F.col("unit_price") < F.col("_list") * ratio
    pct = (F.col("_list") - F.col("unit_price")) / F.col("_list")
    g = d.groupBy("product_id").agg(
        F.avg(F.when(md, F.col("quantity"))).alias("markdown_sales"),
        F.avg(F.when(~md, F.col("quantity"))).alias("normal_sales"),
        F.avg(F.when(md, pct)).alias("avg_discount"),
        F.count(F.when(md, 1)).alias("_nm"), F.count(F.when(~md, 1)).alias("_nn"))
    up = F.col("markdown_sales") - F.col("normal_sales")
    return (g.filter((F.col("_nm") > 0) & (F.col("_nn") > 0))
             .select("product_id", up.alias("uplift"),
                     (up / (F.col("normal_sales") + 1) * 100).alias("uplift_pct"),
                     "avg_discount", "normal_sales", "markdown_sales"))


def _demand_change(m: Column, e: Column, up: Column, price: Column) -> Column:
    new_p = price * (1 - m)
    return F.when(e < 0, e * ((new_p - price) / price)).otherwise(
        F.when(m > 0, up / 100).otherwise(F.lit(0.0)))


def optimal_markdown(products: DataFrame, elasticity: DataFrame, uplift: DataFrame,
                     stock: DataFrame | None, days_until_end_of_season: int = 30,
                     holding_cost_rate: float = 0.001, base_demand: float = BASE_DEMAND,
                     default_elasticity: float | None = None) -> DataFrame:
    """Best markdown per product by net value (revenue on sellable units
    minus holding cost), urgency from stock and season end; richest first.

    An option whose value is undefined (no elasticity and no uplift) is never
    chosen; if no option has positive value the markdown is 0 with value 0.
    """
    d = (products.select("product_id", "category", "price")
         .join(elasticity.select("product_id", "price_elasticity"), "product_id", "left")
         .join(uplift.select("product_id", "uplift_pct"), "product_id", "left"))
    if stock is not None:
        d = d.join(stock.select("product_id", "stock_level"), "product_id", "left")
        d = d.withColumn("stock_level", F.coalesce(F.col("stock_level").cast("double"), F.lit(0.0)))
    else:
        d = d.withColumn("stock_level", F.lit(0.0))
    e = F.col("price_elasticity")
    if default_elasticity is not None:
        e = F.coalesce(e, F.lit(float(default_elasticity)))
    price, up, stk = F.col("price"), F.col("uplift_pct"), F.col("stock_level")

    def value(m: Column) -> Column:
        ed = base_demand * (1 + _demand_change(m, e, up, price))
        sold = F.when(ed.isNull(), F.lit(None).cast("double")).otherwise(F.least(ed, stk))
        rev = price * (1 - m) * sold
        hold = (F.greatest(F.lit(0.0), stk - ed) * price * holding_cost_rate
                * days_until_end_of_season)
        return F.struct((rev - hold).alias("net"), (-m).alias("neg_m"), m.alias("m"))

    opts = F.array(*[F.lit(float(x)) for x in MARKDOWN_OPTIONS])
    cands = F.filter(F.transform(opts, value), lambda s: s["net"] > 0)
    best = F.array_max(cands)
    urgency = (F.when((stk > 50) & F.lit(days_until_end_of_season < 30), "High")
                .when(stk > 20, "Medium").otherwise("Low"))
    d = d.withColumn("_best", best)
    mk = F.coalesce(F.col("_best.m"), F.lit(0.0))
    return (d.select(
                "product_id", "category", F.col("price").alias("current_price"),
                mk.alias("recommended_markdown"),
                (F.col("price") * (1 - mk)).alias("recommended_price"),
                F.coalesce(F.col("_best.net"), F.lit(0.0)).alias("expected_revenue"),
                "stock_level", urgency.alias("urgency"),
                F.col("price_elasticity"), F.col("uplift_pct"))
            .orderBy(F.desc("expected_revenue"), "product_id"))


def counterfactual(transactions: DataFrame, products: DataFrame, elasticity: DataFrame,
                   scenarios=SCENARIOS, default_elasticity: float = DEFAULT_ELASTICITY) -> DataFrame:
    """Revenue under each markdown scenario for every product (elasticity
    −1.5 when unknown; non-negative elasticity means no demand change)."""
    avg_q = transactions.groupBy("product_id").agg(F.avg("quantity").alias("_avg_q"))
    d = (products.select("product_id", "price")
         .join(avg_q, "product_id", "left")
         .join(elasticity.select("product_id", "price_elasticity"), "product_id", "left"))
    e = F.coalesce(F.col("price_elasticity"), F.lit(float(default_elasticity)))
    d = d.withColumn("markdown_pct", F.explode(F.array(*[F.lit(float(s)) for s in scenarios])))
    new_p = F.col("price") * (1 - F.col("markdown_pct"))
    dc = F.when(e < 0, e * ((new_p - F.col("price")) / F.col("price"))).otherwise(0.0)
    eq = F.col("_avg_q") * (1 + dc)
    base = F.col("price") * F.col("_avg_q")
    rc = new_p * eq - base
    return d.select("product_id", "markdown_pct", new_p.alias("new_price"),
                    eq.alias("expected_quantity"), (new_p * eq).alias("expected_revenue"),
                    rc.alias("revenue_change"),
                    (rc / (base + 1) * 100).alias("revenue_change_pct"))


# -- C4: demand–price model ----------------------------------------------------

@dataclass
class BoostParams:
    max_iter: int = 100
    max_depth: int = 5
    step_size: float = 0.1
    seed: int = 42


def demand_price_frame(transactions: DataFrame, products: DataFrame) -> DataFrame:
    p = products.select("product_id", F.col("price").alias("_list"),
                        F.col("category").alias("_cat"))
    d = transactions.join(p, "product_id", "left")
    return d.select(
        F.coalesce(F.col("_cat"), F.lit("Unknown")).alias("category"),
        F.coalesce(F.month("date"), F.lit(1)).cast("string").alias("month"),
        ((F.col("_list") - F.col("unit_price")) / (F.col("_list") + 1e-6)).alias("discount_pct"),
        F.log(F.col("unit_price") + 1).alias("log_price"),
        F.col("quantity").cast("double").alias("quantity"),
        "product_id", "transaction_id")


def train_demand_price(frame: DataFrame, params: BoostParams = BoostParams(),
                       train_fraction: float = 0.8) -> tuple[PipelineModel, DataFrame]:
    """C4: boosted trees of units on ln(price+1), discount and category / month
    dummies (first level dropped); deterministic 80/20 split by id hash.
    The frame is written once, as a fit reads it many times.
    Returns the model and the held-out scored rows."""
    h = (F.abs(F.xxhash64("transaction_id", F.lit(params.seed))) % 1000) / 1000.0
    f = _materialise(frame.fillna(0, ["discount_pct", "log_price"]).withColumn("_u", h))
    train, test = f.filter(F.col("_u") < train_fraction), f.filter(F.col("_u") >= train_fraction)
    pipe = Pipeline(stages=[
        StringIndexer(inputCols=["category", "month"], outputCols=["_ci", "_mi"],
                      stringOrderType="alphabetDesc", handleInvalid="keep"),
        # alphabetDesc puts the first level last, so dropLast drops it (drop_first)
        OneHotEncoder(inputCols=["_ci", "_mi"], outputCols=["_cv", "_mv"], dropLast=True),
        VectorAssembler(inputCols=["log_price", "discount_pct", "_cv", "_mv"], outputCol="_x"),
        BoostedRegressor(featuresCol="_x", labelCol="quantity", predictionCol="prediction",
                     maxIter=params.max_iter, maxDepth=params.max_depth,
                     stepSize=params.step_size, seed=params.seed),
    ])
    model = pipe.fit(train)
    return model, model.transform(test)
