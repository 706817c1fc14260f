"""Merchandising and buying-horizon forecasts.

All per-category windows run over a monthly series (one row per category and
month), so their length is bounded by the calendar.  The recursive horizon
forecast is a short driver loop (≤ 12 steps); each step is one distributed
``transform`` over every category, and lineage is cut with ``checkpoint()``
into the shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.functions.exprs import band
from shelfwise.session import checkpoint_dir

# Fixed values of the merchandising model:
TREND_BAND = 10.0                   # ±10 % growth → Rising / Declining
MONTH_LAGS = (1, 3, 6, 12)
TREND_FEATURES = ["month", "quarter", "lag_1", "lag_3", "lag_6", "lag_12",
                  "rolling_mean_3", "rolling_mean_6", "yoy_growth"]
SCENARIO_CV = 0.3
N_SCENARIOS = 100
RISK_EDGES = [0.0, 20.0, 40.0, 60.0, 100.0]
RISK_LABELS = ["Low", "Medium", "High", "Very High"]
PERCENTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def monthly_sales(transactions: DataFrame) -> DataFrame:
    """Units, revenue and transaction count per (category, month)."""
    return transactions.groupBy("category", F.trunc("date", "month").alias("year_month")).agg(
        F.sum("quantity").alias("quantity"), F.sum("total_amount").alias("revenue"),
        F.count(F.lit(1)).alias("transaction_count"))


def category_trends(monthly: DataFrame) -> DataFrame:
    """Mean of the last 3 months vs the 3 months before (within the last
    6; with fewer than 6 months the windows overlap as in tail(6).head(3))."""
    w = Window.partitionBy("category").orderBy(F.desc("year_month"))
    wn = Window.partitionBy("category")
    m = (monthly.withColumn("_rn", F.row_number().over(w))
                .withColumn("_n", F.count(F.lit(1)).over(wn)))
    k = F.least(F.col("_n"), F.lit(6))
    g = m.groupBy("category").agg(
        F.avg(F.when(F.col("_rn") <= 3, F.col("quantity"))).alias("recent"),
        F.avg(F.when((F.col("_rn") <= k) & (F.col("_rn") > k - 3), F.col("quantity"))).alias("prev"),
        F.max("_n").alias("_n"))
    growth = (F.col("recent") - F.col("prev")) / (F.col("prev") + 1) * 100
    direction = (F.when(growth > TREND_BAND, "Rising").when(growth < -TREND_BAND, "Declining")
                  .otherwise("Stable"))
    return g.filter(F.col("_n") >= 2).select(
        "category", growth.alias("growth_rate"), direction.alias("trend_direction"),
        F.col("recent").alias("recent_volume"), growth.alias("momentum"))


def monthly_features(monthly: DataFrame, external_signals: DataFrame | None = None) -> DataFrame:
    """Calendar, row lags 1/3/6/12, trailing means 3/6, 12-row growth
    (undefined → 0), optional external signals joined by month; nulls → 0."""
    w = Window.partitionBy("category").orderBy("year_month")
    q = F.col("quantity")
    d = monthly.withColumns({
        "month": F.month("year_month"), "year": F.year("year_month"),
        "quarter": F.quarter("year_month"),
        **{f"lag_{k}": F.coalesce(F.lag(q, k).over(w), F.lit(0)) for k in MONTH_LAGS},
        "rolling_mean_3": F.avg(q).over(w.rowsBetween(-2, 0)),
        "rolling_mean_6": F.avg(q).over(w.rowsBetween(-5, 0)),
        "yoy_growth": F.coalesce(F.try_divide(q, F.lag(q, 12).over(w)) - 1, F.lit(0.0)),
    })
    if external_signals is not None:
        d = d.join(external_signals, "year_month", "left")
        d = d.fillna(0, [c for c in external_signals.columns if c != "year_month"])
    return d


@dataclass
class ForestParams:
    num_trees: int = 100
    max_depth: int = 10
    seed: int = 42


def train_trend_model(features: DataFrame, params: ForestParams = ForestParams()) -> PipelineModel:
    """Standardised forest of monthly units on the 9 trend features."""
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=TREND_FEATURES, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        RandomForestRegressor(featuresCol="_x", labelCol="quantity", predictionCol="_pred",
                              numTrees=params.num_trees, maxDepth=params.max_depth,
                              seed=params.seed),
    ])
    d = features.select(*TREND_FEATURES, F.col("quantity").cast("double").alias("quantity"))
    return pipe.fit(d.fillna(0))


def _step_features(series: DataFrame, target: F.Column) -> DataFrame:
    """Features for the month ``target`` (a date Column) from a (category,
    year_month, quantity, yoy) series: calendar-correct lags and trailing means
    of the months before ``target``."""
    months_back = F.months_between(target, F.col("year_month")).cast("int")
    q = F.col("quantity").cast("double")
    g = series.groupBy("category").agg(
        *[F.coalesce(F.max(F.when(months_back == k, q)), F.lit(0.0)).alias(f"lag_{k}")
          for k in MONTH_LAGS],
        F.avg(F.when((months_back >= 1) & (months_back <= 3), q)).alias("rolling_mean_3"),
        F.avg(F.when((months_back >= 1) & (months_back <= 6), q)).alias("rolling_mean_6"),
        F.max_by("yoy_growth", "year_month").alias("yoy_growth"))
    return g.withColumns({"year_month": target, "month": F.month(target),
                          "quarter": F.quarter(target)}).fillna(0)


def buying_horizon(model: PipelineModel, features: DataFrame, months: int = 6) -> DataFrame:
    """Recursive monthly forecast per category; each prediction feeds the
    lags and trailing means of the following months."""
    spark = features.sparkSession
    checkpoint_dir(spark)
    series = features.select("category", "year_month",
                             F.col("quantity").cast("double").alias("quantity"), "yoy_growth")
    last = features.agg(F.max("year_month")).scalar()
    out = None
    for i in range(1, months + 1):
        target = F.add_months(last, i)
        step = _step_features(series, target)
        pred = (model.transform(step)
                .select("category", "year_month", "month",
                        F.greatest(F.col("_pred"), F.lit(0.0)).alias("base_forecast"),
                        "yoy_growth")
                .checkpoint())                        # cut lineage (shared folder)
        series = series.unionByName(pred.select(
            "category", "year_month", F.col("base_forecast").alias("quantity"), "yoy_growth"))
        p = pred.drop("yoy_growth")
        out = p if out is None else out.unionByName(p)
    return out


def scenarios(base: DataFrame, n: int = N_SCENARIOS, cv: float = SCENARIO_CV,
              draws: str = "random", seed: int = 42) -> DataFrame:
    """``n`` scenarios of N(base, cv·base) clamped at 0 per forecast row;
    mean, median, p10/25/75/90 (linear) and population std.

    ``draws='random'`` samples with ``randn(seed)``; ``draws='stratified'``
    uses the fixed normal quantiles Φ⁻¹((k − ½)/n), k = 1..n (deterministic).
    Each group holds exactly ``n`` draws, so the exact percentile aggregate is
    bounded.
    """
    keys = [c for c in base.columns]
    b = F.col("base_forecast")
    if draws == "stratified":
        z = [NormalDist().inv_cdf((k - 0.5) / n) for k in range(1, n + 1)]
        d = base.withColumn("_z", F.explode(F.array(*[F.lit(x) for x in z])))
    elif draws == "random":
        d = base.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
            "_z", F.randn(seed))
    else:
        raise ValueError("draws must be 'random' or 'stratified'")
    d = d.withColumn("_v", F.greatest(F.lit(0.0), b + b * cv * F.col("_z")))
    return d.groupBy(*keys).agg(
        F.avg("_v").alias("mean"),
        *[F.percentile("_v", p).alias(name) for name, p in PERCENTILES.items()],
        F.stddev_pop("_v").alias("std"))


def forecast_risk(stats: DataFrame) -> DataFrame:
    """I8: uncertainty range and %, risk band (above 100 % → null), downside %."""
    rng = F.col("p90") - F.col("p10")
    pct = rng / (F.col("mean") + 1) * 100
    return stats.withColumns({
        "uncertainty_range": rng,
        "uncertainty_pct": pct,
        "risk_level": band(pct, RISK_EDGES, RISK_LABELS),
        "downside_risk": (F.col("mean") - F.col("p10")) / (F.col("mean") + 1) * 100,
    })


def baseline_horizon(monthly: DataFrame, months: int = 6) -> DataFrame:
    """Deterministic base forecast: the category's recent 3-month mean for each
    of the next ``months`` months (a companion to the fitted I6)."""
    trends = category_trends(monthly).select("category", "recent_volume")
    last = monthly.agg(F.max("year_month")).scalar()
    d = trends.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(months))))
    return d.select("category", F.add_months(last, F.col("_i")).alias("year_month"),
                    F.month(F.add_months(last, F.col("_i"))).alias("month"),
                    F.col("recent_volume").cast("double").alias("base_forecast"))
