"""Demand forecasting.

Shuffle plan: the daily aggregate (B1) is a hash aggregate with map-side
partial sums, so hot products are collapsed before the exchange.  Every window
afterwards runs over a per-(product, store) daily series whose length is
bounded by the number of calendar days, never by the number of transactions.
The forecast grid is an ``explode(sequence(...))`` on the group rows (no join);
the last date is a scalar subquery.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.functions.exprs import calendar_columns
from shelfwise.operators.trees import ForestRegressor

# Fixed values of the demand model:
LAGS = (1, 7, 14, 30)
ROLL = 7
HISTORY_ROWS = 30
INTERVAL_Z = 1.96
FALLBACK_STD_SHARE = 0.3
FEATURES = ["month", "day_of_week", "day_of_year", "is_weekend", "is_holiday_season",
            "is_spring", "is_summer", "is_fall", "lag_1", "lag_7", "lag_14", "lag_30",
            "rolling_mean_7", "rolling_std_7", "price"]
LEVELS = {
    "sku_store": ["product_id", "store_id"],
    "category": ["category", "store_id"],
    "store": ["store_id"],
}


def level_keys(level: str) -> list[str]:
    if level not in LEVELS:
        raise ValueError(f"unknown hierarchy_level {level!r}; use one of {sorted(LEVELS)}")
    return LEVELS[level]


def daily_sales(transactions: DataFrame) -> DataFrame:
    """B1: units and amount per (date, product, store)."""
    return transactions.groupBy("date", "product_id", "store_id").agg(
        F.sum("quantity").alias("quantity"), F.sum("total_amount").alias("total_amount"))


def attach_product(daily: DataFrame, products: DataFrame) -> DataFrame:
    """B2: left join category and list price (dimension side chosen by AQE)."""
    return daily.join(products.select("product_id", "category", "price"), "product_id", "left")


def lag_features(df: DataFrame, keys=("product_id", "store_id"), lags=LAGS) -> DataFrame:
    """Previous observed rows of the series (not calendar days); none → 0."""
    w = Window.partitionBy(*keys).orderBy("date")
    return df.withColumns({f"lag_{k}": F.coalesce(F.lag("quantity", k).over(w), F.lit(0))
                           for k in lags})


def rolling_features(df: DataFrame, keys=("product_id", "store_id"),
                     exclude_current: bool = False) -> DataFrame:
    """7-row trailing mean and sample std (current row included unless
    ``exclude_current``); a one-row std is 0."""
    hi = -1 if exclude_current else 0
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(ROLL - 1) + hi, hi)
    return df.withColumns({
        "rolling_mean_7": F.coalesce(F.avg("quantity").over(w), F.lit(0.0)),
        "rolling_std_7": F.coalesce(F.stddev_samp("quantity").over(w), F.lit(0.0)),
    })


def fill_and_require(df: DataFrame) -> DataFrame:
    """Drop rows without date/quantity, then nulls → 0 ('Unknown' for category)."""
    df = df.filter(F.col("date").isNotNull() & F.col("quantity").isNotNull())
    return df.fillna(0).fillna({"category": "Unknown"})


def demand_features(transactions: DataFrame, products: DataFrame,
                    exclude_current: bool = False) -> DataFrame:
    """B1–B6 in one plan; columns in the reference order."""
    d = attach_product(daily_sales(transactions), products)
    d = calendar_columns(d)
    d = lag_features(d)
    d = rolling_features(d, exclude_current=exclude_current)
    d = fill_and_require(d)
    return d.select("date", "product_id", "store_id", "quantity", "total_amount", "category",
                    "price", "year", "month", "day_of_week", "day_of_year", "is_weekend",
                    "is_holiday_season", "is_spring", "is_summer", "is_fall",
                    *[f"lag_{k}" for k in LAGS], "rolling_mean_7", "rolling_std_7")


def hierarchy_rollup(features: DataFrame) -> DataFrame:
    """All three hierarchy levels in one scan (GROUPING SETS).

    ``hierarchy_level`` names the level; quantity is summed, features averaged.
    """
    g = features.groupingSets(
        [["product_id", "store_id", "date"], ["category", "store_id", "date"],
         ["store_id", "date"]],
        "product_id", "category", "store_id", "date")
    gid = F.grouping_id("product_id", "category", "store_id", "date")
    out = g.agg(F.sum("quantity").alias("quantity"),
                *[F.avg(c).alias(c) for c in FEATURES],
                gid.alias("_gid"))
    lvl = (F.when(F.col("_gid") == 4, "sku_store").when(F.col("_gid") == 8, "category")
            .otherwise("store"))
    return out.withColumn("hierarchy_level", lvl).drop("_gid")


def level_series(features: DataFrame, level: str) -> DataFrame:
    """Training / history series at one level: rows per (group, date)."""
    keys = level_keys(level)
    if level == "sku_store":
        return features
    return features.groupBy(*keys, "date").agg(
        F.sum("quantity").alias("quantity"), *[F.avg(c).alias(c) for c in FEATURES])


def forecast_groups(features: DataFrame, level: str = "sku_store") -> DataFrame:
    """Distinct groups to forecast (with list price at SKU level)."""
    keys = level_keys(level)
    cols = keys + (["price"] if level == "sku_store" else [])
    return features.select(*cols).distinct()


def future_grid(groups: DataFrame, last_date, horizon: int = 30) -> DataFrame:
    """The next ``horizon`` days after ``last_date`` for every group, with
    calendar features; ``last_date`` is a Column (e.g. a scalar subquery)."""
    days = F.sequence(F.date_add(last_date, 1), F.date_add(last_date, horizon))
    return calendar_columns(groups.withColumn("date", F.explode(days)))


def recent_history(series: DataFrame, keys) -> DataFrame:
    """Lag-style features from the last 30 rows of each series.

    Frames from the last row backwards, read where the row number is 1: one sort per
    task and no hash table of the series.  Rows are not limited before the shuffle: the
    days of a series lie in different tasks, so a limit sorts all rows and drops few.
    Means over 7 / 14 rows (and the 7-row std) need that many rows, else 0.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    q = F.col("quantity")

    def last(rows):
        return w.rowsBetween(0, rows - 1)

    g = series.select(
        *keys, F.row_number().over(w).alias("_rn"),
        F.count(F.lit(1)).over(last(HISTORY_ROWS)).alias("_n"),
        q.alias("_last"),
        F.avg(q).over(last(7)).alias("_m7"),
        F.avg(q).over(last(14)).alias("_m14"),
        F.avg(q).over(last(HISTORY_ROWS)).alias("_m30"),
        F.stddev_samp(q).over(last(7)).alias("_s7"),
        F.avg("price").over(last(HISTORY_ROWS)).alias("_price")).filter(F.col("_rn") == 1)
    n = F.col("_n")
    return g.select(
        *keys,
        F.col("_last").cast("double").alias("lag_1"),
        F.when(n >= 7, F.col("_m7")).otherwise(0.0).alias("lag_7"),
        F.when(n >= 14, F.col("_m14")).otherwise(0.0).alias("lag_14"),
        F.col("_m30").alias("lag_30"),
        F.when(n >= 7, F.col("_m7")).otherwise(0.0).alias("rolling_mean_7"),
        F.when(n >= 7, F.coalesce(F.col("_s7"), F.lit(0.0))).otherwise(0.0).alias("rolling_std_7"),
        F.col("_price").alias("group_mean_price"))


def forecast_interval(df: DataFrame, pred: str = "forecast", std: str = "rolling_std_7") -> DataFrame:
    """std = rolling std if > 0 else 30 % of the forecast; ±1.96·std, lower ≥ 0."""
    s = F.when(F.col(std) > 0, F.col(std)).otherwise(F.col(pred) * FALLBACK_STD_SHARE)
    return df.withColumns({
        "lower_bound": F.greatest(F.lit(0.0), F.col(pred) - INTERVAL_Z * s),
        "upper_bound": F.col(pred) + INTERVAL_Z * s,
    })


def scoring_frame(features: DataFrame, level: str = "sku_store", horizon: int = 30) -> DataFrame:
    """Future grid × recent history: one feature row per (group, future date)."""
    keys = level_keys(level)
    series = level_series(features, level)
    last = features.agg(F.max("date")).scalar()
    groups = forecast_groups(features, level)
    hist = recent_history(series, keys)
    grid = future_grid(groups, last, horizon).join(hist, keys, "inner")
    price = F.col("price") if level == "sku_store" else F.col("group_mean_price")
    return grid.withColumn("price", price).drop("group_mean_price")


# -- model (B8, B12, B14) -----------------------------------------------------

@dataclass
class ForestParams:
    num_trees: int = 100
    max_depth: int = 15
    min_instances_per_node: int = 5      # sklearn min_samples_split=10 ≈ 5 per child
    seed: int = 42


def train_demand(features: DataFrame, level: str = "sku_store",
                 params: ForestParams = ForestParams()) -> PipelineModel:
    """Standardise the 15 features, fit a random forest on units sold.

    The rows are dealt over all cores and kept for the passes of the fit (every pass
    sends its histograms once a partition, so no more partitions than cores); each row
    keeps its node per tree, so the deep trees are not sent out and walked in every pass.
    """
    series = level_series(features, level).select(*FEATURES, "quantity").fillna(0)
    series = (series.withColumn("quantity", F.col("quantity").cast("double"))
              .repartition(series.sparkSession.sparkContext.defaultParallelism).persist())
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
        ForestRegressor(featuresCol="_features", labelCol="quantity",
                              predictionCol="_pred", numTrees=params.num_trees,
                              maxDepth=params.max_depth,
                              minInstancesPerNode=params.min_instances_per_node,
                              cacheNodeIds=True, seed=params.seed),
    ])
    try:
        return pipe.fit(series)
    finally:
        series.unpersist()


def predict_demand(model: PipelineModel, features: DataFrame, level: str = "sku_store",
                   horizon: int = 30) -> DataFrame:
    """Score every (group, future date), clamp at 0, add intervals."""
    keys = level_keys(level)
    frame = scoring_frame(features, level, horizon)
    scored = model.transform(frame).withColumn("forecast", F.greatest(F.col("_pred"), F.lit(0.0)))
    out = forecast_interval(scored)
    return out.select("date", "forecast", "lower_bound", "upper_bound", *keys)


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """Feature → importance of the fitted forest (15 rows)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(FEATURES, [float(x) for x in imp])),
                                 "feature string, importance double")


# -- B15: seasonal trend forecast (re-aimed Prophet) ------------------------------

def seasonal_forecast(series: DataFrame, keys, last_date, horizon: int = 30) -> DataFrame:
    """Per series linear trend × month index × weekday index.

    trend(t) = intercept + slope·t with t = days since 1970-01-01; a seasonal
    index is the mean of the series in that month (weekday) over its overall
    mean (1 when unseen or the mean is 0).  Grouped aggregates and equi-joins
    only.
    """
    t = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")).cast("double")
    q = F.col("quantity").cast("double")
    base = series.select(*keys, "date", q.alias("q"), t.alias("t"),
                         F.month("date").alias("m"), F.weekday("date").alias("dow"))
    fit = base.groupBy(*keys).agg(F.regr_slope("q", "t").alias("slope"),
                                  F.regr_intercept("q", "t").alias("intercept"),
                                  F.avg("q").alias("level"))
    mon = base.groupBy(*keys, "m").agg(F.avg("q").alias("m_avg"))
    wd = base.groupBy(*keys, "dow").agg(F.avg("q").alias("d_avg"))
    days = F.sequence(F.date_add(last_date, 1), F.date_add(last_date, horizon))
    grid = (fit.withColumn("date", F.explode(days))
               .withColumn("m", F.month("date")).withColumn("dow", F.weekday("date")))
    g = grid.join(mon, [*keys, "m"], "left").join(wd, [*keys, "dow"], "left")
    tt = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")).cast("double")
    trend = F.coalesce(F.col("intercept") + F.col("slope") * tt, F.col("level"))
    idx_m = F.coalesce(F.try_divide(F.col("m_avg"), F.col("level")), F.lit(1.0))
    idx_d = F.coalesce(F.try_divide(F.col("d_avg"), F.col("level")), F.lit(1.0))
    return g.select(*keys, "date",
                    F.greatest(F.lit(0.0), trend * idx_m * idx_d).alias("forecast"),
                    trend.alias("trend"), idx_m.alias("month_index"), idx_d.alias("weekday_index"))


# -- B15 with yearly and weekly Fourier terms ----------------------------------------

YEAR_DAYS, WEEK_DAYS = 365.25, 7.0
YEARLY_TERMS, WEEKLY_TERMS = 10, 3       # fixed values: sine and cosine pairs of each season
_EPOCH = "1970-01-01"


def fourier_terms(day: Column, yearly: int = YEARLY_TERMS, weekly: int = WEEKLY_TERMS) -> Column:
    """``sin, cos`` of each multiple of the yearly and the weekly frequency as an array."""
    t = F.datediff(day, F.lit(_EPOCH).cast("date")).cast("double")
    angles = [t * (2 * math.pi * n / YEAR_DAYS) for n in range(1, yearly + 1)]
    angles += [t * (2 * math.pi * n / WEEK_DAYS) for n in range(1, weekly + 1)]
    return F.array(*[f(a) for a in angles for f in (F.sin, F.cos)])


def _season_solver(keys: list[str], size: int, ridge: float):
    """Rows ``(keys, slope, intercept, g, r, x)`` of one series after the other (never split
    over partitions) to one row ``(keys, slope, intercept, beta)`` each, the solution of
    ``(X' X + ridge · mean(g²) · I) beta = X' r`` with the rows ``g x`` of ``X``.  Series of equal
    length are solved together; shorter ones than ``size`` by the equal
    ``beta = X' (X X' + ridge · mean(g²) · I)⁻¹ r``, a system of their own length."""
    def solved(batch: pa.RecordBatch, head: np.ndarray) -> pa.RecordBatch:
        g, r = batch["g"].to_numpy(), batch["r"].to_numpy()
        x = batch["x"].flatten().to_numpy().reshape(-1, size) * g[:, None]
        m = np.diff(np.append(head, len(g)))
        s = np.add.reduceat(g * g, head)
        weight = np.where(s > 0, ridge * s / m, 1.0)           # a series of zeros has no seasons
        beta = np.empty((len(head), size))
        for n in np.unique(m):
            of = np.flatnonzero(m == n)
            at = head[of][:, None] + np.arange(n)
            xs, rs, w = x[at], r[at][:, :, None], weight[of][:, None, None]
            if n < size:
                inner = np.linalg.solve(xs @ xs.transpose(0, 2, 1) + w * np.eye(n), rs)
                beta[of] = (xs.transpose(0, 2, 1) @ inner)[:, :, 0]
            else:
                xt = xs.transpose(0, 2, 1)
                beta[of] = np.linalg.solve(xt @ xs + w * np.eye(size), xt @ rs)[:, :, 0]
        key = batch.select([*keys, "slope", "intercept"]).take(pa.array(head))
        return pa.RecordBatch.from_arrays(
            [*key.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(head) + 1) * size, pa.int32()),
                                                    pa.array(beta.ravel()))], names=[*key.schema.names, "beta"])

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in batch.select(keys).columns:
            code = c.dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []                        # rows of the last series, one a day
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = pa.concat_batches([*open_, whole.slice(lo, 4096)])
                head = starts(batch)
                if len(head) > 1:
                    yield solved(batch.slice(0, head[-1]), head[:-1])
                open_ = [batch.slice(head[-1])]
        if open_:
            yield solved(open_[0], np.array([0]))

    return run


def fit_seasons(series: DataFrame, keys: Sequence[str], yearly: int = YEARLY_TERMS,
                weekly: int = WEEKLY_TERMS, ridge: float = 1.0) -> DataFrame:
    """One row per series: ``slope, intercept, beta``, the least-squares fit of
    ``quantity = g(t) · (1 + x(t) · beta)`` with the linear trend ``g`` of the series and
    yearly and weekly Fourier terms ``x``.  The ridge weighs as ``ridge`` days of an average
    level, so short series keep seasons near zero; one of a single day has a flat trend.
    A series is one row a day, bounded by the calendar; null dates and units are left out.
    The days are read once: trend and seasons come from the same partitioning by series, and
    the terms are formed behind it."""
    keys = list(keys)
    t = F.datediff("date", F.lit(_EPOCH).cast("date")).cast("double")
    d = series.filter(F.col("date").isNotNull() & F.col("quantity").isNotNull()).groupBy(*keys, "date").agg(
        F.sum(F.col("quantity").cast("double")).alias("q")).withColumn("t", t)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"slope": F.coalesce(F.regr_slope("q", "t").over(w), F.lit(0.0)),
                       "intercept": F.coalesce(F.regr_intercept("q", "t").over(w), F.avg("q").over(w))})
    size = 2 * (yearly + weekly)
    g = F.col("intercept") + F.col("slope") * F.col("t")
    rows = d.select(*keys, "slope", "intercept", g.alias("g"), (F.col("q") - g).alias("r"),
                    fourier_terms(F.col("date"), yearly, weekly).alias("x"))
    kinds = ", ".join(f"`{k}` {kind}" for k, kind in d.select(*keys).dtypes)
    return rows.mapInArrow(_season_solver(keys, size, ridge),
                           f"{kinds}, slope double, intercept double, beta array<double>")


def fourier_forecast(seasons: DataFrame, keys: Sequence[str], last_date: Column, horizon: int = 30,
                     yearly: int = YEARLY_TERMS, weekly: int = WEEKLY_TERMS) -> DataFrame:
    """The next ``horizon`` days of every fitted series, floored at 0.  The days are the
    same for every series, so their terms are formed once and a batch of series is one
    matrix product."""
    keys = list(keys)
    turns = 2 * math.pi * np.concatenate((np.arange(1, yearly + 1) / YEAR_DAYS, np.arange(1, weekly + 1) / WEEK_DAYS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                t = batch["_last"].to_numpy()[:, None] + np.arange(1, horizon + 1)
                days, which = np.unique(t, return_inverse=True)
                angle = days[:, None] * turns
                x = np.stack((np.sin(angle), np.cos(angle)), 2).reshape(len(days), -1)
                beta = batch["beta"].flatten().to_numpy().reshape(batch.num_rows, -1)
                if len(days) == horizon:                    # one last date
                    season = beta @ x.T
                else:
                    season = (x[which.reshape(t.shape)] @ beta[:, :, None])[:, :, 0]
                trend = batch["intercept"].to_numpy()[:, None] + batch["slope"].to_numpy()[:, None] * t
                key = batch.select(keys).take(pa.array(np.repeat(np.arange(batch.num_rows), horizon)))
                yield pa.RecordBatch.from_arrays(
                    [*key.columns, pa.array(t.ravel().astype(np.int32)).cast(pa.date32()), pa.array(trend.ravel()),
                     pa.array(season.ravel())], names=[*keys, "date", "trend", "season"])

    last = F.datediff(last_date, F.lit(_EPOCH).cast("date")).cast("double")
    d = seasons.select(*keys, "slope", "intercept", "beta", last.alias("_last")).filter(F.col("_last").isNotNull())
    kinds = ", ".join(f"`{k}` {kind}" for k, kind in seasons.select(*keys).dtypes)
    d = d.mapInArrow(run, f"{kinds}, date date, trend double, season double")
    return d.select(*keys, "date", F.greatest(F.lit(0.0), F.col("trend") * (1 + F.col("season"))).alias("forecast"),
                    "trend", "season")
