"""Queries B1–B15 (demand forecasting)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import demand as D
from shelfwise.plans.catalog import finish, query
from shelfwise.sources.adapter import RetailTables

_FLAG = "CAST({} AS INTEGER)"

FEAT_SQL = """
, ds AS (
  SELECT date, product_id, store_id, CAST(sum(quantity) AS BIGINT) AS quantity,
         sum(total_amount) AS total_amount
  FROM transactions GROUP BY date, product_id, store_id
), dsp AS (
  SELECT ds.*, p.category, p.price FROM ds LEFT JOIN products p USING (product_id)
  WHERE ds.date IS NOT NULL
), feat AS (
  SELECT date, product_id, store_id, quantity, total_amount,
         coalesce(category, 'Unknown') AS category, coalesce(price, 0) AS price,
         CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
         CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
         CAST(dayofyear(date) AS INTEGER) AS day_of_year,
         CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend,
         CAST(month(date) IN (11, 12) AS INTEGER) AS is_holiday_season,
         CAST(month(date) IN (3, 4, 5) AS INTEGER) AS is_spring,
         CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_summer,
         CAST(month(date) IN (9, 10, 11) AS INTEGER) AS is_fall,
         coalesce(lag(quantity, 1) OVER w, 0) AS lag_1,
         coalesce(lag(quantity, 7) OVER w, 0) AS lag_7,
         coalesce(lag(quantity, 14) OVER w, 0) AS lag_14,
         coalesce(lag(quantity, 30) OVER w, 0) AS lag_30,
         coalesce(avg(quantity) OVER w7, 0) AS rolling_mean_7,
         coalesce(stddev_samp(quantity) OVER w7, 0) AS rolling_std_7
  FROM dsp
  WINDOW w AS (PARTITION BY product_id, store_id ORDER BY date),
         w7 AS (PARTITION BY product_id, store_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
), cat_series AS (
  SELECT category, store_id, date, CAST(sum(quantity) AS BIGINT) AS quantity,
         avg(price) AS price
  FROM feat GROUP BY category, store_id, date
)
"""

FEAT_COLS = ["date", "product_id", "store_id", "quantity", "total_amount", "category", "price",
             "year", "month", "day_of_week", "day_of_year", "is_weekend", "is_holiday_season",
             "is_spring", "is_summer", "is_fall", "lag_1", "lag_7", "lag_14", "lag_30",
             "rolling_mean_7", "rolling_std_7"]


def _features(spark, sf_dir):
    rt = RetailTables.of(spark, sf_dir)
    return D.demand_features(rt.transactions, rt.products)


@query("daily_sales", sql=FEAT_SQL + "SELECT date, product_id, store_id, quantity, total_amount FROM ds",
       rounded=["total_amount"])
def daily_sales(spark, sf_dir):
    return finish(D.daily_sales(RetailTables.of(spark, sf_dir).transactions))


@query("attach_product", sql=FEAT_SQL + "SELECT date, product_id, store_id, quantity, total_amount, category, price FROM dsp",
       rounded=["total_amount", "price"])
def attach_product(spark, sf_dir):
    rt = RetailTables.of(spark, sf_dir)
    return finish(D.attach_product(D.daily_sales(rt.transactions), rt.products)
                  .select("date", "product_id", "store_id", "quantity", "total_amount",
                          "category", "price"))


CAL = ["year", "month", "day_of_week", "day_of_year", "is_weekend", "is_holiday_season",
       "is_spring", "is_summer", "is_fall"]


@query("calendar_features", sql=FEAT_SQL + "SELECT date, product_id, store_id, " + ", ".join(CAL) + " FROM feat")
def calendar_features(spark, sf_dir):
    return _features(spark, sf_dir).select("date", "product_id", "store_id", *CAL)


@query("lag_features", sql=FEAT_SQL + "SELECT date, product_id, store_id, quantity, lag_1, lag_7, lag_14, lag_30 FROM feat")
def lag_features(spark, sf_dir):
    return _features(spark, sf_dir).select("date", "product_id", "store_id", "quantity",
                                           "lag_1", "lag_7", "lag_14", "lag_30")


@query("rolling_features", sql=FEAT_SQL + "SELECT date, product_id, store_id, quantity, rolling_mean_7, rolling_std_7 FROM feat",
       rounded=["rolling_mean_7", "rolling_std_7"])
def rolling_features(spark, sf_dir):
    return finish(_features(spark, sf_dir).select("date", "product_id", "store_id", "quantity",
                                                  "rolling_mean_7", "rolling_std_7"))


@query("fill_and_require", sql=FEAT_SQL + "SELECT " + ", ".join(FEAT_COLS) + " FROM feat",
       rounded=["total_amount", "price", "rolling_mean_7", "rolling_std_7"])
def fill_and_require(spark, sf_dir):
    return finish(_features(spark, sf_dir))


_ROLL_FEATS = D.FEATURES


@query("hierarchy_rollup", sql=FEAT_SQL + """
SELECT CAST(product_id AS VARCHAR) AS product_id, category, store_id, date,
       CAST(sum(quantity) AS BIGINT) AS quantity, """ +
       ", ".join(f"avg({c}) AS {c}" for c in _ROLL_FEATS) + """,
       CASE grouping(product_id, category, store_id, date) WHEN 4 THEN 'sku_store'
            WHEN 8 THEN 'category' ELSE 'store' END AS hierarchy_level
FROM feat
GROUP BY GROUPING SETS ((product_id, store_id, date), (category, store_id, date), (store_id, date))""",
       rounded=list(_ROLL_FEATS))
def hierarchy_rollup(spark, sf_dir):
    """The product key is null on the category and store levels; it is reported
    as text so the nullable key compares the same in every client."""
    r = D.hierarchy_rollup(_features(spark, sf_dir))
    return finish(r.withColumn("product_id", F.col("product_id").cast("string")))


@query("forecast_groups", sql=FEAT_SQL + "SELECT DISTINCT product_id, store_id, price FROM feat")
def forecast_groups(spark, sf_dir):
    return D.forecast_groups(_features(spark, sf_dir), "sku_store")


GRID_SQL = """
, grid AS (
  SELECT g.category, g.store_id, CAST(d.dt AS DATE) AS date
  FROM (SELECT DISTINCT category, store_id FROM feat) g,
       (SELECT unnest(range((SELECT max(date) FROM feat) + 1,
                            (SELECT max(date) FROM feat) + 31, INTERVAL 1 DAY)) AS dt) d
), gridcal AS (
  SELECT category, store_id, date,
         CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
         CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
         CAST(dayofyear(date) AS INTEGER) AS day_of_year,
         CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend,
         CAST(month(date) IN (11, 12) AS INTEGER) AS is_holiday_season,
         CAST(month(date) IN (3, 4, 5) AS INTEGER) AS is_spring,
         CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_summer,
         CAST(month(date) IN (9, 10, 11) AS INTEGER) AS is_fall
  FROM grid
)
"""


@query("future_grid", sql=FEAT_SQL + GRID_SQL + "SELECT * FROM gridcal")
def future_grid(spark, sf_dir):
    f = _features(spark, sf_dir)
    last = f.agg(F.max("date")).scalar()
    g = D.future_grid(D.forecast_groups(f, "category"), last, 30)
    return g.select("category", "store_id", "date", *CAL)


def _history_sql(keys: str, source: str) -> str:
    return f"""
, rh0 AS (
  SELECT {keys}, date, quantity, price,
         row_number() OVER (PARTITION BY {keys} ORDER BY date DESC) AS rn FROM {source}
), rh1 AS (
  SELECT {keys}, count(*) AS n, max(CASE WHEN rn = 1 THEN quantity END) AS last,
         avg(CASE WHEN rn <= 7 THEN quantity END) AS m7,
         avg(CASE WHEN rn <= 14 THEN quantity END) AS m14,
         avg(quantity) AS m30,
         stddev_samp(CASE WHEN rn <= 7 THEN quantity END) AS s7,
         avg(price) AS gp
  FROM rh0 WHERE rn <= 30 GROUP BY {keys}
), hist AS (
  SELECT {keys}, CAST(last AS DOUBLE) AS lag_1,
         CASE WHEN n >= 7 THEN m7 ELSE 0 END AS lag_7,
         CASE WHEN n >= 14 THEN m14 ELSE 0 END AS lag_14,
         m30 AS lag_30,
         CASE WHEN n >= 7 THEN m7 ELSE 0 END AS rolling_mean_7,
         CASE WHEN n >= 7 THEN coalesce(s7, 0) ELSE 0 END AS rolling_std_7,
         gp AS group_mean_price
  FROM rh1
)
"""


HIST_COLS = ["lag_1", "lag_7", "lag_14", "lag_30", "rolling_mean_7", "rolling_std_7",
             "group_mean_price"]


@query("recent_history", sql=FEAT_SQL + _history_sql("product_id, store_id", "feat") + "SELECT * FROM hist",
       rounded=HIST_COLS)
def recent_history(spark, sf_dir):
    return finish(D.recent_history(_features(spark, sf_dir), ["product_id", "store_id"]))


@query("forecast_interval", sql=FEAT_SQL + GRID_SQL + _history_sql("category, store_id", "cat_series") + """
SELECT g.category, g.store_id, g.date, h.lag_30 AS forecast,
       greatest(0, h.lag_30 - 1.96 * CASE WHEN h.rolling_std_7 > 0 THEN h.rolling_std_7 ELSE h.lag_30 * 0.3 END) AS lower_bound,
       h.lag_30 + 1.96 * CASE WHEN h.rolling_std_7 > 0 THEN h.rolling_std_7 ELSE h.lag_30 * 0.3 END AS upper_bound
FROM gridcal g JOIN hist h USING (category, store_id)""",
       rounded=["forecast", "lower_bound", "upper_bound"])
def forecast_interval(spark, sf_dir):
    """Intervals around a deterministic baseline (the 30-row recent mean) on
    the category-level grid; the fitted forest uses the same rule (B12)."""
    frame = D.scoring_frame(_features(spark, sf_dir), "category", 30)
    out = D.forecast_interval(frame.withColumn("forecast", F.col("lag_30")))
    return finish(out.select("category", "store_id", "date", "forecast", "lower_bound",
                             "upper_bound"))


@query("seasonal_forecast", sql=FEAT_SQL + """
, sb AS (
  SELECT category, store_id, date, CAST(quantity AS DOUBLE) AS q,
         CAST(date - DATE '1970-01-01' AS DOUBLE) AS t,
         month(date) AS m, isodow(date) - 1 AS dow FROM cat_series
), fit AS (
  SELECT category, store_id, regr_slope(q, t) AS slope, regr_intercept(q, t) AS intercept,
         avg(q) AS lvl FROM sb GROUP BY 1, 2
), mon AS (SELECT category, store_id, m, avg(q) AS m_avg FROM sb GROUP BY 1, 2, 3
), wd AS (SELECT category, store_id, dow, avg(q) AS d_avg FROM sb GROUP BY 1, 2, 3
), g AS (
  SELECT f.*, CAST(d.dt AS DATE) AS date FROM fit f,
    (SELECT unnest(range((SELECT max(date) FROM feat) + 1, (SELECT max(date) FROM feat) + 31,
                         INTERVAL 1 DAY)) AS dt) d
), g2 AS (
  SELECT g.category, g.store_id, g.date,
         coalesce(g.intercept + g.slope * CAST(g.date - DATE '1970-01-01' AS DOUBLE), g.lvl) AS trend,
         coalesce(CASE WHEN g.lvl <> 0 THEN mon.m_avg / g.lvl END, 1) AS month_index,
         coalesce(CASE WHEN g.lvl <> 0 THEN wd.d_avg / g.lvl END, 1) AS weekday_index
  FROM g LEFT JOIN mon ON g.category = mon.category AND g.store_id = mon.store_id AND month(g.date) = mon.m
         LEFT JOIN wd ON g.category = wd.category AND g.store_id = wd.store_id AND isodow(g.date) - 1 = wd.dow
)
SELECT category, store_id, date, greatest(0, trend * month_index * weekday_index) AS forecast,
       trend, month_index, weekday_index FROM g2""",
       rounded=["forecast", "trend", "month_index", "weekday_index"])
def seasonal_forecast(spark, sf_dir):
    f = _features(spark, sf_dir)
    series = D.level_series(f, "category")
    last = f.agg(F.max("date")).scalar()
    return finish(D.seasonal_forecast(series, ["category", "store_id"], last, 30))


@query("fourier_forecast")
def fourier_forecast(spark, sf_dir):
    """Every product-store series: trend times yearly and weekly Fourier seasons."""
    f = _features(spark, sf_dir)
    keys = ["product_id", "store_id"]
    last = f.agg(F.max("date")).scalar()
    return finish(D.fourier_forecast(D.fit_seasons(f, keys), keys, last))


# -- fitted forest: rows-only checks ------------------------------------------

@query("train_demand")
def train_demand(spark, sf_dir):
    """In-sample fit of the product-level forest (quantity vs prediction)."""
    f = _features(spark, sf_dir)
    model = D.train_demand(f)
    s = D.level_series(f, "sku_store")
    return finish(model.transform(s.fillna(0)).select(
        "product_id", "store_id", "date", "quantity", F.col("_pred").alias("prediction")))


@query("predict_demand")
def predict_demand(spark, sf_dir):
    f = _features(spark, sf_dir)
    return finish(D.predict_demand(D.train_demand(f), f))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    return finish(D.feature_importance(D.train_demand(_features(spark, sf_dir)), spark))
