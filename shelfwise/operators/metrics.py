"""Evaluation metrics (J1–J5) as single aggregates over (actual, predicted).

Global order (ROC-AUC) uses the distributed rank helper in
``shelfwise.functions.stats``; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.stats import roc_auc as _roc_auc


def forecast_metrics(df: DataFrame, y: str = "actual", yhat: str = "forecast",
                     lower: str | None = None, upper: str | None = None) -> DataFrame:
    """MAE, RMSE, R² = 1 − SSE/SST, MAPE (÷ (y+1)) ×100, coverage when
    both bounds are given.  (Not ``regr_r2``: that is squared correlation.)"""
    a, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    ybar = df.agg(F.avg(a)).scalar()
    aggs = [F.avg(F.abs(a - p)).alias("MAE"),
            F.sqrt(F.avg((a - p) * (a - p))).alias("RMSE"),
            (1 - F.sum((a - p) * (a - p)) / F.sum((a - ybar) * (a - ybar))).alias("R2"),
            (F.avg(F.abs((a - p) / (a + 1))) * 100).alias("MAPE")]
    if lower is not None and upper is not None:
        aggs.append(F.avg(((a >= F.col(lower)) & (a <= F.col(upper))).cast("double"))
                    .alias("Coverage"))
    return df.agg(*aggs)


def interval_coverage(df: DataFrame, y: str, lower: str, upper: str) -> DataFrame:
    """Share of actuals inside [lower, upper]."""
    a = F.col(y)
    return df.agg(F.avg(((a >= F.col(lower)) & (a <= F.col(upper))).cast("double"))
                  .alias("Coverage"))


def _counts(df: DataFrame, y: str, yhat: str):
    t, p = F.col(y).cast("int") == 1, F.col(yhat).cast("int") == 1
    return df.agg(F.count(F.when(t & p, 1)).alias("tp"), F.count(F.when(~t & p, 1)).alias("fp"),
                  F.count(F.when(t & ~p, 1)).alias("fn"), F.count(F.when(~t & ~p, 1)).alias("tn"))


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_metrics(df: DataFrame, y: str = "actual", yhat: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division → 0)."""
    c = _counts(df, y, yhat)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return c.select(_div(tp + tn, tp + fp + fn + tn).alias("Accuracy"),
                    prec.alias("Precision"), rec.alias("Recall"),
                    _div(2 * tp, 2 * tp + fp + fn).alias("F1"))


def roc_auc(df: DataFrame, y: str = "actual", score: str = "score") -> DataFrame:
    """ROC-AUC with tie-averaged ranks (``ROC-AUC`` column)."""
    return _roc_auc(df, y, score).select(F.col("roc_auc").alias("ROC_AUC"))


def class_report(df: DataFrame, y: str = "actual", yhat: str = "predicted") -> DataFrame:
    """Per-class precision, recall, F1 and support."""
    c = _counts(df, y, yhat)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rows = []
    for cls, (a, b, m) in {1: (tp, fp, fn), 0: (tn, fn, fp)}.items():
        prec, rec = _div(a, a + b), _div(a, a + m)
        rows.append(F.struct(F.lit(cls).alias("class"), prec.alias("precision"),
                             rec.alias("recall"), _div(2 * a, 2 * a + b + m).alias("f1"),
                             (a + m).alias("support")))
    return c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
