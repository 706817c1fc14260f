"""Shared column expressions.

All helpers return ``Column`` objects so they stay inside whole-stage codegen;
none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column, default: float | None = 0.0) -> Column:
    """num / den, ``default`` when the denominator is 0 or null."""
    q = F.try_divide(col_(num).cast("double"), col_(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


# Amounts carry at most four decimals (fixed value of the data contract).
MONEY_SCALE = 10_000


def money_units(c: str | Column) -> Column:
    """An amount as an exact integer count of 1/10,000 units."""
    return F.round(col_(c) * MONEY_SCALE).cast("long")


def money_sum(c: str | Column) -> Column:
    """Exact fixed-point sum of an amount (integer sum, one division): the
    result does not depend on summation order, so every engine and every
    partitioning gives the same double."""
    return F.sum(money_units(c)) / float(MONEY_SCALE)


def money_avg(c: str | Column) -> Column:
    """Mean of an amount from its exact sum."""
    return money_sum(c) / F.count(col_(c))


def band(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2], ...``; outside every bin → null.

    Equivalent of ``pd.cut(x, bins=edges, labels=labels)`` (left-open,
    right-closed).  ``Bucketizer`` is left-closed, so it is not used.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("band needs len(edges) == len(labels) + 1")
    x = col_(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def weekday0(c: str | Column) -> Column:
    """Day of week with Monday = 0 (pandas ``dayofweek``)."""
    return F.weekday(col_(c))


def in_months(c: str | Column, months: Sequence[int]) -> Column:
    return col_(c).isin(list(months)).cast("int")


def calendar_columns(df: DataFrame, date_col: str = "date") -> DataFrame:
    """year, month, day_of_week (Mon=0), day_of_year, weekend and season flags."""
    d = F.col(date_col)
    return df.withColumns({
        "year": F.year(d),
        "month": F.month(d),
        "day_of_week": weekday0(d),
        "day_of_year": F.dayofyear(d),
        "is_weekend": (weekday0(d) >= 5).cast("int"),
        "is_holiday_season": in_months(F.month(d), (11, 12)),
        "is_spring": in_months(F.month(d), (3, 4, 5)),
        "is_summer": in_months(F.month(d), (6, 7, 8)),
        "is_fall": in_months(F.month(d), (9, 10, 11)),
    })


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> DataFrame:
    """Fail early (at plan time, no job) when an input lacks a column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns {missing}; has {df.columns}")
    return df
