"""Query catalogue: one Spark plan and (where SQL can express it) one DuckDB
oracle per operator key.

A query is a function ``(spark, sf_dir) -> DataFrame`` registered with
``@query("key", sql=...)``.  Queries whose result comes from a fitted or
random model register no SQL; the driver then checks rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.plans.oracle import ADAPTER_CTES

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None, rounded: Sequence[str] = ()):
    """Register a query; ``rounded`` names the double columns the oracle rounds
    to 6 places (the Spark side rounds every double column)."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = oracle(sql, rounded)
        return fn
    return deco


def oracle(body: str, rounded: Sequence[str] = ()) -> str:
    """``WITH <adapter views>[, extra views] SELECT ...`` with chosen columns rounded.

    ``body`` is either a plain SELECT or starts with ``, name AS (...)`` to add
    further views after the adapter's.
    """
    body = body.strip()
    sep = "\n" if body.startswith(",") else "\n"
    full = "WITH " + ADAPTER_CTES.strip() + sep + body
    if not rounded:
        return full
    repl = ", ".join(f"round({c}, 6) AS {c}" for c in rounded)
    # Wrap: the inner statement keeps its own WITH; DuckDB allows a subquery with WITH.
    return f"SELECT * REPLACE ({repl}) FROM (\n{full}\n) AS q"


def money_sum_sql(x: str) -> str:
    """SQL twin of ``exprs.money_sum`` (exact fixed-point sum)."""
    return f"CAST(sum(CAST(round({x} * 10000) AS BIGINT)) AS DOUBLE) / 10000"


def money_avg_sql(x: str) -> str:
    """SQL twin of ``exprs.money_avg``."""
    return f"({money_sum_sql(x)}) / count({x})"


def finish(df: DataFrame, places: int = 6, exact: Sequence[str] = ()) -> DataFrame:
    """Round every double column (float sums depend on evaluation order),
    except ``exact`` ones: values computed from exact fixed-point sums by the
    same operations in every engine are left as they are (rounding identical
    doubles is itself engine-dependent at half-way points)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in exact:
            cols.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
