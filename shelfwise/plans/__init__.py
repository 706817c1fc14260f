"""Query catalogue (Spark plan + SQL oracle per operator key)."""

from shelfwise.plans import (customer_queries, demand_queries, pricing_queries,  # noqa: F401
                             recommend_queries,
                             risk_queries, source_queries, supply_queries)
from shelfwise.plans.catalog import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
