"""All registered queries."""

from skygauge.plans import collect_queries, delivery_queries, ingest_queries, message_queries, monitor_queries  # noqa: F401
from skygauge.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
