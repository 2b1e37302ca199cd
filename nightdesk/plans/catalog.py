"""All registered queries."""

from nightdesk.plans import queries_alerts, queries_desk, queries_security, queries_sources, queries_web  # noqa: F401
from nightdesk.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
