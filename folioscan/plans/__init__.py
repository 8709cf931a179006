"""The registered queries, each with the SQL it is checked against."""

from folioscan.plans import (  # noqa: F401  (importing registers the queries)
    maintenance_plans,
    posting_plans,
    predicate_plans,
    ranking_plans,
    source_plans,
    stream_plans,
    value_plans,
)
from folioscan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
