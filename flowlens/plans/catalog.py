"""All registered queries."""

from flowlens.plans import learner_queries, metric_queries, neighbour_queries, stream_queries, transform_queries  # noqa: F401
from flowlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
