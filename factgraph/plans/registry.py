"""All queries of the graph, by name, with their SQL."""

from factgraph.plans import checks, explore, operations, queries  # noqa: F401
from factgraph.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
