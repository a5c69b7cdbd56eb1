"""The registered queries: one or more per operator, over the given tables."""

from workload import (  # noqa: F401
    cleaning, comparing, composites, expressions, filtering, modelling, profiles, reshaping, series,
)
from workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
