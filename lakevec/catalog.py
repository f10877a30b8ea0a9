"""The registered queries of the vector engine and their SQL."""

from __future__ import annotations

from lakevec.plans.vector_queries import ORACLES, QUERIES

FLAGSHIP = "exact_knn"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
