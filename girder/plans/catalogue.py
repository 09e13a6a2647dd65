"""All registered queries of the library."""

from __future__ import annotations

from girder.plans import queries_business, queries_contracts, queries_geometry, queries_models, queries_plans, queries_rasters, queries_records, queries_specs, queries_text  # noqa: F401
from girder.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
