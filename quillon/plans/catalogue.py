"""Every query over the fixed tables and the SQL that checks them, gathered from the modules of this folder."""

from __future__ import annotations

from quillon.plans import evaluation, experiments, guards, indexes, learning, listings, recommend, retrieval, summaries, tables  # noqa: F401
from quillon.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
