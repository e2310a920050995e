"""All registered queries."""

from __future__ import annotations

from . import change_queries, gap_queries, panel_queries, result_queries, source_queries, trajectory_queries
from .registry import merged

ALL = merged([gap_queries.QUERIES, trajectory_queries.QUERIES, panel_queries.QUERIES, change_queries.QUERIES, result_queries.QUERIES, source_queries.QUERIES])
FLAGSHIP = "change_scan"
