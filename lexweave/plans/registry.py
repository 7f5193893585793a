"""All queries of the library's own operators with their DuckDB counterparts."""

from __future__ import annotations

from . import decision_queries, evaluation_queries, evidence_queries, hangul_queries, local_queries, matching_queries, morphology_queries, offset_queries, pipeline_queries, proposal_queries, relational_queries, retrieval_queries, source_queries, statistics_queries, stream_queries, table_function_queries, text_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
