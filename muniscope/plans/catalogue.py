"""Every registered query with the SQL that states the same result."""

from . import canonical_queries, case_queries, evidence_queries, network_queries, outlook_queries, peer_queries, picture_queries, serving_queries, source_queries, stream_queries  # noqa: F401  each module registers its queries
from .registry import ORACLES, QUERIES

FLAGSHIP = "peer_zscore_ladder"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
