"""All queries of the engine and their SQL."""

from quillstone.plans import queries_embed, queries_extra, queries_files, queries_more, queries_rules, queries_store
from quillstone.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_embed", "queries_extra", "queries_files", "queries_more", "queries_rules", "queries_store"]
