"""All queries of the engine, with their SQL."""

from __future__ import annotations

from cosmolake.plans import q_catalogue, q_field, q_io, q_prefix, q_spatial, q_tree
from cosmolake.plans.registry import QUERIES, SQL

FLAGSHIP = QUERIES["tree_mutual_best"]

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "q_catalogue", "q_field", "q_io", "q_prefix", "q_spatial", "q_tree"]
