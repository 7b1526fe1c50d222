"""All queries of the engine's own operators with their SQL."""

from __future__ import annotations

from strataq.queries import aggregates, code, folds, graph, grounding, maintenance, metrics, pairs, retrieval, services, state, stores, texts, versions  # noqa: F401
from strataq.queries.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "lexical_topk_context"
