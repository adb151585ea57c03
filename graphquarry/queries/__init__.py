"""The registered queries of the engine, each with the SQL that checks it."""

from __future__ import annotations

from . import registry
from . import analytics, claims, context, entities, graph, ingest, programs, retrieval, stores, text, versions  # noqa: F401  they register themselves

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
