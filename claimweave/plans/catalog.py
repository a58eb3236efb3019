"""All registered queries and their oracles."""

from __future__ import annotations

from claimweave.plans import (
    claims_queries,
    graph_queries,
    payment_queries,
    source_queries,
    taxonomy_queries,
    text_queries,
    vector_queries,
)
from claimweave.plans.registry import Query

_REGISTRIES = [
    module.REGISTRY
    for module in (source_queries, claims_queries, taxonomy_queries, text_queries, vector_queries, graph_queries, payment_queries)
]


def queries() -> dict[str, Query]:
    return {name: query for registry in _REGISTRIES for name, query in registry.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for registry in _REGISTRIES for name, sql in registry.oracles.items()}
