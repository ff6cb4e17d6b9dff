"""All registered queries."""

from __future__ import annotations

from functools import lru_cache

from . import (
    activity_queries,
    graph_queries,
    history_queries,
    log_queries,
    state_queries,
    store_queries,
)
from .registry import Registry


@lru_cache(maxsize=1)
def catalog() -> Registry:
    registry = Registry()
    history_queries.register(registry)
    log_queries.register(registry)
    activity_queries.register(registry)
    graph_queries.register(registry)
    store_queries.register(registry)
    state_queries.register(registry)
    return registry
