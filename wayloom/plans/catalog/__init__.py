"""Named queries, one module per area."""

from __future__ import annotations

import importlib

MODULES = [
    "trip_queries",
    "ingest_queries",
    "service_queries",
    "network_queries",
    "match_queries",
    "debug_queries",
    "stream_queries",
]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"wayloom.plans.catalog.{name}")
