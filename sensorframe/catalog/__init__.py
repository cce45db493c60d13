"""Every operator as a runnable query over the given tables, with its SQL counterpart."""

from __future__ import annotations

from . import batch, flows, logs, sinks, sources, streams, traces
from .base import Query

FAMILIES = (sources, sinks, batch, flows, logs, traces, streams)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        for name, query in family.catalog.items():
            if name in found:
                raise ValueError(f"duplicate query {name}")
            found[name] = query
    return found
