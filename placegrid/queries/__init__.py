"""Every registered query over the test tables."""

from __future__ import annotations


def _load() -> None:
    from placegrid.queries import analytics, cleaning, control, matching, profiling, relational, sources  # noqa: F401


def all_queries() -> dict:
    _load()
    from placegrid.queries.registry import QUERIES

    return dict(sorted(QUERIES.items()))


def all_checks() -> dict:
    _load()
    from placegrid.queries.registry import CHECKS

    return dict(CHECKS)
