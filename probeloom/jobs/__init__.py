"""Registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable


def all_queries() -> tuple[dict[str, Callable], dict[str, str]]:
    """Name -> query, and name -> DuckDB SQL with the same rows."""
    from probeloom.jobs import board_queries, coord_queries, file_queries, probe_queries, tile_queries

    queries, oracles = {}, {}
    for part in (board_queries, probe_queries, coord_queries, tile_queries, file_queries):
        queries |= part.QUERIES
        oracles |= part.ORACLES
    return queries, oracles
