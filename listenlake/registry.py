"""Queries that the driver runs, by name, with their SQL twins."""

from __future__ import annotations

import re

from listenlake.plans import browse, library, listening, playlists, resolve, rules, scores, tables

_MODULES = (listening, library, rules, browse, tables, resolve, scores, playlists)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def _with_means(sql: str) -> str:
    """``mean(x, digits)`` written out: the mean rounded half up, from whole sums of millionths (see exprs.mean)."""

    def whole(m: re.Match) -> str:
        x, digits = m[1], int(m[2])
        unit, n = 10 ** (6 - digits), f"count({m[1]})"
        return f"(CAST((2 * sum(CAST(round({x} * 1000000) AS BIGINT)) + {n} * {unit}) // (2 * {n} * {unit}) AS BIGINT) / {10**digits}.0)"

    return re.sub(r"\bmean\((\w+), (\d)\)", whole, sql)


ORACLE = {k: _with_means(v) for m in _MODULES for k, v in m.ORACLE.items()}
