"""Where queries and their SQL are kept by name."""

from __future__ import annotations

from . import analogs as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) and the DuckDB SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = A.sql(sql)
        return f

    return keep
