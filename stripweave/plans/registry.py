"""All registered queries outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def greedy_sql(key: str, ident: str) -> str:
    """DuckDB SQL of the greedy rule, for ``WITH RECURSIVE``: ``greedy`` has ``key, n, ident, kept`` for every row of ``ranked``
    (``key, ident, n`` from 1 on in each key), by ``near`` (``key, a, b``: ids of rows near to each other, a first)."""
    hit = "coalesce(list_has_any(g.held, f.near), false)"
    return f"""fated AS (SELECT r.{key}, r.n, r.{ident} AS ident, list(p.a) FILTER (p.a IS NOT NULL) AS near FROM ranked r LEFT JOIN near p ON p.{key} = r.{key} AND p.b = r.{ident} GROUP BY 1, 2, 3),
greedy AS (SELECT {key}, n, ident, true AS kept, [ident] AS held FROM fated WHERE n = 1
  UNION ALL SELECT f.{key}, f.n, f.ident, NOT {hit}, CASE WHEN {hit} THEN g.held ELSE list_append(g.held, f.ident) END FROM greedy g JOIN fated f ON f.{key} = g.{key} AND f.n = g.n + 1)"""


def load() -> None:
    """Imports the modules that register queries."""
    from stripweave.plans import attempts, dataset, dedup, dialogue, elements, files, panels, sequences, stories, texts  # noqa: F401
