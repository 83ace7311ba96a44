"""Registers queries with the DuckDB statements that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wanetrack.functions.exprs import NUDGE, rounded
from wanetrack.plans.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = "", doubles: str = "", digits: int = 6, **views: str):
    """Doubles of the result are rounded on both sides, since sums are not taken in one order."""

    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            body = sql
            if doubles:
                cols = ", ".join(f"round({c} + {NUDGE:.8f}, {digits}) as {c}" for c in doubles.split())
                body = f"select * replace ({cols}) from (\n{sql}\n)"
            ORACLES[name] = oracle(body, *uses.split(), **views)
        return f

    return register
