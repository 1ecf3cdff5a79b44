"""Where queries and their oracle SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contrapunto.plans.analogs import VIEWS, Tables, duck_ctes, needs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``{view}`` in the oracle pulls that view in.

    An oracle body starts with SELECT, or with ``name AS (...)`` steps before it.
    """
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            used = [n for n in needs(oracle) if n in VIEWS]
            body = oracle.strip()
            for n in needs(oracle):
                body = body.replace("{" + n + "}", n)
            body = body.replace("{{", "{").replace("}}", "}")
            views = duck_ctes(used)
            steps = not body.upper().startswith("SELECT")
            prefix = ("WITH RECURSIVE " if "RECURSIVE_" in body else "WITH ") if (views or steps) else ""
            ORACLES[name] = prefix + views + (", " if views and steps else " ") + body
        return fn

    return wrap


def pct_sql(part: str, whole: str) -> str:
    """Exact half-even percentage of two two-place decimals, for oracles."""
    n, w = f"(CAST({part} * 100 AS HUGEINT) * 10000)", f"CAST(({whole}) * 100 AS HUGEINT)"
    q = f"({n} // {w})"
    up = f"CASE WHEN 2 * ({n} - {q} * {w}) > {w} THEN 1 WHEN 2 * ({n} - {q} * {w}) = {w} THEN {q} % 2 ELSE 0 END"
    return f"CAST(CAST({q} + {up} AS DECIMAL(20,2)) / 100 AS DECIMAL(18,2))"
