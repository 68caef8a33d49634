"""Register of queries and the SQL that checks them.

A query takes `Tables` and returns a DataFrame. Its SQL sees the driver tables
and the relations of `adapters.CTES`; a query without SQL is checked for rows by
the driver and against brute force or invariants by the tests.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from affinia.session import tune
from affinia.sources.adapters import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def relations(text: str) -> list[tuple[str, str]]:
    """(name, definition) of every relation of a list `a AS (...), b AS (...)`, in order."""
    found, depth, start = [], 0, 0
    for i, c in enumerate(f"{text},"):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            one = text[start:i].strip()
            start = i + 1
            if one:
                found.append((re.match(r"\w+", one).group(), one))
    return found


def with_relations(sql: str, ctes: str, inline: bool = False) -> str:
    """The SQL with those relations alone that it needs; relations read twice are computed once, or with `inline` each time."""
    listed = [*relations(CTES), *relations(ctes)]
    needed, kept = sql, []
    for name, body in reversed(listed):
        uses = len(re.findall(rf"\b{name}\b", needed))
        if uses:
            head, rest = re.match(r"(.*?\bAS)\s+(?:MATERIALIZED\s+)?(\(.*)", body, re.S).groups()
            kept.insert(0, f"{head} {'NOT ' if inline else ''}MATERIALIZED {rest}" if uses > 1 else f"{head} {rest}")
            needed += f"\n{body[len(name):]}"
    recursive = "RECURSIVE " if re.search(r"\bRECURSIVE\b", ctes) else ""
    return f"WITH {recursive}{', '.join(kept)}\n{sql.strip()}" if kept else sql.strip()


def query(name: str, sql: str | None = None, ctes: str = "", plain: bool = False, inline: bool = False):
    """Register `fn(tables)` under `name`; `ctes` extends the shared relations.

    `inline` is for SQL that joins a relation with another one made from it.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip() if plain else with_relations(sql, ctes, inline)
        return fn

    return register


def r(expression: str, digits: int = 6) -> str:
    """SQL twin of `scalars.rounded`."""
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"


def h32(*parts: str) -> str:
    """SQL twin of `scalars.hash32`."""
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT)"
