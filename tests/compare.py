"""Compare queries with their SQL on one data folder: `python tests/compare.py [sf] [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(v).__name__, v) for v in (plain(row[i]) for i in order)) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None if Spark and DuckDB agree on names, value types and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want = rows_of(names, result.fetchall())
    have = rows_of(df.columns, df.collect())
    if want == have:
        return None
    only_spark, only_duck = have - want, want - have
    return (
        f"{sum(have.values())} rows against {sum(want.values())}; "
        f"only Spark {sum(only_spark.values())}: {sorted(only_spark, key=str)[:2]}; "
        f"only SQL {sum(only_duck.values())}: {sorted(only_duck, key=str)[:2]}"
    )


def main(argv: list[str]) -> int:
    from affinia.plans import ORACLES, QUERIES
    from affinia.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = argv[1:] or list(QUERIES)
    spark, con, bad = local_session(), duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                wrong, note = difference(df, con, ORACLES[name]), ""
            else:
                n = df.count()
                wrong, note = (None if n else "no rows"), f"(rows only: {n})"
        except Exception as error:  # noqa: BLE001 - report and go on
            wrong, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += wrong is not None
        print(f"{'ok  ' if wrong is None else 'BAD '} {time.time() - start:6.1f}s {name} {note} {wrong or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
