"""Compare every registered query with its SQL: `python -m tillroll_checks.compare [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

from tillroll_checks.oracle import ORACLE
from tillroll_checks.queries import QUERIES
from tillroll.session import local_session

TABLES = ("customer", "documents", "events", "lineitem", "nation", "orders", "part", "supplier")
KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "smallint", "VARCHAR": "string",
    "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else repr(value))
    if isinstance(value, Decimal):
        return (1, str(value))
    return (1, str(value))


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """'' when equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    result = con.execute(ORACLE[name])
    described = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    if sorted(kinds) != sorted(described):
        return f"columns {sorted(set(kinds) ^ set(described))}"
    wrong = [
        f"{c}: {kinds[c]} / {t}"
        for c, t in described.items()
        if kinds[c] != KINDS.get(t, t.lower())
    ]
    a, b = normal(list(kinds), got), normal(list(described), want)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)} {wrong}"
    for x, y in zip(a, b):
        if x != y:
            names = sorted(kinds)
            off = [(n, p[1], q[1]) for n, p, q in zip(names, x, y) if p != q]
            return f"values {off[:4]} {wrong}"
    if wrong:
        return f"types {wrong}"
    return "" if a else "no rows"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    failed = [n for n in names if n not in ORACLE]
    for name in failed:
        print(f"{name}: no SQL")
    for name in names:
        if name in ORACLE:
            start = time.time()
            try:
                problem = compare(spark, con, sf_dir, name)
            except Exception as error:  # noqa: BLE001
                problem = f"{type(error).__name__}: {str(error)[:600]}"
            print(f"{name}: {problem or 'ok'} ({time.time() - start:.1f}s)", flush=True)
            if problem:
                failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
