"""Compare registered queries with their SQL: ``check_oracles.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from codeloom.plans.inputs import TABLES  # noqa: E402

DATA = "/root/testdata"


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/sf{sf}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, sf: str, name: str) -> tuple[bool, str]:
    import __spark_entry__ as entry

    frame = entry.queries()[name](spark, f"{DATA}/sf{sf}")
    ours = rows_of(frame.columns, frame.collect())
    result = connection.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if ours != theirs:
        extra = [r for r in ours if r not in set(theirs)][:2] if len(ours) < 50_000 else []
        missing = [r for r in theirs if r not in set(ours)][:2] if len(ours) < 50_000 else []
        return False, f"{len(ours)} rows against {len(theirs)}; only ours {extra}; only SQL {missing}"
    return True, f"{len(ours)} rows"


def main() -> int:
    import __spark_entry__ as entry
    from codeloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or [n for n in entry.queries() if n in entry.oracle_sql()]
    spark = local_session(8)
    connection = duck(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            same, note = compare(spark, connection, sf, name)
        except Exception as error:  # report and go on with the next query
            same, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not same
        print("ok  " if same else "BAD ", name, note[:1500], f"{time.time() - start:.1f}s", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
