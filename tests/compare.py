"""Run registered queries next to their SQL in DuckDB and report every difference.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def database(folder: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shuffled = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shuffled, key=sort_key)


def differences(columns: list[str], rows: list[tuple], db, sql: str) -> list[str]:
    got_names, got = rows_of(columns, rows)
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want_names, want = rows_of(names, cursor.fetchall())
    problems = []
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)} rows")
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            problems.append(f"{g} != {w}")
            if len(problems) > 3:
                break
    return problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from undertow.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    db = database(folder)
    checks, failed = oracle_sql(), []
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            names, rows = frame.columns, [tuple(r) for r in frame.collect()]
            took, problems = time.time() - start, []
            if name in checks:
                problems = differences(names, rows, db, checks[name])
            note = f"{len(rows)} rows" + ("" if name in checks else " (no SQL)")
        except Exception as error:  # a report over all queries must not stop at the first
            problems, note, took = [f"{type(error).__name__}: {error}"], "error", 0.0
        print(f"{'FAIL' if problems else 'ok  '} {name}: {note}, {took:.1f}s", flush=True)
        for problem in problems:
            print("     ", problem[:1500])
        if problems:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(min(main(), 1))
