"""Run queries next to their oracle SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def compare(spark, con, query, sql: str, folder: str) -> tuple[bool, str]:
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}"
    if got == want:
        return True, f"{len(got)} rows"
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    return False, f"{len(got)} / {len(want)} rows; spark only {only_got}; oracle only {only_want}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from quietmark.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            ok, note = compare(spark, con, query, sql[name], folder)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:3000]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - began:.1f}s {note[:1500]}", flush=True)
    print("failed:", bad)
