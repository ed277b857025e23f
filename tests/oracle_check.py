"""Compares registered queries with their DuckDB form; also a command line tool."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(spark, query, sql: str, sf: str, con) -> str | None:
    """None when names and rows agree, else a short report."""
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got == want:
        return None
    extra, missing = got - want, want - got
    return (
        f"{sum(got.values())} rows against {sum(want.values())}\n"
        f"  only Spark {sum(extra.values())}: {list(extra)[:2]}\n"
        f"  only SQL   {sum(missing.values())}: {list(missing)[:2]}"
    )


def main(sf: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from auditloom.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    if zone := os.environ.get("AUDITLOOM_TEST_ZONE"):
        spark.conf.set("spark.sql.session.timeZone", zone)
    con = duck(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        started = time.time()
        try:
            if name in sql:
                report = difference(spark, queries[name], sql[name], sf, con)
            else:
                report = None
                print(name, "rows only", queries[name](spark, sf).count())
        except Exception as e:  # noqa: BLE001 - the report names the failing query
            report = f"{type(e).__name__} {str(e)[:900]}"
        print("ok  " if report is None else "FAIL", name, round(time.time() - started, 2))
        if report:
            bad += 1
            print("   ", report[:1800])
    print("failed", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
