"""Runs queries in Spark and DuckDB side by side and reports differences.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(
        tuple("" if v is None else str(v) for v in row)
        for row in frame[columns].itertuples(index=False, name=None)
    )


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> str:
    started = time.time()
    ours = query(spark, sf_dir).toPandas()
    middle = time.time()
    theirs = con.execute(sql).df()
    ended = time.time()
    took = f"spark {middle - started:.1f}s duckdb {ended - middle:.1f}s rows {len(ours)}"
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"COLUMNS {name} {sorted(ours.columns)} {sorted(theirs.columns)}"
    a, b = rows_of(ours), rows_of(theirs)
    if a == b:
        return f"ok      {name:24s} {took}"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return (
        f"DIFFERS {name} {took} vs {len(theirs)}; only spark {len(only_a)} only duckdb {len(only_b)}\n"
        f"   spark:  {only_a[:3]}\n   duckdb: {only_b[:3]}"
    )


def main(argv: list[str]) -> int:
    from checks.oracle import all_sql
    from checks.queries import QUERIES
    from checks.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, sqls = local_session(), duck(sf_dir), all_sql()
    bad = 0
    for name in names:
        if name not in sqls:
            continue
        try:
            verdict = compare(spark, con, sf_dir, name, QUERIES[name], sqls[name])
        except Exception as error:  # report and go on with the next query
            verdict = f"FAILED  {name}: {str(error)[:600]}"
        bad += not verdict.startswith("ok")
        print(verdict, flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
