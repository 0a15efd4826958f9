"""Operators that SQL can express, against DuckDB on tables with every odd case."""

from collections import Counter

import duckdb
import pytest

from riskloom.llm.queries import ORACLE, QUERIES


def _con(folder):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in ORACLE if n != "op9_chosen_path"])
def test_odd_cases(spark, odd_dir, name):
    ours = QUERIES[name](spark, odd_dir)
    theirs = _con(odd_dir).execute(ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert Counter(map(tuple, ours.select(*names).collect())) == Counter(theirs.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    expected = 1 if name == "op3_chat_windows" else 0  # the conversation that the query adds
    assert QUERIES[name](spark, empty_dir).count() == expected
