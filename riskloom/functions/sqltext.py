"""SQL snippets for expressions built from long tables.

A table of a hundred patterns is one parsed expression this way instead of
thousands of single column objects.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from riskloom.functions.dialect import sql_string, to_java


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_string(w)})" for w in words) + ")"


def rlike(text: str, pattern: str) -> str:
    return f"rlike({text}, {sql_string(to_java(pattern))})"


def extract(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {sql_string(to_java(pattern))}, {group})"


def start(text: str, pattern: str) -> str:
    return f"regexp_instr({text}, {sql_string(to_java(pattern))})"


def first_known(options) -> str:
    """First option that is not NULL."""
    options = list(options)
    return "coalesce(" + ", ".join(options) + ")" if len(options) > 1 else options[0]


def constant_rows(rows: list[dict], schema: str) -> Column:
    """A constant array of structs."""
    return F.from_json(F.lit(json.dumps(rows)), f"ARRAY<STRUCT<{schema}>>")


def constant_list(values, kind: str = "STRING") -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), f"ARRAY<{kind}>")
