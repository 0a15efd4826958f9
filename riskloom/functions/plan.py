"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that a later filter may use without evaluating them again.

    Catalyst pushes a filter below a projection by copying the expressions it
    uses, which runs expensive ones twice.  It does not push below a generator,
    so the values go through one that yields exactly one row.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))
