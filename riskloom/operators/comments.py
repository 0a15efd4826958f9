"""Block comments that span lines.

Each line is a function on the state "inside a block comment" (0 or 1): it
leaves the state alone (I), opens a comment (O), closes it (C) or flips it (S).
The whole file becomes a string of these letters.  A comment region is then a
plain regular expression over that string, so the state before every line comes
out of one linear pass and no line has to wait for a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.plan import computed_once
from riskloom.functions.text import trimmed

# A region starts at an opening (or flipping) line and ends with the line that
# closes (or flips) it; the rest are lines outside.
_REGIONS = "([OS][IO]*[CS]?|[IC]+)"


def _opens(text: Column) -> Column:
    """First block-comment start is not followed by an end on the same line."""
    start = F.locate("/*", text)
    return (start > 0) & ~F.contains(F.substr(text, start), F.lit("*/"))


def line_effect(text: Column) -> Column:
    """What the line does to the comment state: I, O, C or S."""
    end = F.locate("*/", text)
    from_outside = _opens(text)
    from_inside = (end == 0) | _opens(F.substr(text, end + 2))
    return (
        F.when(~F.contains(text, F.lit("/*")) & ~F.contains(text, F.lit("*/")), F.lit("I"))
        .when(from_outside & from_inside, F.lit("O"))
        .when(~from_outside & ~from_inside, F.lit("C"))
        .when(from_outside, F.lit("S"))
        .otherwise(F.lit("I"))
    )


def with_comment_state(df: DataFrame) -> DataFrame:
    """Adds ``in_comment``: per line "1" if a block comment is open before it."""
    effects = F.array_join(F.transform("lines", line_effect), "")
    regions = F.regexp_extract_all(effects, F.lit(_REGIONS), F.lit(0))

    def states(region: Column) -> Column:
        opened = F.substring(region, 1, 1).isin("O", "S")
        rest = F.length(region) - 1
        return F.when(opened, F.concat(F.lit("0"), F.repeat(F.lit("1"), rest))).otherwise(
            F.repeat(F.lit("0"), F.length(region))
        )

    # Computed once a file: a reader that asks for one line's state would compute all of them again.
    return computed_once(df, in_comment=F.split(F.array_join(F.transform(regions, states), ""), "", -1))


def surely_skipped(text: Column, in_comment: Column) -> Column:
    """Cheap test, on the raw line, for most lines :func:`visible_part` skips."""
    bare = trimmed(text)
    return F.when(
        in_comment == "1", ~F.contains(text, F.lit("*/"))
    ).otherwise(F.startswith(bare, F.lit("//")) | F.startswith(bare, F.lit("#")))


def with_visible_part(df: DataFrame) -> DataFrame:
    """Adds ``visible``: the code left on the line, NULL if the line is skipped.

    Needs ``text`` and ``in_comment``.  Rules still see the whole line; this only
    decides whether it is looked at and what is shown.
    """
    bare = trimmed(F.col("text"))
    end = F.locate("*/", F.col("_bare"))
    inside = F.col("in_comment") == "1"
    df = df.withColumn("_bare", bare).withColumn(
        "_rest",
        F.when(~inside, F.col("_bare")).when(end > 0, F.substr("_bare", end + 2)),
    )
    blank_rest = inside & (trimmed(F.col("_rest")) == "")
    cut = F.when(
        _opens(F.col("_rest")),
        F.expr("left(_rest, locate('/*', _rest) - 1)"),
    ).otherwise(F.col("_rest"))
    df = df.withColumn("_code", F.when(~blank_rest, cut))
    opened_blank = _opens(F.col("_rest")) & (trimmed(F.col("_code")) == "")
    comment_line = F.startswith("_code", F.lit("//")) | F.startswith("_code", F.lit("#"))
    return df.withColumn(
        "visible", F.when(~opened_blank & ~comment_line, F.col("_code"))
    ).drop("_bare", "_rest", "_code")
