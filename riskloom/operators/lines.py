"""From file contents to lines.

A file stays one row and carries its lines as an array.  Everything that needs
neighbouring lines reads them from that array, so no operator shuffles text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.plan import computed_once
from riskloom.model import LONG_LINE_BYTES


def has_oversized_line(content: Column) -> Column:
    """True for files with a very long line; they are scanned like all others."""
    raw = F.split(content, "\n", -1)
    return F.when(
        F.octet_length(content) >= LONG_LINE_BYTES,
        F.exists(raw, lambda t: F.octet_length(t) >= LONG_LINE_BYTES),
    ).otherwise(F.lit(False))


def line_array(content: Column) -> Column:
    """Lines without their line ends; no empty line after the last line end."""
    def without(text: Column, end: str) -> Column:
        cut = F.substr(text, F.lit(1), F.length(text) - 1)
        return F.when(F.endswith(text, F.lit(end)), cut).otherwise(text)

    # Split at a plain character: a pattern would be tried at every character of every line.
    bare = F.replace(without(without(content, "\n"), "\r"), F.lit("\r\n"), F.lit("\n"))
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(bare, "\n", -1))


def with_lines(files: DataFrame) -> DataFrame:
    """``files(project, path, content)`` → ``(project, path, lines)``."""
    # Computed once: what reads the lines is not copied below a union of sources either.
    readable = files.where(F.col("content").isNotNull())
    split = computed_once(readable, lines=line_array(F.col("content")))
    return split.select("project", "path", "lines")


def rejected_files(files: DataFrame) -> DataFrame:
    """Files with a very long line, as a note to the user; none is left out of a scan."""
    return files.where(has_oversized_line(F.col("content"))).select(
        "project", "path", F.octet_length("content").cast("bigint").alias("size_bytes")
    )


def explode_lines(with_lines_df: DataFrame) -> DataFrame:
    """One row per line: ``(project, path, line_no, text)``."""
    # The outer form keeps Catalyst from building the array twice, once for a size
    # filter below the generator.
    return (
        with_lines_df.select("project", "path", F.posexplode_outer("lines").alias("pos", "text"))
        .where(F.col("pos").isNotNull())
        .select("project", "path", (F.col("pos") + 1).alias("line_no"), "text")
    )
