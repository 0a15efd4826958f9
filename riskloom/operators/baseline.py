"""Fingerprints and comparison with an earlier scan.

Paths are relative to their project, so a finding is known by project and fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


KEY = ["project", "fingerprint"]


def fingerprint(with_line: bool = True) -> Column:
    """16 hex digits of a hash over rule, path, line and whole match.

    Without the line the fingerprint survives code moving up or down.
    """
    parts = [F.col("rule_id"), F.col("path")]
    if with_line:
        parts.append(F.col("line_no").cast("string"))
    parts.append(F.col("match_text"))
    text = F.concat_ws(":", *parts)
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16)


def with_fingerprint(findings: DataFrame, with_line: bool = True) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(with_line))


def as_baseline(findings: DataFrame) -> DataFrame:
    """What is stored for later comparison: ``(project, path, fingerprint)``."""
    return with_fingerprint(findings).select("project", "path", "fingerprint")


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    known = baseline.select(*KEY).distinct()
    return with_fingerprint(findings).join(known, KEY, "left_anti").select(
        *findings.columns, "fingerprint"
    )


def fixed_fingerprints(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(project, fingerprint)`` of the baseline that no current finding has."""
    current = with_fingerprint(findings).select(*KEY)
    return baseline.select(*KEY).distinct().join(current, KEY, "left_anti")


def save_baseline(findings: DataFrame, location: str) -> None:
    as_baseline(findings).write.mode("overwrite").parquet(location)


def baseline_by_file(baseline: DataFrame) -> DataFrame:
    """Fingerprints per file as one list, the JSON form of a baseline."""
    return baseline.groupBy("project", "path").agg(
        F.sort_array(F.collect_list("fingerprint")).alias("fingerprints")
    )


# -- findings that moved -----------------------------------------------------------


def as_moving_baseline(findings: DataFrame) -> DataFrame:
    """What :func:`unmatched_findings` compares with: one row per finding, with and without its line."""
    return with_fingerprint(findings).select(
        "project", "path", "fingerprint", fingerprint(with_line=False).alias("moving")
    )


def unmatched_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings beyond those of the baseline, as a difference of multisets.

    A finding is known by rule, path and match.  Where a file now has more of one kind than it had, as many as
    before are old: those on a line that the baseline has, then the upper ones.  So code that moves
    gives nothing, and a second copy gives one finding.  Swapping the sides gives what was fixed.  Only counts
    and fingerprints of the baseline are joined; an empty baseline leaves every finding.
    """
    before = baseline.groupBy("project", "moving").agg(F.count("*").alias("_before"))
    same = baseline.select(*KEY).distinct().withColumn("_same", F.lit(True))
    now = with_fingerprint(findings).withColumn("moving", fingerprint(with_line=False))
    known = now.join(same, KEY, "left").join(before, ["project", "moving"], "left")
    kind = Window.partitionBy("project", "moving").orderBy(
        F.coalesce("_same", F.lit(False)).desc(), "line_no", "fingerprint"
    )
    beyond = known.withColumn("_place", F.row_number().over(kind)).where(
        F.col("_place") > F.coalesce("_before", F.lit(0))
    )
    return beyond.select(*findings.columns, "fingerprint", "moving")
