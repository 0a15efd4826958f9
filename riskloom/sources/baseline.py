"""Baselines and scan caches on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators.baseline import as_baseline

BASELINE_SCHEMA = "project STRING, scan_date STRING, findings MAP<STRING, ARRAY<STRING>>"
CACHE_SCHEMA = (
    "version STRING, rules_hash STRING, timestamp STRING, file_hashes MAP<STRING, STRING>, "
    "findings MAP<STRING, ARRAY<STRUCT<rule_id: STRING, line_number: INT, line_text: STRING, "
    "match_text: STRING>>>"
)


def read_baseline(
    spark: SparkSession, location: str, project: str, multi_line: bool = True
) -> DataFrame:
    """JSON baseline (file → fingerprints) as ``(project, path, fingerprint)``.

    A document that names its project keeps it; others get ``project``.  The one-document
    form is one value of JSON and so one task; :func:`write_baseline` writes lines.
    """
    docs = spark.read.schema(BASELINE_SCHEMA).option("multiLine", multi_line).json(location)
    files = docs.select(
        F.coalesce("project", F.lit(project)).alias("project"),
        F.explode("findings").alias("path", "fingerprints"),
    )
    return files.select("project", "path", F.explode("fingerprints").alias("fingerprint"))


def write_baseline(findings: DataFrame, location: str) -> None:
    """JSON lines that :func:`read_baseline` loads with ``multi_line=False``.

    One fingerprint per line: no file's findings are gathered anywhere.
    """
    as_baseline(findings).select(
        F.to_json(
            F.struct("project", F.create_map("path", F.array("fingerprint")).alias("findings"))
        ).alias("value")
    ).write.mode("overwrite").text(location)


def read_cache(spark: SparkSession, location: str, project: str) -> tuple[DataFrame, DataFrame]:
    """JSON scan cache of a project as two tables: file hashes and cached findings."""
    docs = spark.read.schema(CACHE_SCHEMA).option("multiLine", True).json(location)
    hashes = docs.select(
        F.lit(project).alias("project"), "rules_hash",
        F.explode("file_hashes").alias("path", "sha256"),
    )
    per_file = docs.select(F.explode("findings").alias("path", "list"))
    findings = per_file.select("path", F.explode("list").alias("f")).select(
        F.lit(project).alias("project"), "path", "f.rule_id",
        F.col("f.line_number").alias("line_no"), "f.line_text", "f.match_text",
    )
    return hashes, findings
