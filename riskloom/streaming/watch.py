"""Scanning a landing directory as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.model import FILES_SCHEMA, ScanSettings, findings_ddl
from riskloom.operators.incremental import changed_files, file_hashes
from riskloom.plans.scan import scan

CACHE_SCHEMA = "project STRING, path STRING, sha256 STRING, rules_hash STRING, scanned BOOLEAN"


def newest(table: DataFrame, *values: str) -> DataFrame:
    """The values of the last batch that had a file: a path may come back with older content."""
    return table.groupBy("project", "path").agg(
        F.max_by(F.struct(*values), "batch").alias("last")
    ).select("project", "path", "last.*")


def current_findings(spark: SparkSession, hashes_at: str, findings_at: str) -> DataFrame:
    """Findings of the last scan of every file."""
    hashes = spark.read.schema(CACHE_SCHEMA + ", batch BIGINT").parquet(hashes_at)
    last = hashes.where("scanned").groupBy("project", "path").agg(F.max("batch").alias("batch"))
    found = spark.read.schema(findings_ddl() + ", batch BIGINT").parquet(findings_at)
    return found.join(last, ["project", "path", "batch"], "left_semi").drop("batch")


def scan_batch(
    batch: DataFrame, batch_id: int, hashes_at: str, findings_at: str, rules_hash: str,
    settings: ScanSettings,
) -> None:
    """Scans the new or changed files of one batch.

    Output folders are named by batch, so a repeated batch replaces its own output.
    """
    spark = batch.sparkSession
    earlier = (
        newest(
            spark.read.schema(CACHE_SCHEMA + ", batch BIGINT").parquet(hashes_at)
            .where(F.col("batch") < batch_id), "sha256", "rules_hash",
        )
        if batch_id > 0
        else spark.createDataFrame([], CACHE_SCHEMA)
    )
    todo = changed_files(batch, earlier, rules_hash)
    scan(todo, settings).write.mode("overwrite").parquet(f"{findings_at}/batch={batch_id}")
    # Which files were scanned now: their findings replace the earlier ones.
    scanned = todo.select("project", "path", F.lit(True).alias("scanned")).distinct()
    file_hashes(batch, rules_hash).join(scanned, ["project", "path"], "left").select(
        "project", "path", "sha256", "rules_hash", F.coalesce("scanned", F.lit(False)).alias("scanned")
    ).write.mode("overwrite").parquet(
        f"{hashes_at}/batch={batch_id}"
    )


def watch(
    spark: SparkSession, landing: str, hashes_at: str, findings_at: str, checkpoint_at: str,
    rules_hash: str, settings: ScanSettings = ScanSettings(),
) -> StreamingQuery:
    """Starts a query over parquet corpus files that processes what is there, then stops."""
    files = spark.readStream.schema(FILES_SCHEMA).parquet(landing)
    return (
        files.writeStream.foreachBatch(
            lambda df, n: scan_batch(df, n, hashes_at, findings_at, rules_hash, settings)
        )
        .option("checkpointLocation", checkpoint_at)
        .trigger(availableNow=True)
        .start()
    )
