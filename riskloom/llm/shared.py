"""What several operators share: tables, word pattern, cut lineage, global ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"  # fixed value
GAP = r"[\x20\x09-\x0D]+"
#: `monotonically_increasing_id` keeps the position inside a partition in its low bits.
IN_PARTITION = (1 << 33) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset (tests)."""
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: survives lost executors, computed once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ranked(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """Adds the position (from 0) in the global order, without a window over all rows.

    Rows are dealt by range and sorted there; only one count per partition reaches the driver.
    Equal rows get neighbouring ranks in any order.
    """
    dealt = settled(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)))
    )
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    starts, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    base = F.element_at(F.lit(starts or [0]), F.col("_part") + 1)
    return dealt.withColumn(name, (base + F.col("_at")).cast("long")).drop("_part", "_at")


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a compressed table in the shared folder: for wide rows read more than once."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: At most so many keys hold a ten-thousandth of all weight each: a proven bound for a broadcast.
HOT_KEYS = 10_000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """big LEFT JOIN small, without a task that gets all rows of one key.

    small has one row a key; `weight` bounds the rows of big with that key (up to a factor), and all weights sum
    to `total` at most.  Keys of a ten-thousandth of the total or more, 10,000 at most, are broadcast;
    rows that they serve are spread over the join with the rest, where no key is large.
    """
    values = [c for c in small.columns if c not in on]
    is_hot = F.col(weight) * F.lit(HOT_KEYS) >= F.lit(total)
    hot = small.where(is_hot).select(
        *[F.col(c).alias(f"_hot_{c}") for c in on], F.struct(*values).alias("_hot_values")
    )
    cold = small.where(~is_hot).select(
        *[F.col(c).alias(f"_cold_{c}") for c in on], F.lit(0).alias("_cold_salt"),
        F.struct(*values).alias("_cold_values"),
    )
    every = lambda side: [F.col(c) == F.col(f"_{side}_{c}") for c in on]
    served = F.col("_hot_values").isNotNull()
    salt = F.when(served, 1 + F.pmod(F.xxhash64(*big.columns), F.lit(4096)).cast("int")).otherwise(0)
    joined = (
        big.join(F.broadcast(hot), every("hot"), "left")
        .withColumn("_salt", salt)
        .join(cold, [*every("cold"), F.col("_salt") == F.col("_cold_salt")], "left")
    )
    value = F.when(served, F.col("_hot_values")).otherwise(F.col("_cold_values"))
    return joined.select(*[F.col(c) for c in big.columns], *[value[c].alias(c) for c in values])


def with_row_id(rows: DataFrame) -> DataFrame:
    """A table read from files, with `_file` and `_row`: where a row lies, the same in every read."""
    at = F.col("_metadata")
    return rows.select("*", F.xxhash64(at["file_path"]).alias("_file"), at["row_index"].alias("_row"))
