"""Lines that many documents share, found with levelled sorted runs of line hashes.

A line's key is the line stripped and with A-Z lowered; its 128-bit hash stands for it.  A run is a
table of (hash, documents), bucketed and sorted by hash, so runs are merged and anti-joined bucket by
bucket without a shuffle.  Documents come in batches.  The keys of a batch are anti-joined with
the keys that a run already holds often enough (these are decided), and the rest becomes a run of level 0; as soon as a
level has `fan` runs they are merged into one of the next level.  `LineRuns` keeps this state between batches; its
folder is the shared one.

Defined cases: null text is empty; empty text is one empty line, kept if keys need a character; every
row is a document of its own, so repeated rows count each; a key counts once per document; a document that loses
all lines has the empty text; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions.plan import computed_once
from riskloom.llm.shared import (
    hot_join, settled, shared_folder, stored, table, text_or_empty, with_row_id,
)

BLANK = " \t\n\x0b\x0c\r"  # fixed value: stripped from both ends
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS, LEAST_CHARS = 10, 1
BATCHES, FAN = 6, 3


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _hashes(text: str, least_chars: int) -> Column:
    """Per line the hash of its key, '' for keys that are too short."""
    lines = F.split(text_or_empty(text), "\n", -1)
    return F.transform(
        F.transform(lines, line_key),
        lambda k: F.when(F.length(k) >= least_chars, F.md5(k)).otherwise(F.lit("")),
    )


class LineRuns:
    """Runs of (hash, n) in levels; n: documents with the line."""

    def __init__(self, spark: SparkSession, least_documents: int = LEAST_DOCUMENTS, fan: int = FAN):
        self.spark, self.least, self.fan = spark, least_documents, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _run(self, rows: DataFrame) -> str:
        """Writes a run.  Rows are dealt by the hash that the buckets use: one file a bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select("hash", "n").repartition(self.buckets, "hash")
        dealt.write.bucketBy(self.buckets, "hash").sortBy("hash").option(
            "path", f"{shared_folder(self.spark)}/{name}"
        ).saveAsTable(name)
        return name

    def _tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """keys: hash and more.  Those that no run holds."""
        for run in self._tables():
            keys = keys.join(run.select("hash"), "hash", "left_anti")
        return keys

    def add(self, counted: DataFrame) -> None:
        """counted: hash, n of one batch, a row a hash."""
        for run in self._tables():
            decided = run.where(F.col("n") >= self.least).select("hash")
            counted = counted.join(decided, "hash", "left_anti")
        self._push(0, self._run(counted))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan:
            full, self.levels[level] = self.levels[level], []
            merged = self._run(self._merged(full))
            for old in full:
                self.spark.sql(f"DROP TABLE {old}")  # the files stay until the folder goes
            self._push(level + 1, merged)

    def _merged(self, names: list[str]) -> DataFrame:
        """Full outer joins of sorted runs, bucket by bucket."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select("hash", F.col("n").alias("_n"))
            rows = rows.join(more, "hash", "full_outer").select(
                "hash", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n")
            )
        return rows

    def frequent(self) -> DataFrame:
        """hash, n of lines in at least `least` documents (n may miss documents past that number)."""
        names = [name for level in self.levels for name in level]
        if not names:
            return self.spark.createDataFrame([], "hash string, n long")
        return self._merged(names).where(F.col("n") >= self.least)


def _document_counts(documents: DataFrame, least_chars: int, batches: int) -> DataFrame:
    """batch, hash, n: one pass over the texts, counts combined before they are shuffled."""
    keys = documents.select(
        F.pmod(F.xxhash64("_file", "_row"), F.lit(batches)).alias("batch"),
        F.explode_outer(F.array_distinct(_hashes("text", least_chars))).alias("hash"),
    )
    counted = keys.where("hash <> ''").groupBy("batch", "hash").agg(F.count("*").alias("n"))
    return stored(counted)


def without_repeated_lines(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS,
    batches: int = BATCHES, fan: int = FAN,
) -> DataFrame:
    """doc_id, text (lines found in `least_documents` documents are gone), n_lines, n_dropped.

    `documents` may carry `_file` and `_row` (see `with_row_id`); without them a numbered copy is written.
    """
    documents = documents.select("doc_id", "text", *[c for c in ("_file", "_row") if c in documents.columns])
    if "_row" not in documents.columns:
        documents = stored(
            documents.select("*", F.lit(0).cast("long").alias("_file"), F.monotonically_increasing_id().alias("_row"))
        )
    runs = LineRuns(documents.sparkSession, least_documents, fan)
    counted = _document_counts(documents, least_chars, batches)
    for batch in range(batches):
        runs.add(counted.where(F.col("batch") == batch))
    frequent = settled(runs.frequent())
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # n may stop short of all documents with a line; the whole number decides what is spread
    numbers = counted.join(frequent.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.sum("n").alias("n"))
    lines = documents.select(
        "_file", "_row", F.posexplode_outer(_hashes("text", least_chars)).alias("at", "hash")
    ).where("hash <> ''")
    hits = (
        hot_join(lines, settled(numbers), ["hash"], "n", total).where("n IS NOT NULL")
        .groupBy("_file", "_row").agg(F.collect_list("at").alias("_gone"))
        .select(F.col("_file").alias("_f"), F.col("_row").alias("_r"), "_gone")
    )
    joined = documents.join(hits, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r")), "left")
    split = computed_once(joined, _lines=F.split(text_or_empty(), "\n", -1))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    left = F.transform(F.array_except(every, gone), lambda at: F.get("_lines", at))
    kept = F.when(F.col("_gone").isNull(), text_or_empty()).otherwise(F.array_join(left, "\n"))
    return split.select(
        "doc_id", kept.alias("text"), F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = with_row_id(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return without_repeated_lines(documents).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS at_row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT at_row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT at_row) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY at_row
"""
