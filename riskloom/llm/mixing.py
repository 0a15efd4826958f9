"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed 60-bit hash.  A source that must give r words more than a whole number of
passes gives them from the rows below a threshold of the hash.  The threshold is found from sums
by source and hash bucket; only the bucket in which the budget ends is looked at more finely, so
rows are never sorted and a source of any size costs one aggregate with map-side sums.  Thresholds
of one source are nested: a larger budget keeps every row of a smaller one.

Defined cases: null text has size 0; null source is a source of its own, last in order; rows with
equal id and text share a hash, and where a budget ends among them as many are taken as fit best; an empty table gives no rows; more
columns (also ones named as working columns) are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.llm.shared import WORD, ranked, settled, table, text_or_empty

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
HASH_BITS, STEP_BITS = 60, 10
COARSE = HASH_BITS - STEP_BITS


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def row_hash() -> Column:
    """60 bits of the id and the whole text."""
    key = F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty())
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: int = MOST_TIMES,
    share: float = 1.0,
) -> DataFrame:
    """sizes: source, source_size.  Adds target: the words that the mix takes from the source.

    Sources by code point, null last, take the weights in turn.  All targets together are `share` of all sizes.
    A target is weight x level, at most `most_times` x size; the level rises until no target is
    above.  Each step is one aggregate of sums, and only those sums reach the driver.
    """
    order = ranked(sizes.withColumn("_null", F.col("source").isNull()), "_null", "source")
    weight = F.element_at(
        F.lit([float(w) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1
    )
    weighed = order.withColumn("weight", weight)
    most = F.col("source_size") * F.lit(float(most_times))
    level = 0.0
    while True:
        above = F.col("weight") * level > most
        total, fixed, free = weighed.agg(
            F.sum("source_size"), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if not free:
            level = float("inf")
            break
        higher = ((total or 0) * share - (fixed or 0.0)) / free
        if higher <= level:
            break
        level = higher
    target = most if level == float("inf") else F.least(F.col("weight") * level, most)
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & a[name].eqNullSafe(b[name])
    return condition


def _by_bucket(rows: DataFrame, shift: int) -> DataFrame:
    bucket = F.shiftright("hash", shift)
    return rows.groupBy("source", bucket.alias("bucket")).agg(
        F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("hash").alias("low"), F.max("hash").alias("high")
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows: source, size, hash.  budgets: source, rest.  Gives source, cut, copies, take.

    Rows with hash < cut are taken, and `take` of the `copies` rows with hash = cut, which are equal: as many as bring
    the sum nearest to the budget.
    """
    shift, inside, left, done = COARSE, rows, budgets, None
    while True:
        histogram = _by_bucket(inside, shift)
        upto = Window.partitionBy("source").orderBy("bucket")
        sums = histogram.withColumn("upto", F.sum("n").over(upto))
        ends = (
            sums.join(left, _same(sums, left, "source"))
            .drop(left["source"])
            .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
            .withColumn("rest", F.col("rest") - (F.col("upto") - F.col("n")))
        )
        ends = settled(ends)
        one = F.col("low") == F.col("high")
        take = F.floor(F.col("rest") * F.col("rows") / F.col("n") + 0.5)
        found = ends.filter(one).select(
            "source", F.col("low").alias("cut"), F.col("rows").alias("copies"), take.cast("long").alias("take")
        )
        done = found if done is None else done.unionByName(found)
        open_ends = ends.filter(~one).select("source", "bucket", "rest")
        if open_ends.isEmpty():
            return done
        at = F.shiftright("hash", shift)
        near = open_ends.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"))
        inside = settled(
            inside.join(
                near, inside["source"].eqNullSafe(near["_source"]) & (at == near["_bucket"]), "left_semi"
            )
        )
        left = open_ends.select("source", "rest")
        shift = max(0, shift - STEP_BITS)


def _planned(
    documents: DataFrame, weights: Sequence[float], most_times: int, share: float,
) -> tuple[DataFrame, DataFrame, bool]:
    """Sizes and hashes of all rows; by source and hash bucket, what the mix does with them.

    One row per source and bucket: rows of one large source find their plan by 1,024 keys.  The
    last value: whether some budget ends among equal rows.
    """
    rows = settled(
        documents.select("doc_id", "source", word_count().alias("size"), row_hash().alias("hash"))
    )
    buckets = settled(_by_bucket(rows, COARSE).select("source", "bucket", "n"))
    sizes = buckets.groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = settled(source_targets(sizes, weights, most_times, share))
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    cuts = thresholds(rows, targets.filter("rest > 0").select("source", "rest"))
    plan = targets.join(
        cuts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left"
    ).select(
        "source", "source_size", "target", "whole",
        # a single row at the end of the budget needs no counting
        F.coalesce(F.col("cut") + F.when(F.col("copies") == 1, F.col("take")).otherwise(0), F.lit(0)).alias("cut"),
        F.when(F.col("copies") > 1, F.col("cut")).alias("edge"), "take",
    )
    plan = settled(plan)
    spread = buckets.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"))
    keyed = spread.join(plan, F.col("_source").eqNullSafe(F.col("source"))).select(
        "_source", "_bucket", F.col("source_size").alias("_size"), F.col("target").alias("_target"),
        F.col("whole").alias("_whole"), F.col("cut").alias("_cut"), F.col("edge").alias("_edge"), F.col("take").alias("_take"),
    )
    return rows, keyed, not plan.filter("edge IS NOT NULL").isEmpty()


def _with_plan(rows: DataFrame, keyed: DataFrame, row_hash_: Column, among_equal: bool) -> DataFrame:
    """rows with _times: how often the mix takes the row."""
    bucket = F.shiftright(row_hash_, COARSE)
    planned = rows.withColumn("_hash", row_hash_).join(
        keyed, F.col("source").eqNullSafe(F.col("_source")) & (bucket == F.col("_bucket"))
    )
    below = planned.withColumn("_times", F.col("_whole") + (F.col("_hash") < F.col("_cut")).cast("long"))
    if not among_equal:
        return below
    on_edge = F.coalesce(F.col("_hash") == F.col("_edge"), F.lit(False))
    # Equal rows are counted inside the pieces they lie in, and the pieces are lined up: no task gets them all.
    edge = settled(below.filter(on_edge).withColumn("_part", F.spark_partition_id()))
    counts = edge.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_source", "_part").orderBy("_hash")
    numbered = edge.withColumn("_at", F.row_number().over(inside)).join(
        before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))
    )
    taken = numbered.withColumn("_times", F.col("_times") + (F.col("_at") + F.col("_before") <= F.col("_take")).cast("long"))
    return below.filter(~on_edge).unionByName(taken.select(*below.columns))


def mix(
    documents: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: int = MOST_TIMES,
    share: float = 1.0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for every document.

    times: how often the mix takes the document; taken = times x size.
    """
    rows, keyed, among_equal = _planned(documents, weights, most_times, share)
    return _with_plan(rows, keyed, F.col("hash"), among_equal).select(
        "doc_id", "source", "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_times").alias("times"), (F.col("_times") * F.col("size")).alias("taken"),
    )


def mixed_documents(
    documents: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: int = MOST_TIMES,
    share: float = 1.0,
) -> DataFrame:
    """The documents of the mix, all columns; a document taken twice is there twice."""
    _, keyed, among_equal = _planned(documents, weights, most_times, share)
    planned = _with_plan(documents, keyed, row_hash(), among_equal)
    return planned.filter("_times > 0").withColumn(
        "_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))
    ).select(*documents.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(1) || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS pos FROM s
), l AS (
  SELECT o.pos, ((SELECT sum(source_size) FROM s)::DOUBLE
      - coalesce((SELECT sum(3.0::DOUBLE * p.source_size) FROM o p WHERE p.pos < o.pos), 0))
      / (SELECT sum(p.weight) FROM o p WHERE p.pos >= o.pos) AS level,
    3.0::DOUBLE * source_size / weight AS full_at
  FROM o
), level AS (SELECT level FROM l WHERE level <= full_at ORDER BY pos LIMIT 1
), t AS (
  SELECT source, source_size,
    least(weight::DOUBLE * coalesce((SELECT level FROM level), 1e300), 3.0::DOUBLE * source_size) AS target FROM s
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), h AS (
  SELECT source, hash, sum(size) AS n, count(*) AS copies FROM d GROUP BY source, hash
), c AS (
  SELECT h.source, h.hash, n, copies, target - whole * source_size AS rest,
    sum(n) OVER (PARTITION BY h.source ORDER BY h.hash) AS upto
  FROM h JOIN w ON h.source IS NOT DISTINCT FROM w.source
), cut AS (
  SELECT source, hash AS cut, floor((rest - (upto - n)) * copies / n + 0.5) AS take
  FROM c WHERE rest > 0 AND upto > rest AND upto - n <= rest
)
SELECT d.doc_id, d.size, w.source_size, w.target,
  d.size * (w.whole + CASE WHEN d.hash < cut.cut OR (d.hash = cut.cut AND d.at_hash <= cut.take) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY source, hash) AS at_hash FROM d) d JOIN w ON d.source IS NOT DISTINCT FROM w.source
LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""
