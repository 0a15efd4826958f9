"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected by several random rotations to a few axes, shifted, put on a grid and
ordered along a Hilbert curve.  Spark range-partitions each ordering and numbers its rows; rows are
then dealt out in blocks of neighbouring ranks.  A query looks at the window of ranks around it in
every ordering, measures each candidate exactly on the original vectors, and the windows' best are
merged and ranked again.

Projections are random and need no fitting but for a scale: the mean and spread of the components,
computed over all rows.  How far a window reaches is measured, not guessed: `TRIAL_QUERIES` points
are searched by brute force over all rows in blocks, and the reach is the rank distance within
which `TARGET_RECALL` of their true neighbours stand in the best ordering.  So recall holds at every
size; a window grows with the table only if the data have no structure that a curve can keep.

Equal vectors are one point with the smallest k + 1 ids (no more can be among the nearest k), so
groups of copies of any size cost one point.  Blocks bound what one task holds.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no
part, as query or candidate; vectors are compared with those of the same length only; ties go to
the smaller id; of rows with the same id and vector one counts; rows without an id take no part;
an empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.llm.shared import ranked, settled, table

NEAREST = 10
ORDERINGS, AXES, GRID_BITS = 12, 6, 8
BLOCK = 4096
LEAST_REACH = 64  # ranks on each side
TRIAL_QUERIES, TARGET_RECALL = 100, 0.97
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (n x axes); axes x bits is at most 62.

    Skilling's transform from coordinates to the transposed index, for all rows at once.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(axes):
            high = (x[i] & step) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        step >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    fold = np.zeros(x.shape[1], np.int64)
    step = 1 << (bits - 1)
    while step > 1:
        fold ^= np.where((x[axes - 1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= fold
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _axes_of(size: int) -> np.ndarray:
    """Random orthonormal axes: orderings x size x axes."""
    random = np.random.default_rng(SEED + size)
    axes = min(AXES, size)
    return np.stack([np.linalg.qr(random.normal(size=(size, axes)))[0] for _ in range(ORDERINGS)])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (double) of the rows that take part."""
    return vectors.filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    ).select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("vector"))


def _point() -> Column:
    return F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","))


def distinct_points(vectors: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """point (a hash of the vector), vector, ids: the smallest nearest + 1 ids, ascending."""
    by_point = Window.partitionBy("point").orderBy("vec_id")
    few = (
        usable(vectors).withColumn("point", _point()).withColumn("n", F.dense_rank().over(by_point))
        .filter(F.col("n") <= nearest + 1)
    )
    return few.groupBy("point").agg(
        F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector")
    )


def _scaled(points: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and spread of the vectors' components by length: sums over all rows."""
    stats = {}
    by_place = points.select(F.size("vector").alias("size"), F.posexplode("vector").alias("place", "x"))
    for row in by_place.groupBy("size").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")).collect():
        stats[row["size"]] = (row["mean"], row["spread"] or 1.0)
    return stats


def ordered(points: DataFrame) -> DataFrame:
    """point, size, ordering, rank: the rank of every point in every ordering, from 0."""
    stats = _scaled(points)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, group in batch.groupby(batch["vector"].map(len)):
                x = np.stack(group["vector"].to_list())
                mean, spread = stats[size]
                random = np.random.default_rng(SEED)
                for number, axes in enumerate(_axes_of(size)):
                    # Shifts move the borders of the grid; a grid cell is 1/32 of the spread.
                    shift = random.uniform(0, 1, axes.shape[1])
                    at = ((x - mean) @ axes) / spread * 24 + (1 << (GRID_BITS - 1)) + shift
                    cells = np.clip(np.floor(at), 0, (1 << GRID_BITS) - 1)
                    yield pd.DataFrame(
                        {"point": group["point"], "size": size, "ordering": number,
                         "key": hilbert_keys(cells, GRID_BITS)}
                    )

    keys = points.select("point", "vector").mapInPandas(run, "point string, size int, ordering int, key long")
    all_ranks = ranked(keys, "size", "ordering", "key", "point")
    first = all_ranks.groupBy("size", "ordering").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    return all_ranks.join(F.broadcast(first), ["size", "ordering"]).select(
        "point", "size", "ordering", (F.col("rank") - F.col("first")).alias("rank"), "n"
    )  # `first` has one row per vector length and ordering


def _search(nearest: int, reach: int):
    def search(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank", kind="stable")
        own = block[~block["asks"]]
        vectors = np.stack(own["vector"].to_list()) if len(own) else np.zeros((0, 1))
        ranks, names = own["rank"].to_numpy(), own["point"].to_numpy()
        least = own["least"].to_numpy()
        out = []
        for rank, name, vector in block.loc[block["asks"], ["rank", "point", "vector"]].itertuples(index=False):
            a, b = np.searchsorted(ranks, [rank - reach, rank + reach + 1])
            if a == b:
                continue
            far = np.sqrt(((vectors[a:b] - vector) ** 2).sum(axis=1))
            best = np.lexsort((least[a:b], far))[: nearest + 1]
            out.append(pd.DataFrame({"query": name, "point": names[a:b][best], "score": far[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "point": [], "score": []})

    return search


def measured_reach(points: DataFrame, ranks: DataFrame, nearest: int, recall: float = TARGET_RECALL) -> int:
    """The rank distance that keeps `recall` of the true neighbours of some trial points."""
    trial = [
        (r["point"], np.array(r["vector"]))
        for r in points.orderBy(F.xxhash64("point"), "point").limit(TRIAL_QUERIES).collect()
    ]

    def nearest_in_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["vector"].map(len)
            for name, vector in trial:
                own = batch[(sizes == len(vector)) & (batch["point"] != name)]
                if len(own):
                    far = ((np.stack(own["vector"].to_list()) - vector) ** 2).sum(axis=1)
                    best = np.argsort(far, kind="stable")[:nearest]
                    yield pd.DataFrame(
                        {"query": name, "point": own["point"].to_numpy()[best], "far": far[best]}
                    )

    close = points.select("point", "vector").mapInPandas(nearest_in_block, "query string, point string, far double")
    best = Window.partitionBy("query").orderBy("far", "point")
    close = close.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= nearest)
    asked = F.broadcast(settled(close.select("query", "point")))  # TRIAL_QUERIES x nearest rows
    there = asked.join(ranks.select("point", "ordering", "rank"), "point")
    own = ranks.select(F.col("point").alias("query"), "ordering", F.col("rank").alias("own"))
    own = own.join(asked.select("query").distinct(), "query", "left_semi")
    gaps = (
        there.join(own, ["query", "ordering"]).groupBy("query", "point")
        .agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("gap"))
    )
    far = [r["gap"] for r in gaps.collect()]
    return max(LEAST_REACH, int(np.quantile(far, recall)) + 1) if far else LEAST_REACH


def neighbours(
    vectors: DataFrame, asks: Column, nearest: int = NEAREST, reach: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of `vectors` (vec_id, embedding) where `asks`.

    asks: a condition on vec_id.  reach: ranks on each side of a query, measured if not given.
    """
    points = settled(distinct_points(vectors.select("vec_id", "embedding"), nearest))
    queries = settled(
        usable(vectors.filter(asks)).select(F.col("vec_id").alias("query_id"), _point().alias("query")).distinct()
    )
    asked = queries.select(F.col("query").alias("point"), F.lit(True).alias("asked")).distinct()
    ranks = settled(ordered(points))
    if reach is None:
        reach = measured_reach(points, ranks, nearest)
    placed = ranks.join(points.withColumn("least", F.col("ids")[0]).drop("ids"), "point")
    placed = placed.join(asked, "point", "left").withColumn("block", F.floor(F.col("rank") / block))
    home = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("asks")))
    around = F.transform(
        F.sequence(
            F.greatest(F.lit(0), F.floor((F.col("rank") - reach) / block)),
            F.floor(F.least(F.col("rank") + reach, F.col("n") - 1) / block),
        ),
        lambda b: F.struct(b.alias("block"), F.lit(True).alias("asks")),
    )
    dealt = placed.select(
        "point", "vector", "least", "size", "ordering", "rank",
        F.inline(F.when(F.col("asked"), F.concat(home, around)).otherwise(home)),
    )
    near = dealt.groupBy("size", "ordering", "block").applyInPandas(
        _search(nearest, reach), "query string, point string, score double"
    )
    # The nearest points of a query, then their ids; both are bounded by nearest + 1.
    found = near.distinct().join(points.select("point", "ids"), "point")
    by_query = Window.partitionBy("query").orderBy("score", F.col("ids")[0])
    found = found.withColumn("n", F.row_number().over(by_query)).filter(F.col("n") <= nearest + 1)
    pairs = found.select("query", "score", F.explode("ids").alias("vec_id")).join(queries, "query")
    by_row = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        pairs.filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(by_row)).filter(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
