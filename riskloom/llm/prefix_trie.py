"""Trie of conversation prefixes, rolled up by centroid decomposition.

Each distinct sequence of first d turns is a node.  A turn is two 60-bit digests; the key of a prefix is the
XOR of its turns' digests mixed with their depth, so keys of all prefixes come from running XORs inside
pieces of the sorted turns, the parent's key is one XOR away, and a conversation of any length is dealt to many tasks.

Sums over subtrees come from the forest of parent edges.  The weight of a node's subtree is known from the turns
below it (each member adds its turns from there on).  A component is split at its centroid, the deepest node
with over half of the weight; exactly the nodes above it with over half are the path from centroid to top.
The total of the centroid's side is added to those, the centroid is done, and the subtrees of
its children and the rest above are components of at most half the weight.  Which child a node
lies under is one lookup: the node at the depth below the centroid on the path of the node's smallest member.
Components of at most `local_nodes` nodes are summed in one streaming pass, children before parents.

Defined cases: rows of a null conv_id take no part; null role or text is empty; order is by turn (null
first), then role, then a digest of role and text; repeated rows are turns of their own; an empty table gives no
rows, not even the root; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.llm.shared import IN_PARTITION, hot_join, settled, stored, table

BLOCK, SPREAD = 100, 6
LOCAL_NODES = 4096
PIECE_IDS = 4096
KEY, PARENT, TOP = ["k1", "k2"], ["p1", "p2"], ["c1", "c2"]


def _lane(at: int) -> Column:
    return F.conv(F.substring("md5", at, 15), 16, 10).cast("long")


def _tags(depth: Column) -> list[Column]:
    return [F.xxhash64(depth, "a", "b").alias("t1"), F.xxhash64(depth, "b", "a").alias("t2")]


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, a, b, chars, _part, _at: turns without their texts, in order over all partitions."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("md5"),
        F.length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "md5"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return settled(
        dealt.select(
            "conv_id", _lane(1).alias("a"), _lane(17).alias("b"), "chars", F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)).alias("_at"),
        )
    )


def _pieces(turns: DataFrame) -> DataFrame:
    """A row per conversation and partition: first place there, turns before it, turns in all."""
    counted = turns.groupBy("conv_id", "_part").agg(F.min("_at").alias("first"), F.count("*").alias("here"))
    conv = Window.partitionBy("conv_id")
    before = conv.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return settled(
        counted.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
        .withColumn("total", F.sum("here").over(conv))
        .withColumn("parts", F.count("*").over(conv))
    )


def members(conversations: DataFrame, block: int | None = None, spread: int = SPREAD) -> DataFrame:
    """conv_id, depth, turns (of the whole conversation), chars, and keys of the prefix and of its parent.

    With `block`, a conversation's first h = crc32(id) % spread turns come from the first conversation of
    its block of ids.  Turnless conversations have one row of depth null.
    """
    turns = sorted_turns(conversations)
    pieces = _pieces(turns)
    place = F.col("before") + F.col("_at") - F.col("first") + 1
    head = (F.crc32(F.col("conv_id").cast("string")) % spread if block else F.lit(0)).cast("int")
    convs = pieces.where("before = 0").select("conv_id", "total", head.alias("h"))
    if block:
        convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
        tops = (
            turns.where(F.col("conv_id") % block == 0)
            .join(pieces.where(F.col("before") < spread), ["conv_id", "_part"])
            .withColumn("depth", place).where(F.col("depth") < spread)
            .select(F.col("conv_id").alias("base"), "depth", "chars", *_tags(F.col("depth")))
        )
        heads = tops.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("depth", "t1", "t2", "chars"))).alias("top"))
        convs = convs.join(heads, "base", "left").withColumn(
            "top", F.when(F.col("h") > 0, F.slice("top", F.lit(1), F.col("h")))
        ).drop("base")
    else:
        convs = convs.withColumn("top", F.lit(None).cast("array<struct<depth: long, t1: long, t2: long, chars: long>>"))
    top = F.coalesce("top", F.array().cast("array<struct<depth: long, t1: long, t2: long, chars: long>>"))
    xor = lambda array, lane: F.aggregate(
        array, F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(t[lane])
    )
    convs = settled(
        convs.withColumn("top", top).withColumn("m", F.size("top"))
        .withColumn("turns", F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
        .withColumn("x1", xor(F.col("top"), "t1")).withColumn("x2", xor(F.col("top"), "t2"))
    )
    prefix = lambda lane: xor(F.slice("top", F.lit(1), F.col("t.depth").cast("int")), lane)
    shared = convs.where("m > 0").select("conv_id", "turns", "top", F.explode("top").alias("t")).select(
        "conv_id", "t.depth", "turns", "t.chars", prefix("t1").alias("k1"), prefix("t2").alias("k2"), "t.t1", "t.t2"
    )
    plan = pieces.select("conv_id", "_part", "first", "before", "parts").join(
        convs.select("conv_id", "h", "m", "turns", "x1", "x2"), "conv_id"
    )
    own = (
        turns.join(plan, ["conv_id", "_part"]).withColumn("place", place).where(F.col("place") > F.col("h"))
        .withColumn("depth", F.col("m") + F.col("place") - F.col("h")).select("*", *_tags(F.col("depth")))
    )
    here = Window.partitionBy("conv_id", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("y1", F.bit_xor("t1").over(here)).withColumn("y2", F.bit_xor("t2").over(here))
    own = settled(own.select("conv_id", "_part", "depth", "turns", "chars", "parts", "x1", "x2", "y1", "y2", "t1", "t2"))
    # conversations over several partitions: at most two a partition, so few rows
    ends = own.where("parts > 1").groupBy("conv_id", "_part").agg(
        F.bit_xor("t1").alias("e1"), F.bit_xor("t2").alias("e2")
    )
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "conv_id", "_part", F.bit_xor("e1").over(earlier).alias("z1"), F.bit_xor("e2").over(earlier).alias("z2")
    )
    own = own.join(carried, ["conv_id", "_part"], "left").select(
        "conv_id", "depth", "turns", "chars",
        *[
            F.col(f"x{n}").bitwiseXOR(F.col(f"y{n}")).bitwiseXOR(F.coalesce(f"z{n}", F.lit(0).cast("long"))).alias(f"k{n}")
            for n in (1, 2)
        ],
        "t1", "t2",
    )
    none = F.lit(None).cast("long")
    turnless = convs.where("turns = 0").select(
        "conv_id", none.alias("depth"), F.lit(0).cast("long").alias("turns"), F.lit(0).cast("long").alias("chars"),
        *[F.lit(0).cast("long").alias(c) for c in KEY], none.alias("t1"), none.alias("t2"),
    )
    rows = own.unionByName(shared).unionByName(turnless)
    return settled(
        rows.select(
            "conv_id", F.col("depth").cast("long").alias("depth"), F.col("turns").cast("long").alias("turns"), "chars",
            *KEY, F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"),
        )
    )


def nodes_of(rows: DataFrame) -> DataFrame:
    """rows: members.  A row a node: key, parent's key, conv_id (smallest), depth, n_convs, chars, weight, n_children.

    Everything is summed before the shuffle, so a prefix that a third of all conversations share is one row a task.
    """
    inner = rows.where("depth IS NOT NULL").groupBy(*KEY, "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    whole = rows.where("depth = 1 OR depth IS NULL")  # one row a conversation
    root = whole.agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("turns") + 1).alias("weight")
    ).where("n_convs > 0").select(
        *[zero.alias(c) for c in KEY], zero.alias("depth"), "conv_id", "n_convs", zero.alias("chars"), "weight",
        none.alias("p1"), none.alias("p2"),
    )
    every = inner.unionByName(root)
    children = inner.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    return settled(
        every.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    )


# -- rollup ------------------------------------------------------------------------

_SUM_TYPE = "k1 long, k2 long, sum_1 long, sum_2 long"
_SUM_ARROW = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "sum_1", "sum_2")])


def _small_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by component, deepest first: each node hands its sums to its parent."""
    top, held = None, {}
    for batch in batches:
        out = [[], [], [], []]
        columns = [batch[c].to_pylist() for c in ("c1", "c2", "k1", "k2", "p1", "p2", "v1", "v2", "d1", "d2")]
        for c1, c2, k1, k2, p1, p2, v1, v2, d1, d2 in zip(*columns):
            if (c1, c2) != top:
                top, held = (c1, c2), {}
            h1, h2 = held.pop((k1, k2), (0, 0))
            # d: what was added from parts cut off below; these count for the nodes above already
            h1, h2 = h1 + v1, h2 + v2
            for column, value in zip(out, (k1, k2, h1 + d1, h2 + d2)):
                column.append(value)
            if p1 is not None:
                up = held.get((p1, p2), (0, 0))
                held[(p1, p2)] = (up[0] + h1, up[1] + h2)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_SUM_ARROW)


def subtree_sums(nodes: DataFrame, rows: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """k1, k2, sum_1, sum_2: sums of v1 and v2 over each node's subtree, its top included.

    nodes: key, parent's key, conv_id, depth, weight, v1, v2.  rows: members, to look up nodes on paths.
    Rounds end in written tables: a checkpoint would carry the growing constraints of all joins before.
    """
    zero = F.lit(0).cast("long")
    state = nodes.select(
        *KEY, *PARENT, "conv_id", "depth", "weight", "v1", "v2", zero.alias("d1"), zero.alias("d2"),
        zero.alias("c1"), zero.alias("c2"),
    )
    paths = rows.where("depth IS NOT NULL").select(
        F.col("conv_id").alias("_m"), F.col("depth").alias("_depth"), *[F.col(c).alias(f"_{c}") for c in KEY + PARENT]
    )
    done = []
    while True:
        sizes = stored(state.groupBy(*TOP).agg(F.count("*").alias("nodes"), F.max("weight").alias("whole")))
        total = sizes.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
        large = sizes.where(F.col("nodes") > local_nodes)
        if large.isEmpty():
            break
        marked = stored(hot_join(state, large, TOP, "nodes", total))
        done.append(marked.where("nodes IS NULL").select(*state.columns))
        marked = marked.where("nodes IS NOT NULL")
        heavy = F.col("weight") * 2 > F.col("whole")
        cuts = stored(
            marked.where(heavy).groupBy(*TOP).agg(
                F.max_by(F.struct("k1", "k2", "depth", "weight"), "depth").alias("cut"), F.max("nodes").alias("nodes")
            )
        )
        cut = hot_join(marked.drop("nodes"), cuts, TOP, "nodes", total)
        cut = stored(cut.withColumn("path", heavy))
        # chains: nodes of one smallest member in one component
        chains = cut.where("NOT path").groupBy(*TOP, "conv_id").agg(
            F.count("*").alias("length"), F.first("cut").alias("cut")
        )
        below = chains.join(
            paths,
            (F.col("conv_id") == F.col("_m")) & (F.col("cut.depth") + 1 == F.col("_depth"))
            & (F.col("_p1") == F.col("cut.k1")) & (F.col("_p2") == F.col("cut.k2")),
        ).select(*TOP, "conv_id", "length", F.col("_k1").alias("n1"), F.col("_k2").alias("n2"))
        dealt = hot_join(cut, stored(below), [*TOP, "conv_id"], "length", total)
        centre = (F.col("k1") == F.col("cut.k1")) & (F.col("k2") == F.col("cut.k2"))
        under = F.col("n1").isNotNull() & ~F.col("path") & (F.col("depth") > F.col("cut.depth"))
        dealt = stored(dealt.withColumn("centre", centre).withColumn("under", under))
        sides = stored(
            dealt.where("centre OR under").groupBy(*TOP).agg(
                F.sum("v1").alias("s1"), F.sum("v2").alias("s2"), F.max("nodes").alias("_nodes")
            )
        )
        added = hot_join(dealt, sides, TOP, "_nodes", total)
        above = F.col("path") & ~F.col("centre")
        more = lambda n: F.when(F.col("path"), F.col(f"s{n}")).otherwise(0)
        moved = stored(
            added.select(
                *KEY, *PARENT, "conv_id", "depth",
                F.when(above, F.col("weight") - F.col("cut.weight")).otherwise(F.col("weight")).alias("weight"),
                "v1", "v2", (F.col("d1") + more(1)).alias("d1"), (F.col("d2") + more(2)).alias("d2"),
                F.when(F.col("under"), F.col("n1")).otherwise(F.col("c1")).alias("c1"),
                F.when(F.col("under"), F.col("n2")).otherwise(F.col("c2")).alias("c2"), "centre",
            )
        )
        # a centroid is a component of its own now, and its sum is whole: its side was added to d
        done.append(
            moved.where("centre").select(
                *[
                    {"v1": zero, "v2": zero, "c1": F.col("k1"), "c2": F.col("k2")}.get(c, F.col(c)).alias(c)
                    for c in state.columns
                ]
            )
        )
        state = moved.where("NOT centre").select(*state.columns)
    for part in done:
        state = state.unionByName(part)
    dealt = state.repartition(*TOP).sortWithinPartitions(*TOP, F.desc("depth"))
    return dealt.mapInArrow(_small_components, _SUM_TYPE)


# -- members that end at a node ----------------------------------------------------


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id) to comma-joined pieces of bounded size."""
    key, ids = None, []
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def out(rows):
        return pa.RecordBatch.from_pylist(
            [{"k1": k[0], "k2": k[1], "first": i[0], "ids": ",".join(map(str, i))} for k, i in rows], schema=schema
        )

    for batch in batches:
        rows = []
        for k1, k2, conv in zip(*[batch[c].to_pylist() for c in ("k1", "k2", "conv_id")]):
            if ids and (key != (k1, k2) or len(ids) == PIECE_IDS):
                rows.append((key, ids))
                ids = []
            key = (k1, k2)
            ids.append(conv)
        yield out(rows)
    if ids:
        yield out([(key, ids)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by node and first id to one digest a node, piece by piece."""
    key, digest = None, None
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def out(rows):
        return pa.RecordBatch.from_pylist(
            [{"k1": k[0], "k2": k[1], "ends_sha256": d.hexdigest()} for k, d in rows], schema=schema
        )

    for batch in batches:
        rows = []
        for k1, k2, ids in zip(*[batch[c].to_pylist() for c in ("k1", "k2", "ids")]):
            if key == (k1, k2):
                digest.update(b"," + ids.encode())
            else:
                if key is not None:
                    rows.append((key, digest))
                key, digest = (k1, k2), hashlib.sha256(ids.encode())
        yield out(rows)
    if key is not None:
        yield out([(key, digest)])


def end_digests(rows: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of nodes at which conversations end.

    SHA-256 has no parts to combine, so the pieces of one node go through one task, in order; what is
    held there is one piece.
    """
    ends = rows.where("depth IS NULL OR depth = turns").select(*KEY, "conv_id")
    dealt = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = dealt.mapInArrow(_id_pieces, "k1 long, k2 long, first long, ids string")
    grouped = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return grouped.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame, block: int | None = None, spread: int = SPREAD, local_nodes: int = LOCAL_NODES
) -> DataFrame:
    """A row per node; see the contract of the query for the columns."""
    rows = members(conversations, block, spread)
    nodes = nodes_of(rows)
    valued = nodes.withColumn("v1", (F.col("n_children") == 0).cast("long")).withColumn(
        "v2", (F.col("n_convs") - 1) * F.col("chars")
    )
    sums = subtree_sums(valued, rows, local_nodes)
    parents = nodes.where("n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    total = nodes.count()
    placed = hot_join(nodes.drop("n_children", "weight", "chars"), parents.withColumnRenamed("n_children", "_n"), PARENT, "_n", total)
    empty = hashlib.sha256(b"").hexdigest()
    return (
        placed.join(nodes.select(*KEY, "n_children"), KEY)
        .join(sums, KEY).join(end_digests(rows), KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_1").alias("n_leaves"),
            F.col("sum_2").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), block=BLOCK)


OP11_SQL = r"""
WITH bytes AS (
  SELECT DISTINCT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)) AS b
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda x, y: list_reduce(
    list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END)), 4294967295::BIGINT) % 6 AS h
  FROM bytes
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
    md5(len(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), o AS (
  SELECT conv_id, text, row_number() OVER w AS depth,
    md5(len(role)::VARCHAR || ':' || role || text) AS turn_key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
), p AS (
  SELECT conv_id, depth, md5(string_agg(turn_key, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key,
    len(text) AS chars, count(*) OVER (PARTITION BY conv_id) AS turns FROM o
  UNION ALL SELECT conv_id, 0, '', 0, (SELECT count(*) FROM o WHERE o.conv_id = crc.conv_id) FROM crc
), n AS (
  SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = turns), '')) AS ends_sha256
  FROM p GROUP BY key
), e AS (
  SELECT n.key, q.key AS parent FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1
), k AS (SELECT parent AS key, count(*) AS n_children FROM e GROUP BY parent
), s AS (
  SELECT a.key, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
    sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM n JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN k ON k.key = n.key GROUP BY a.key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.key = n.key LEFT JOIN k ON k.key = n.key
LEFT JOIN e ON e.key = n.key LEFT JOIN n u ON u.key = e.parent
"""
