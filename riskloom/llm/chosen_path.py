"""Jaccard self-join of word five-grams by chosen paths.

Every run samples tokens by a hash of run and token; a set chooses a token if the hash is below
1 / (similarity x size), so a set chooses 1.25 tokens and two sets of the wanted similarity share one
choice on average.  Sets that chose the same token are a bucket.  A large bucket is split again in the
same way, on tokens sampled for its path (the least under random orders, kept as minhash bytes), unless its sets are alike already; what is still large
then is compared in pairs of blocks.  Runs are repeated until the chance that a pair at the threshold
never meets is below 1 - recall.

A pair is looked at in the smallest of the buckets that both of its sets are in, so nothing is counted
twice and no pair is ever emitted: a bucket gives link counts of its sets and a spanning forest.  A first
look at sizes and minhash bytes decides which sets have anything to compare; only those fetch
their tokens, and each link is decided on the whole token sets.

Texts of equal words are one set, so groups of copies cost one row each.  Classes are the
connected components of the forests, found by minimum labels with pointer jumping.

Defined cases: null or wordless texts are alone (no links, class of their own id); a text of one to four
words is one token; repeated rows and copies share class and links; a null id takes the class of its
text; an empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.rolling import mixed, powers, prefix_sums
from riskloom.llm.shared import GAP, settled, stored, table, text_or_empty

WORDS, SIMILARITY, RECALL = 5, 0.8, 1 - 1e-5
SKETCH = 64  # minhash bytes
UNLIKE = 1e-11  # chance that the first look drops a pair at the threshold
LARGE, BLOCK, DEPTH = 3_000, 1_500, 3
UNSPLIT = 0.0017  # chance that a split parts a pair at the threshold
BATCH_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = mixed(np.arange(1, SKETCH + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def runs_for(recall: float = RECALL) -> int:
    """A pair at the threshold shares one choice per run on average, none with chance 1/e."""
    return max(1, math.ceil(-math.log(1 - recall)))


def least_agreeing(similarity: float) -> int:
    """Minhash bytes that must agree: of a pair at the threshold fewer do with chance below UNLIKE.

    At a low similarity that is none, and the first look goes by sizes alone.
    """
    below = 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k)
        if below > UNLIKE:
            return k
    return SKETCH


def split_tokens_for(similarity: float) -> int:
    """Orders per split, so that a pair at the threshold meets under one of them."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(UNSPLIT) / math.log(1 - similarity)))


def token_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit tokens (word five-grams) of each text."""
    out: list[np.ndarray] = []
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < BATCH_BYTES):
            size += len(texts[end]) + 1
            end += 1
        out += _sets(texts[start:end])
        start = end
    return out


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    power = 1 << max(21, int(len(data)).bit_length())
    up, down = powers(power)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    sums = prefix_sums(data, up)
    words = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * GOLDEN)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(first, bounds)
    if len(words) >= WORDS:
        grams = np.zeros(len(words) - WORDS + 1, np.uint64)
        for n in range(WORDS):
            grams = mixed(grams + words[n : n + len(grams)] + np.uint64(n))
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for n in range(a, b):
                one = mixed(one + words[n : n + 1] * GOLDEN)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def chosen(tokens: np.ndarray, seeds: np.ndarray, expected: float) -> list[np.ndarray]:
    """For each seed the hashes of the tokens that are chosen; equal tokens have equal hashes."""
    limit = np.uint64(min(1.0, expected / max(1, len(tokens))) * float((1 << 64) - 2048))
    out = []
    for seed in seeds:
        h = mixed((tokens ^ seed) * GOLDEN)
        out.append(h[h <= limit])
    return out


def sketch(tokens: np.ndarray) -> bytes:
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(tokens), 4096):
        least = np.minimum(least, (tokens[a : a + 4096, None] * ODD[None, :]).min(axis=0))
    return (mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def _seeds(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sets_of(documents: DataFrame, similarity: float, recall: float) -> DataFrame:
    """doc_id, mark, node, n_tokens, sketch and paths of the first splits, for every document."""
    norm = F.trim(F.regexp_replace(text_or_empty(), GAP, " "))
    rows = documents.select(
        "doc_id", F.xxhash64("doc_id", text_or_empty()).alias("mark"),
        F.unhex(F.md5(norm)).alias("node"), text_or_empty().alias("text"),
    )
    seeds, kind = _seeds(runs_for(recall)), rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches, paths = [], [], []
            for tokens in token_sets([t.encode() for t in batch.column("text").to_pylist()]):
                sizes.append(len(tokens))
                sketches.append(sketch(tokens))
                found = np.concatenate(chosen(tokens, seeds, 1 / similarity))
                paths.append(np.unique(found).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "mark", "node")), pa.array(sizes, pa.int32()),
                 pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                ["doc_id", "mark", "node", "n_tokens", "sketch", "paths"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind}, mark long, node binary, n_tokens int, sketch binary, paths array<long>"
    )


def _split(large: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """large: path, node.  The next choices of each set.

    The least token under a random order is a sampled token that similar sets share; the minhash
    bytes tell which.  Each path samples its own orders.
    """
    order = lambda n: F.pmod(F.xxhash64("path", F.lit(n)), F.lit(SKETCH)).cast("int") + 1
    found = F.array(*[
        F.struct(F.xxhash64("path", order(n), F.substr("sketch", order(n), F.lit(1))).alias("next"))
        for n in range(split_tokens_for(similarity))
    ])
    return large.join(nodes.select("node", "sketch"), "node").select(
        F.inline(F.array_distinct(found)), "node"
    ).withColumnRenamed("next", "path")


def _fetched(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, tokens of the wanted nodes: texts are read again and joined to one document of each node."""
    rows = documents.select("doc_id", F.xxhash64("doc_id", text_or_empty()).alias("mark"), text_or_empty().alias("text"))
    one = wanted.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "node")
    joined = rows.join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = token_sets([t.encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "tokens"]
            )

    # Rows of equal id and text come more than once.
    return joined.mapInArrow(run, "node binary, tokens binary").dropDuplicates(["node"])


def _sizes(places: DataFrame) -> DataFrame:
    return places.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")


def _alike(large: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, alike: the mean similarity of all pairs in each large bucket, from counts of minhash bytes."""
    some = range(0, SKETCH, SKETCH // 4)
    bytes_ = F.array(*[F.struct(F.lit(k).alias("k"), F.substring("sketch", k + 1, 1).alias("v")) for k in some])
    each = large.join(nodes.select("node", "sketch"), "node").select("path", F.inline(bytes_))
    same = each.groupBy("path", "k", "v").agg(F.count("*").alias("n"))
    by_place = same.groupBy("path", "k").agg(
        (F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("same")
    )
    return by_place.groupBy("path").agg(F.avg("same").alias("alike"))


class _Forest:
    def __init__(self, count: int):
        self.up = list(range(count))

    def root(self, n: int) -> int:
        while self.up[n] != n:
            self.up[n] = self.up[self.up[n]]
            n = self.up[n]
        return n

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _candidates(
    path: int, sizes: np.ndarray, sketches: np.ndarray, leaves: list[np.ndarray], side: np.ndarray, similarity: float,
) -> np.ndarray:
    """Upper triangle of pairs that are this bucket's to decide: alike in size and sketch, no smaller bucket."""
    count = len(sizes)
    pairs = np.triu(np.ones((count, count), bool), 1)
    if side.any() and not side.all():
        pairs &= side[:, None] != side[None, :]
    low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    pairs &= low >= high * similarity
    if not pairs.any():
        return pairs
    if count <= 64:
        agree = (sketches[:, None, :] == sketches[None, :, :]).sum(axis=2)
    else:
        agree = np.zeros((count, count), np.int16)
        for k in range(SKETCH):
            agree += sketches[:, k][:, None] == sketches[:, k][None, :]
    pairs &= agree >= least_agreeing(similarity)
    if not pairs.any():
        return pairs
    members: dict[int, list[int]] = {}
    for n, own in enumerate(leaves):
        for leaf in own[own < path].tolist():
            members.setdefault(leaf, []).append(n)
    for own in members.values():
        if len(own) > 1:
            pairs[np.ix_(own, own)] = False
    return pairs


def _shared(pairs: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each candidate pair: both numbers and the size of the intersection."""
    a, b = np.nonzero(pairs)
    if len(a) <= 4 * len(sets):
        both = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)]
        return a, b, np.array(both, np.int64)
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(column, minlength=len(tokens)) > 1
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(often.sum()), 2048):
        x, y = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[x:y], column[x:y] - start] = 1
        total += part @ part.T
    return a, b, total[a, b].astype(np.int64)


BUCKET = "path long, first int, second int, node binary, side boolean, n_tokens int, sketch binary, leaves array<long>"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of (path, first, second); rows come sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        keys = [rows.column(c).to_numpy() for c in ("path", "first", "second")]
        opens = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)) if rows.num_rows else np.zeros(0, bool)
        edges = np.flatnonzero(opens).tolist()
        for a, b in zip(edges, edges[1:]):
            yield rows.slice(a, b - a)
        held = rows.slice(edges[-1]) if edges else None
    if held is not None and held.num_rows:
        yield held


def _looked_at(buckets: DataFrame, similarity: float) -> DataFrame:
    """The rows of the buckets that have a pair to decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            pairs = _bucket_pairs(rows, similarity)
            keep = pairs.any(axis=0) | pairs.any(axis=1)
            if keep.any():
                yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return _dealt(buckets).mapInArrow(run, BUCKET)


def _dealt(buckets: DataFrame) -> DataFrame:
    keys = ("path", "first", "second")
    return buckets.repartition(*keys).sortWithinPartitions(*keys)


def _bucket_pairs(rows: pa.Table, similarity: float) -> np.ndarray:
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    leaves = [np.array(x, np.int64) for x in rows.column("leaves").to_pylist()]
    return _candidates(
        rows.column("path")[0].as_py(), rows.column("n_tokens").to_numpy(), sketches, leaves,
        np.array(rows.column("side").to_pylist(), bool), similarity,
    )


def _decided(buckets: DataFrame, similarity: float) -> DataFrame:
    """node, links, other: link counts, and edges of a spanning forest where `other` is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            pairs = _bucket_pairs(rows, similarity)
            sets = [np.frombuffer(t, np.uint64) for t in rows.column("tokens").to_pylist()]
            a, b, both = _shared(pairs, sets)
            sizes = rows.column("n_tokens").to_numpy().astype(np.int64)
            linked = both >= similarity * (sizes[a] + sizes[b] - both) - 1e-9
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            links = np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
            forest = _Forest(len(sets))
            for x, y in zip(a.tolist(), b.tolist()):
                forest.join(x, y)
            own = np.flatnonzero(links)
            roots = np.array([forest.root(n) for n in own.tolist()])
            node = rows.column("node").combine_chunks()
            other = node.take(pa.array(np.where(roots == own, -1, roots), mask=roots == own))
            yield pa.RecordBatch.from_arrays(
                [node.take(pa.array(own)), pa.array(links[own], pa.int64()), other], ["node", "links", "other"]
            )

    return _dealt(buckets).mapInArrow(run, "node binary, links long, other binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component.  edges: a, b."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        # Pointer jumping: the label of the label.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = settled(
            lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("jump", "label")).alias("label"))
        )
        moved = not new.filter("label != was").isEmpty()
        labels = new.select("node", "label")
        if not moved:
            return labels


def classified(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of `near_duplicates` and label: the class itself, by one of its nodes; null without words.

    Ids do not tell classes apart: they can be null or come with different texts.
    """
    all_rows = stored(sets_of(documents, similarity, recall))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
    nodes = stored(
        all_rows.filter("n_tokens > 0").groupBy("node").agg(
            F.min(place).alias("one"), F.first("n_tokens").alias("n_tokens"), F.first("sketch").alias("sketch"),
            F.first("paths").alias("paths"),
        ).select("node", F.col("one.doc_id").alias("doc_id"), F.col("one.mark").alias("mark"), "n_tokens", "sketch", "paths")
    )
    places = nodes.select(F.explode("paths").alias("path"), "node")
    sizes = settled(_sizes(places))
    places = settled(places.join(sizes.select("path"), "path", "left_semi"))
    # Split large buckets whose sets are not alike; the others wait as leaves.
    leaves, rest = None, places
    for depth in range(DEPTH):
        big = sizes.filter(F.col("n") > LARGE)
        if big.isEmpty():
            break
        large = rest.join(big.select("path"), "path", "left_semi")
        loose = settled(_alike(large, nodes).filter(F.col("alike") < similarity / 2).select("path"))
        if loose.isEmpty():
            break
        done = rest.join(loose, "path", "left_anti")
        leaves = done if leaves is None else leaves.unionByName(done)
        rest = settled(_split(rest.join(loose, "path", "left_semi"), nodes, similarity))
        sizes = settled(_sizes(rest))
        rest = rest.join(sizes.select("path"), "path", "left_semi")
    leaves = settled((rest if leaves is None else leaves.unionByName(rest)).distinct())
    lists = leaves.groupBy("node").agg(F.sort_array(F.collect_list("path")).alias("leaves"))
    facts = nodes.select("node", "n_tokens", "sketch").join(lists, "node")
    counted = leaves.groupBy("path").agg(F.count("*").alias("n"))
    placed = leaves.join(counted, "path").join(facts, "node")
    # Large leaves are compared in pairs of blocks; a set is in as many pairs as there are blocks.
    blocks = F.when(F.col("n") > LARGE, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    partner = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, F.col("own")).alias("first"), F.greatest(k, F.col("own")).alias("second"),
            (k < F.col("own")).alias("side"),
        ),
    )
    buckets = (
        placed.withColumn("blocks", blocks).withColumn("own", own)
        .select("path", "node", "n_tokens", "sketch", "leaves", F.inline(partner))
        .select("path", "first", "second", "node", "side", "n_tokens", "sketch", "leaves")
    )
    looked = stored(_looked_at(buckets, similarity))
    tokens = stored(
        _fetched(documents, nodes.join(looked.select("node").distinct(), "node", "left_semi"))
    )
    decided = stored(_decided(looked.join(tokens, "node"), similarity))
    links = decided.groupBy("node").agg(F.sum("links").alias("n_links"))
    labels = components(decided.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    least = labels.join(nodes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classes = (
        nodes.select("node", "doc_id").join(labels, "node", "left").join(least, "label", "left").join(links, "node", "left")
        .select(
            "node", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("label", "node").alias("label"),
        )
    )
    return all_rows.select("doc_id", "mark", "node", "n_tokens").join(classes, "node", "left").select(
        "doc_id", "mark",
        F.when(F.col("n_tokens") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("n_tokens") > 0, F.col("label")).alias("label"),
    )


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, mark (a hash of id and text), class_id (least id of the class), n_links (different
    texts that are similar) per document."""
    return classified(documents, similarity, recall).drop("label")


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("mark")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents, all columns, with one document of each class: the one of the least id.

    Documents without words are no class and all stay, except rows equal in id and text.
    """
    mark = F.xxhash64("doc_id", text_or_empty())
    rows = settled(classified(documents).select("doc_id", "mark", "label"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    each = rows.groupBy("label", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = each.filter("label IS NOT NULL").groupBy("label").agg(F.min(place).alias("one"), F.max("n").alias("n"))
    wordless = each.filter("label IS NULL").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "n")
    keep = settled(
        first.select(F.col("one.doc_id").alias("_id"), F.col("one.mark").alias("_mark"), "n").unionByName(wordless)
    )
    kept = documents.join(
        keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), "left_semi"
    )
    if keep.filter("n > 1").isEmpty():
        return kept
    return kept.withColumn("_mark", mark).dropDuplicates(["doc_id", "_mark"]).drop("_mark")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), n AS (
  SELECT array_to_string(w, ' ') AS node, any_value(w) AS w, min(doc_id) AS doc_id FROM d WHERE len(w) > 0 GROUP BY 1
), s AS (
  SELECT DISTINCT doc_id AS id, md5(CASE WHEN len(w) < 5 THEN node ELSE array_to_string(w[i : i + 4], ' ') END) AS t
  FROM n, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i)
), z AS (
  SELECT id, count(*) AS n FROM s GROUP BY id
), p AS (
  SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.t = b.t AND a.id <> b.id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9
), c(a, b) AS (
  SELECT id, id FROM z UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a
), k AS (
  SELECT a AS id, min(b) AS class_id FROM c GROUP BY a
), m AS (
  SELECT n.node, k.class_id, (SELECT count(*) FROM l WHERE l.a = n.doc_id) AS n_links FROM n JOIN k ON k.id = n.doc_id
)
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, coalesce(m.n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN m ON len(d.w) > 0 AND m.node = array_to_string(d.w, ' ')
"""
