"""Removal of repeated 200-byte strings with sparse, deep-shallow sorted suffixes.

Every 200-byte window has one anchor: the 40-byte string inside it with the smallest hash, leftmost
on ties.  Equal windows have equal anchors at the same distance, so suffixes need to be sorted at
anchors only, about one position in eighty:

1. Each text gives its anchors: hash of the anchor, hash of its block (all windows that have this
   anchor), place.  Anchors that occur once are dropped by a count with map-side sums.
2. Blocks that occur twice or more are repeated as a whole.  Only where different blocks share an
   anchor the bytes are needed, once for each different block.
3. The bytes to the right of the anchors, and to the left in reverse, are sorted group by group
   (`suffix_sort`: multikey quicksort, then blind tries).  Common prefixes of neighbours part each
   order into classes for every depth; a window is repeated if another block is in both its classes.
4. Runs go back to the texts, which are cut and digested.

Anchors with more different blocks than `MOST_BLOCKS` are split: each of their windows is counted by its
own 128-bit digest, again with map-side sums, so no group meets in one task whole.

Texts meet their marks in one join; only texts with marks to settle are joined once more.
Long texts are taken in overlapping slices.

Defined cases: null text is empty; texts below 200 bytes are kept whole; rows with equal id and
text are copies of each other; an empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.rolling import mixed, powers, prefix_sums
from riskloom.llm.shared import settled, stored, table
from riskloom.llm.suffix_sort import deep_shallow

LENGTH, GRAM = 200, 40
SPAN = LENGTH - GRAM + 1  # anchors that a window may have
SLICE = 1 << 20
MOST_BLOCKS = 20_000


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[i : i + width] for each i up to len(v) - width."""
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(v) - width + 1
    return np.minimum(right[:count], left[width - 1 : width - 1 + count])


def blocks_of(parts: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """parts: (text number, offset in the text, bytes).  Anchors and blocks of all windows in them.

    A text in one part or in slices that overlap by LENGTH - 1 bytes gives each window once.
    """
    sizes = np.array([len(b) for _, _, b in parts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(b for _, _, b in parts), np.uint8)
    empty = np.zeros(0, np.int64)
    none = {"text": empty, "anchor": empty, "block": empty, "at": empty, "low": empty, "high": empty}
    if len(data) < LENGTH:
        return none
    up, down = powers(2 * SLICE + 4 * LENGTH)
    sums = prefix_sums(data, up)
    grams = len(data) - GRAM + 1
    hashes = mixed((sums[GRAM:] - sums[:grams]) * down[:grams])
    places = np.arange(grams, dtype=np.uint64)
    low_bits = np.uint64((1 << 24) - 1)
    least = _sliding_min((hashes & ~low_bits) | places, SPAN)
    anchor_at = (least & low_bits).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), sizes)[: len(anchor_at)]
    start = np.arange(len(anchor_at))
    inside = start + LENGTH <= ends[owner]
    start, anchor_at, owner = start[inside], anchor_at[inside], owner[inside]
    if not len(start):
        return none
    opens = np.ones(len(start), bool)
    opens[1:] = (anchor_at[1:] != anchor_at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(start)) - 1
    low, high, at, own = start[first], start[last], anchor_at[first], owner[first]
    block = (sums[high + LENGTH] - sums[low]) * down[low]
    block = mixed(block + mixed(((high - low) * 512 + (at - low)).astype(np.uint64)))
    begins = ends[own] - sizes[own]
    moved = np.array([p[1] for p in parts], np.int64)[own] - begins
    return {
        "text": np.array([p[0] for p in parts], np.int64)[own],
        "anchor": hashes[at].view(np.int64), "block": block.view(np.int64),
        "at": at + moved, "low": low + moved, "high": high + moved,
    }


def _parts(number: int, data: bytes) -> Iterator[tuple[int, int, bytes]]:
    for offset in range(0, max(1, len(data) - LENGTH + 1), SLICE):
        yield number, offset, data[offset : offset + SLICE + LENGTH - 1]


def anchors(rows: DataFrame) -> DataFrame:
    """rows: doc_id, mark, text.  One row for each anchor of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            pending, size = [], 0
            for n in range(len(texts)):
                data = (texts[n].as_py() or "").encode()
                for part in _parts(n, data):
                    pending.append(part)
                    size += len(part[2])
                    if size >= SLICE:
                        yield _anchor_rows(batch, blocks_of(pending))
                        pending, size = [], 0
            if pending:
                yield _anchor_rows(batch, blocks_of(pending))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, mark long, anchor long, block long, at int, low int, high int"
    )


def _anchor_rows(batch: pa.RecordBatch, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    which = pa.array(found["text"])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(which), batch.column("mark").take(which)]
        + [pa.array(found[c]) for c in ("anchor", "block")]
        + [pa.array(found[c].astype(np.int32)) for c in ("at", "low", "high")],
        ["doc_id", "mark", "anchor", "block", "at", "low", "high"],
    )


RUN = "array<struct<start:int,end:int>>"
CONTENT = "array<struct<anchor:long,at:int,low:int,high:int,copies:boolean,split:boolean,bytes:binary>>"


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals; runs that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.append(True, starts[1:] > reach[:-1])
    return starts[opens], reach[np.append(np.flatnonzero(opens)[1:], len(starts)) - 1]


def _result(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    starts, ends = merged(starts, ends)
    kept, at = hashlib.sha256(), 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept.update(data[at:a])
        at = b
    kept.update(data[at:])
    return len(data), int((ends - starts).sum()), len(starts), kept.hexdigest()


def _pairs(runs: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    runs = runs or []
    return (
        np.array([r["start"] for r in runs], np.int64), np.array([r["end"] for r in runs], np.int64)
    )


def _first_pass(joined: DataFrame) -> DataFrame:
    """Settled texts get their result; others their text and sure runs; wanted blocks their bytes."""
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("open", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "runs", "content")}
            for text, marks in zip(batch.column("text"), batch.column("marks")):
                text, marks = text.as_py() or "", marks.as_py() or []
                data = text.encode()
                sure = [m for m in marks if m["copies"]]
                starts = np.array([m["low"] for m in sure], np.int64)
                ends = np.array([m["high"] + LENGTH for m in sure], np.int64)
                waits = any(not m["copies"] for m in marks)
                result = (None,) * 4 if waits else _result(data, starts, ends)
                for name, value in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), result):
                    out[name].append(value)
                out["open"].append(waits)
                out["text"].append(text if waits else None)
                runs = zip(*(x.tolist() for x in merged(starts, ends)))
                out["runs"].append([{"start": a, "end": b} for a, b in runs] if waits else None)
                out["content"].append(
                    [
                        {k: m[k] for k in ("anchor", "at", "low", "high", "copies", "split")}
                        | {"bytes": data[m["low"] : m["high"] + LENGTH]}
                        for m in marks if m["wanted"]
                    ]
                )
            kinds = {
                "open": pa.bool_(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
                "kept_sha256": pa.string(), "text": pa.string(),
                "runs": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                "content": pa.list_(pa.struct([
                    ("anchor", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()),
                    ("copies", pa.bool_()), ("split", pa.bool_()), ("bytes", pa.binary())])),
            }
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark")] + [pa.array(out[n], kinds[n]) for n in kinds],
                ["doc_id", "mark", *kinds],
            )

    return joined.mapInArrow(
        run,
        f"doc_id {kind}, mark long, open boolean, n_bytes long, n_removed long, n_spans long, "
        f"kept_sha256 string, text string, runs {RUN}, content {CONTENT}",
    )


def _window_runs(offsets: np.ndarray, at: int) -> list[tuple[int, int]]:
    """Byte runs of the windows that start `offsets` before the anchor at `at`."""
    starts = at - offsets.astype(np.int64)
    a, b = merged(np.sort(starts), np.sort(starts) + LENGTH)
    return list(zip(a.tolist(), b.tolist()))


def repeated_windows(blocks: dict[str, list]) -> list[tuple[int, list[tuple[int, int]]]]:
    """blocks: anchor (ascending), at, low, high, copies, bytes.  Runs of the blocks without copies."""
    groups = np.unique(np.array(blocks["anchor"], np.int64), return_inverse=True)[1]
    count = len(groups)
    back = [a - low for a, low in zip(blocks["at"], blocks["low"])]
    order_r, shared_r = deep_shallow([b[n:] for b, n in zip(blocks["bytes"], back)], groups)
    order_l, shared_l = deep_shallow([b[:n][::-1] for b, n in zip(blocks["bytes"], back)], groups)
    most = np.array(back)  # the farthest window start before the anchor
    least = np.array(blocks["at"]) - np.array(blocks["high"])
    new = np.ones(count, bool)
    new[1:] = groups[1:] != groups[:-1]
    class_r, class_l = np.empty(count, np.int64), np.empty(count, np.int64)
    hits: list[np.ndarray] = []
    which: list[np.ndarray] = []
    for offset in range(SPAN):
        has = np.flatnonzero((least <= offset) & (offset <= most))
        if len(has) < 2:
            continue
        class_r[order_r] = np.cumsum(new | (shared_r < LENGTH - offset))
        class_l[order_l] = np.cumsum(new | (shared_l < offset))
        both = class_r[has] * (count + 1) + class_l[has]
        _, at, times = np.unique(both, return_inverse=True, return_counts=True)
        again = has[times[at] > 1]
        hits.append(again)
        which.append(np.full(len(again), offset))
    if not hits:
        return []
    hit, offset = np.concatenate(hits), np.concatenate(which)
    order = np.argsort(hit, kind="stable")
    hit, offset = hit[order], offset[order]
    edges = np.flatnonzero(np.append(True, hit[1:] != hit[:-1])) if len(hit) else []
    out = []
    for a, b in zip(edges, [*edges[1:], len(hit)]):
        n = int(hit[a])
        if not blocks["copies"][n]:
            out.append((n, _window_runs(offset[a:b], blocks["at"][n])))
    return out


TASK_BLOCKS = 40_000


def _sorted_groups(contents: DataFrame) -> DataFrame:
    """Runs found by sorting the blocks of each anchor; anchors are dealt out by hash."""
    kind = contents.schema["doc_id"].dataType.simpleString()
    names = ("anchor", "at", "low", "high", "copies", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(rows: pa.Table) -> pa.RecordBatch:
            found = repeated_windows({n: rows.column(n).to_pylist() for n in names})
            which = [n for n, runs in found for _ in runs]
            spans = [span for _, runs in found for span in runs]
            return pa.RecordBatch.from_arrays(
                [
                    *(rows.column(n).combine_chunks().take(pa.array(which, pa.int64())) for n in ("doc_id", "mark")),
                    pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32()),
                ],
                ["doc_id", "mark", "start", "end"],
            )

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= TASK_BLOCKS:
                keys = held.column("anchor").to_numpy()
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
                if cut:
                    yield done(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return (
        contents.repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(run, f"doc_id {kind}, mark long, start int, end int")
    )


def _counted_windows(contents: DataFrame) -> DataFrame:
    """Runs of blocks whose anchor has too many different blocks: windows counted by digest."""
    kind = contents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, starts, digests = [], [], []
            for n, (low, high, data) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("low", "high", "bytes")))
            ):
                for k in range(high - low + 1):
                    which.append(n)
                    starts.append(low + k)
                    digests.append(hashlib.blake2b(data[k : k + LENGTH], digest_size=16).digest())
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("doc_id", "mark", "copies")]
                + [pa.array(starts, pa.int32()), pa.array(digests, pa.binary())],
                ["doc_id", "mark", "copies", "start", "digest"],
            )

    windows = contents.mapInArrow(run, f"doc_id {kind}, mark long, copies boolean, start int, digest binary")
    again = (
        windows.groupBy("digest").agg(F.sum(F.when(F.col("copies"), 2).otherwise(1)).alias("n")).filter("n > 1")
    )
    return (
        windows.filter(~F.col("copies")).join(again, "digest", "left_semi")
        .select("doc_id", "mark", "start", (F.col("start") + LENGTH).cast("int").alias("end"))
    )


def _second_pass(open_texts: DataFrame) -> DataFrame:
    kind = open_texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = []
            for text, sure, found in zip(*(batch.column(c) for c in ("text", "runs", "found"))):
                a, b = _pairs(sure.as_py())
                c, d = _pairs(found.as_py())
                results.append(_result(text.as_py().encode(), np.append(a, c), np.append(b, d)))
            columns = list(zip(*results)) if results else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [pa.array(columns[n], pa.int64()) for n in range(3)] + [pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return open_texts.select("doc_id", "text", "runs", "found").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", F.xxhash64("doc_id", text).alias("mark"), text.alias("text"))
    long_enough = rows.filter(F.octet_length("text") >= LENGTH)
    every = stored(anchors(long_enough))
    again = every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    kept = stored(every.join(again, "anchor", "left_semi"))
    # Different blocks of an anchor, with the place of one of them; equal rows of a text are copies.
    place = F.struct("doc_id", "mark", "at")
    blocks = kept.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    blocks = settled(blocks)
    several = blocks.groupBy("anchor").agg(F.count("*").alias("n_blocks")).filter("n_blocks > 1")
    known = blocks.join(several, "anchor", "left")
    marks = (
        kept.join(known, ["anchor", "block"])
        .withColumn("copies", F.col("n") > 1)
        .withColumn("wanted", F.col("n_blocks").isNotNull() & (F.col("one") == place))
        .filter("copies or wanted")
        .withColumn("split", F.coalesce(F.col("n_blocks") > MOST_BLOCKS, F.lit(False)))
        .groupBy("doc_id", "mark")
        .agg(F.collect_set(F.struct("anchor", "at", "low", "high", "copies", "wanted", "split")).alias("marks"))
    )
    joined = rows.join(
        marks.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "marks"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left",
    ).select("doc_id", "mark", "text", "marks")
    first = stored(_first_pass(joined))
    contents = first.filter(F.size("content") > 0).select("doc_id", "mark", F.inline("content"))
    runs = _sorted_groups(contents.filter("not split")).unionByName(_counted_windows(contents.filter("split")))
    found = runs.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    open_texts = first.filter("open").join(
        found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "found"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left",
    )
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return first.filter("not open").select(*names).unionByName(_second_pass(open_texts))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), p AS (
  SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS w
  FROM d, unnest(range(0, length(x) // 2 - 199)) AS t(i) WHERE length(x) >= 400
), q AS (
  SELECT r, i FROM p WHERE w IN (SELECT w FROM p GROUP BY w HAVING count(*) > 1)
), o AS (
  SELECT r, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 200 THEN 1 ELSE 0 END AS opens FROM q
), g AS (
  SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM o
), s AS (
  SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run
), k AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s
), m AS (
  SELECT d.r, count(*) AS n_spans, sum(b - a) AS n_removed,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a)
      || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM k JOIN d ON d.r = k.r GROUP BY d.r
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN m ON d.r = m.r
"""
