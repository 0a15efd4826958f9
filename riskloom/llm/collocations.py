"""Phrases of two and three words that occur together more often than their parts suggest.

1. One pass over the texts gives, per shard of bounded size, its words and the stream of their positions in
   that list.  Words of fewer than the least occurrences are in no candidate; the others get global ids.
2. Each shard's stream is translated to ids and counted into counting quotient filters (pairs, triples), one entry a
   distinct phrase and shard, so no phrase is hot afterwards.
3. Filters are cut at quotient borders and merged across shards, level by level: a group takes 2^s pieces of
   one 2^s-th each, so a merge holds as much as one shard however many shards there are.  Filters are lossless.
4. Candidates are rows of ids; counts of their parts come by joins whose hot keys are broadcast (10,000 at most).

Defined cases: null text is empty; null lang is `und`; words are taken as UTF-8 byte strings; texts of any
length are cut at word borders only for memory, phrases go across the cuts; repeated rows count each; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.llm import quotient_counts as Q
from riskloom.llm.shared import hot_join, ranked, settled, stored, table, text_or_empty

LEAST, COVERED, TOP = 10, 50, 2000
SHARD_TOKENS, CHUNK_BYTES = 1 << 21, 1 << 20
LEVEL_BITS, RANK_PARTS = 10, 64
# A-Z to a-z, piece ends to a line feed, tab to space.
_BYTES = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n "
)
_GAP = re.compile(rb"[ \n]")
BREAK = -1


class _Words(dict):
    """Numbers new words as they come."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _chunks(text: bytes, size: int) -> Iterator[bytes]:
    """Whole words only; a word longer than a chunk stays whole."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


class _Shard:
    """Words and stream of some texts; `skip` leading tokens belong to the shard before."""

    def __init__(self, lang: str = "", before: list[bytes] = ()):
        self.words: dict[str, _Words] = {}
        self.streams: list[tuple[str, np.ndarray]] = []
        self.tokens = 0
        self.add(lang, before)
        self.skip, self.tokens = len(before), 0

    def add(self, lang: str, tokens: list[bytes]) -> None:
        if tokens:
            known = self.words.setdefault(lang, _Words({b"\n": 0}))
            self.streams.append((lang, np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)) - 1))
            self.tokens += len(tokens)

    def row(self, name: str) -> dict:
        """One numbering over all languages; a break is -1."""
        langs = list(self.words)
        sizes = [len(self.words[k]) - 1 for k in langs]
        first = dict(zip(langs, np.cumsum([0] + sizes).tolist()))
        stream = np.concatenate([np.where(s < 0, s, s + first[k]) for k, s in self.streams]).astype(np.int32)
        new = stream[self.skip :]
        return {
            "shard": name, "skip": self.skip, "stream": stream.tobytes(),
            "words": [w.decode("utf-8", "replace") for k in langs for w in list(self.words[k])[1:]],
            "langs": [k for k, size in zip(langs, sizes) for _ in range(size)],
            "counts": np.bincount(new[new >= 0], minlength=sum(sizes)).tolist(),
        }


SHARD_TYPE = (
    "shard string, skip int, stream binary, words array<string>, langs array<string>, counts array<bigint>"
)
_SHARD_ARROW = pa.schema(
    [("shard", pa.string()), ("skip", pa.int32()), ("stream", pa.binary()), ("words", pa.list_(pa.string())),
     ("langs", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
)


def _shards(shard_tokens: int, chunk_bytes: int):
    """(part, lang, text) to shards of about `shard_tokens` tokens."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, label = _Shard(), 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([shard.row(f"{label}-{number}")], schema=_SHARD_ARROW)

        for batch in batches:
            for part, lang, text in zip(batch["part"], batch["lang"], batch["text"]):
                label, lang, last = part.as_py(), lang.as_py(), []
                for chunk in _chunks(text.as_py().translate(_BYTES), chunk_bytes):
                    if shard.tokens >= shard_tokens:
                        yield out()
                        shard, number = _Shard(lang, last), number + 1
                    tokens = [t for t in chunk.replace(b"\n", b" \n ").split(b" ") if t]
                    shard.add(lang, tokens)
                    last = (last + tokens[-2:])[-2:]
                shard.add(lang, [b"\n"])
        if shard.tokens:
            yield out()

    return split


# -- filters -----------------------------------------------------------------------

FILTER_TYPE = "n int, prefix long, run long, data binary"
_FILTER_ARROW = pa.schema([("n", pa.int32()), ("prefix", pa.int64()), ("run", pa.int64()), ("data", pa.binary())])
COUNT_TYPE = "n int, i long, j long, k long, a long"
_COUNT_ARROW = pa.schema([(c, pa.int32() if c == "n" else pa.int64()) for c in "nijka"])


def _cut(n: int, run: int, bits: int, upto: int, high, low, counts) -> Iterator[pa.RecordBatch]:
    """Pieces of a sorted filter by its first `upto` bits."""
    if not len(high):
        return
    prefix = (high >> np.uint64(bits - upto)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
    ends = np.append(starts[1:], len(high))
    data = [Q.to_bytes(high[a:b], low[a:b], counts[a:b], bits) for a, b in zip(starts, ends)]
    for at in range(0, len(data), 256):
        part = data[at : at + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n] * len(part), pa.int32()), pa.array(prefix[starts[at : at + 256]]),
             pa.array([run] * len(part), pa.int64()), pa.array(part, pa.binary())], schema=_FILTER_ARROW,
        )


def _first_filters(id_bits: int, upto: dict[int, int]):
    """(run, skip, stream, size, known: places and ids of words) to pieces of filters."""

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                known = batch["known"][at].values
                ids = np.full(batch["size"][at].as_py() + 1, BREAK, np.int64)  # the last one: a break
                ids[known.field("at").to_numpy()] = known.field("id").to_numpy()
                stream = ids[np.frombuffer(batch["stream"][at].as_buffer(), np.int32)]
                skip = batch["skip"][at].as_py()
                for n in (2, 3):
                    if len(stream) < n:
                        continue
                    columns = [stream[k : len(stream) - n + 1 + k] for k in range(n)]
                    good = np.logical_and.reduce([c >= 0 for c in columns])
                    good[: max(0, skip - n + 1)] = False  # ends in the shard before
                    bits = Q.half_bits(n, id_bits)
                    high, low = Q.permuted(*Q.packed([c[good] for c in columns], id_bits), bits)
                    found = Q.merged(high, low, np.ones(len(high), np.int64), bits)
                    yield from _cut(n, batch["run"][at].as_py(), bits, upto[n], *found)

    return translate


def _merged_filters(id_bits: int, upto: dict[int, int] | None, least: int):
    """Pieces sorted by (n, prefix, run) to one filter a group, cut again at `upto` bits; or, without that, to counts."""

    def finished(key: tuple, pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
        n, _, run = key
        bits = Q.half_bits(n, id_bits)
        parts = [Q.from_bytes(p, bits) for p in pieces]
        high, low, counts = Q.merged(*[np.concatenate(c) for c in zip(*parts)], bits)
        if upto:
            yield from _cut(n, run, bits, upto[n], high, low, counts)
            return
        often = counts >= least
        ids = Q.unpacked(*Q.restored(high[often], low[often], bits), n, id_bits)
        size = int(often.sum())
        ids = [pa.array(a.astype(np.int64)) for a in ids] + [pa.nulls(size, pa.int64())] * (3 - n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, n, np.int32)), *ids, pa.array(counts[often])], schema=_COUNT_ARROW
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces = None, []
        for batch in batches:
            for n, prefix, run, data in zip(*[batch[c] for c in ("n", "prefix", "run", "data")]):
                at = (n.as_py(), prefix.as_py(), run.as_py())
                if at != key and pieces:
                    yield from finished(key, pieces)
                    pieces = []
                key = at
                pieces.append(data.as_py())
        if pieces:
            yield from finished(key, pieces)

    return merge


def phrase_counts(
    shards: DataFrame, words: DataFrame, least: int, level_bits: int = LEVEL_BITS
) -> DataFrame:
    """n, i, j, k, a: ids of phrases of two (k null) and three words found `least` times or more.

    shards: as `_shards` makes them; words: lang, word, id.
    """
    size, vocabulary = shards.count(), words.count()
    id_bits = max(1, (vocabulary - 1).bit_length())
    widths = {n: Q.half_bits(n, id_bits) for n in (2, 3)}
    step = min(level_bits, max(1, (size - 1).bit_length()))
    fan = 1 << step
    runs = max(1, -(-size // fan))
    places = shards.select("shard", F.posexplode("words").alias("at", "word"), "langs").select(
        "shard", "at", "word", F.get("langs", F.col("at")).alias("lang")
    )
    known = (
        places.join(words.select("lang", "word", "id"), ["lang", "word"])
        .groupBy("shard").agg(F.collect_list(F.struct("at", "id")).alias("known"))
    )
    translated = shards.select(
        "shard", "skip", "stream", F.size("words").alias("size"),
        F.pmod(F.xxhash64("shard"), F.lit(runs)).alias("run"),
    ).join(known, "shard").select("run", "skip", "stream", "size", "known")
    upto = {n: min(w, step) for n, w in widths.items()}
    pieces = translated.mapInArrow(_first_filters(id_bits, upto), FILTER_TYPE)
    key = ("n", "prefix", "run")
    while runs > 1:
        runs = -(-runs // fan)
        upto = {n: min(w, upto[n] + step) for n, w in widths.items()}
        dealt = pieces.repartition(*key).sortWithinPartitions(*key)
        pieces = stored(dealt.mapInArrow(_merged_filters(id_bits, upto, least), FILTER_TYPE))
        pieces = pieces.withColumn("run", F.expr(f"run div {fan}"))
    dealt = pieces.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(_merged_filters(id_bits, None, least), COUNT_TYPE)


# -- scores ------------------------------------------------------------------------


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)), exact: decimals of 38 digits."""
    big = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"1000000BD * {big(a)} * {big(a)} div ({big(l)} * {big(r)})")


def collocations(
    documents: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP,
    shard_tokens: int = SHARD_TOKENS, chunk_bytes: int = CHUNK_BYTES, level_bits: int = LEVEL_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases.

    A phrase inside a longer candidate found at least `covered` per cent as often is dropped.
    """
    texts = documents.select(
        F.spark_partition_id().alias("part"), F.coalesce("lang", F.lit("und")).alias("lang"),
        text_or_empty().cast("binary").alias("text"),
    )
    shards = stored(texts.mapInArrow(_shards(shard_tokens, chunk_bytes), SHARD_TYPE))
    counted = settled(
        shards.select(F.explode(F.arrays_zip("words", "langs", "counts")).alias("w"))
        .groupBy(F.col("w.langs").alias("lang"), F.col("w.words").alias("word"))
        .agg(F.sum("w.counts").alias("f"))
    )
    of_lang = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    total = counted.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    words = ranked(counted.where(F.col("f") >= least), "lang", "word", name="id")
    found = stored(phrase_counts(shards, words, least, level_bits))
    two = found.where("n = 2").select("i", "j", "a")
    three = found.where("n = 3").select("i", "j", "k", "a")

    inside = three.select(
        F.inline(F.array(F.struct("i", "j", "a"), F.struct(F.col("j").alias("i"), F.col("k").alias("j"), "a")))
    ).groupBy("i", "j").agg(F.max("a").alias("longer"))
    alone = two.join(inside, ["i", "j"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))
    ).select("i", "j", F.lit(None).cast("long").alias("k"), "a")

    def of_word(rows: DataFrame, name: str) -> DataFrame:
        """Count and text of a word of the phrase."""
        small = words.select(
            F.col("id").alias(name), F.col("f").alias(f"f_{name}"), F.col("word").alias(f"word_{name}"),
            F.col("lang").alias(f"lang_{name}"),
        )
        return hot_join(rows, small, [name], f"f_{name}", total)

    def of_pair(rows: DataFrame, first: str, second: str) -> DataFrame:
        name = f"f_{first}{second}"
        small = two.select(F.col("i").alias(first), F.col("j").alias(second), F.col("a").alias(name))
        return hot_join(rows, small, [first, second], name, total)

    pairs = of_word(of_word(alone, "i"), "j").select(
        F.col("lang_i").alias("lang"), F.concat_ws(" ", "word_i", "word_j").alias("phrase"), "a",
        F.col("f_i").alias("l"), F.col("f_j").alias("r"), _score("a", "f_i", "f_j").alias("score"),
    )
    parts = of_word(of_word(of_word(of_pair(of_pair(three, "i", "j"), "j", "k"), "i"), "j"), "k")
    first, second = _score("a", "f_i", "f_jk"), _score("a", "f_ij", "f_k")
    by_first = F.col("cut_1") <= F.col("cut_2")
    triples = parts.withColumn("cut_1", first).withColumn("cut_2", second).select(
        F.col("lang_i").alias("lang"), F.concat_ws(" ", "word_i", "word_j", "word_k").alias("phrase"), "a",
        F.when(by_first, F.col("f_i")).otherwise(F.col("f_ij")).alias("l"),
        F.when(by_first, F.col("f_jk")).otherwise(F.col("f_k")).alias("r"),
        F.least("cut_1", "cut_2").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    leading = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    for key in (["lang", "part"], ["lang"]):  # a language's last task gets RANK_PARTS x top rows at most
        best = Window.partitionBy(*key).orderBy(*order)
        leading = leading.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return leading.join(of_lang, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, piece, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w
), t AS (
  SELECT a.lang, a.word AS w1, b.word AS w2, c.word AS w3
  FROM g a LEFT JOIN g b ON b.piece = a.piece AND b.pos = a.pos + 1
  LEFT JOIN g c ON c.piece = a.piece AND c.pos = a.pos + 2
), f1 AS (SELECT lang, w1, count(*) AS f FROM t GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
), f2 AS (SELECT lang, w1, w2, count(*) AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), c2 AS (
  SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, p.f AS l, q.f AS r,
    (1000000::HUGEINT * x.f * x.f // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM f2 x JOIN f1 p ON p.lang = x.lang AND p.w1 = x.w1 JOIN f1 q ON q.lang = x.lang AND q.w1 = x.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 y WHERE y.lang = x.lang AND 100 * y.f >= 50 * x.f
    AND ((y.w1 = x.w1 AND y.w2 = x.w2) OR (y.w2 = x.w1 AND y.w3 = x.w2)))
), s3 AS (
  SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3 AS phrase, x.f AS a,
    p.f AS l1, s.f AS r1, q.f AS l2, r.f AS r2,
    (1000000::HUGEINT * x.f * x.f // (p.f::HUGEINT * s.f))::BIGINT AS s1,
    (1000000::HUGEINT * x.f * x.f // (q.f::HUGEINT * r.f))::BIGINT AS s2
  FROM f3 x JOIN f1 p ON p.lang = x.lang AND p.w1 = x.w1 JOIN f1 r ON r.lang = x.lang AND r.w1 = x.w3
  JOIN f2 q ON q.lang = x.lang AND q.w1 = x.w1 AND q.w2 = x.w2
  JOIN f2 s ON s.lang = x.lang AND s.w1 = x.w2 AND s.w2 = x.w3
), u AS (
  SELECT * FROM c2 UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM s3
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM u
)
SELECT o.lang, rank::BIGINT AS rank, phrase, a, l, r, n.n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
