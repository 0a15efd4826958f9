"""Line runs and quotient filters: levels, borders of shards, exact counts, odd cases."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import quotient_counts as Q
from riskloom.llm.collocations import OP12_SQL, _score, collocations
from riskloom.llm.line_runs import LineRuns, without_repeated_lines


@pytest.mark.parametrize("n,id_bits", [(2, 1), (2, 40), (3, 1), (3, 2), (3, 21), (3, 27), (3, 42)])
def test_packing_and_permutation_are_invertible(n, id_bits):
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 1 << id_bits, 500).astype(np.uint64) for _ in range(n)]
    bits = Q.half_bits(n, id_bits)
    high, low = Q.permuted(*Q.packed(ids, id_bits), bits)
    assert int(high.max()) < 1 << bits and int(low.max()) < 1 << bits
    found = Q.merged(high, low, np.ones(500, np.int64), bits)
    assert [list(a) for a in Q.from_bytes(Q.to_bytes(*found, bits), bits)] == [list(a) for a in found]
    back = Q.unpacked(*Q.restored(*found[:2], bits), n, id_bits)
    assert dict(zip(zip(*[a.tolist() for a in back]), found[2].tolist())) == Counter(zip(*[a.tolist() for a in ids]))


def test_score_is_exact_past_64_bits(spark):
    rows = [(9_876_543_210_987, 9_999_999_999_999, 9_876_543_210_988), (10, 10, 10), (7, 11, 13)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(_score("a", "l", "r")).collect()
    assert [r[0] for r in got] == [1_000_000 * a * a // (x * y) for a, x, y in rows]


@pytest.mark.parametrize("shard_tokens,chunk_bytes,level_bits", [(50, 40, 1), (400, 100, 3), (10**6, 10**6, 10)])
def test_phrases_across_shards_and_levels(spark, tmp_path, shard_tokens, chunk_bytes, level_bits):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["New", "york", "city", "a\x01", "b", "é,", "the\t", "."], k=rng.randint(0, 90)))
             for _ in range(60)] + [None, "", " . "]
    rows = [(t, ("en", "de", None)[n % 3], "x") for n, t in enumerate(texts)] + [("new york " * 900, "en", "x")]
    docs = spark.createDataFrame(rows, "text string, lang string, word string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(OP12_SQL).fetchall()
    ours = collocations(
        docs, shard_tokens=shard_tokens, chunk_bytes=chunk_bytes, level_bits=level_bits
    ).collect()
    assert len(theirs) > 20 and sorted(map(tuple, ours)) == sorted(theirs)


def _expected(texts, least, chars=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or found[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fan", [(1, 2), (5, 2), (7, 3)])
def test_lines_of_many_documents(spark, batches, fan):
    rng = random.Random(4)
    pool = ["Same line", " same LINE\t", "other", "", "É", "é", "x" * 3000] + [f"rare {n}" for n in range(30)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(80)] + [None, "", "same line", "\n\n"]
    rows = [(n % 50, t, "z") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").repartition(4)
    got = without_repeated_lines(docs, 10, batches=batches, fan=fan).select("n_lines", "n_dropped", "text").collect()
    assert Counter(map(tuple, got)) == Counter(_expected(texts, 10))


def test_runs_are_compacted_and_new_batches_anti_joined(spark):
    def batch(*names):
        return spark.createDataFrame([(hashlib.md5(n.encode()).hexdigest(), 2) for n in names], "hash string, n long")

    runs = LineRuns(spark, least_documents=4, fan=2)
    for names in ("ab", "ac", "ad"):
        runs.add(batch(*names))
    assert [len(level) for level in runs.levels] == [1, 1]
    tables = [spark.table(n) for level in runs.levels for n in level]
    assert sorted(t.count() for t in tables) == [1, 3]  # "a" was decided when the third batch came
    assert runs.frequent().select(F.col("n") >= 4).collect() == [(True,)]
    assert runs.unseen(batch("a", "d", "e")).count() == 1
