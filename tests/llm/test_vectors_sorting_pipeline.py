"""Neighbours and suffix sorting against brute force; the pipeline stage by stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import suffix_dedup
from riskloom.llm.hilbert_neighbours import hilbert_keys, neighbours
from riskloom.llm.mixing import mix, mixed_documents
from riskloom.llm.suffix_sort import blind_trie, deep_shallow


def _nearest(rows, asks, k=10):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v, float)
    out = {}
    for q in usable:
        if asks(q):
            far = [(float(np.sqrt(((usable[i] - usable[q]) ** 2).sum())), i) for i in usable if i != q and len(usable[i]) == len(usable[q])]
            out[q] = sorted(far)[:k]
    return out


def test_curve_visits_every_cell_by_steps():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_keys(grid, 3)
    walk = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and set(np.abs(np.diff(walk, axis=0)).sum(axis=1)) == {1}


def test_neighbours_of_odd_rows_and_copies(spark):
    rng = random.Random(4)
    vector = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]
    rows = [(n, vector()) for n in range(300)] + [(300 + n, [1.0] * 8) for n in range(60)]
    rows += [(400, None), (500, [0.0] * 8), (600, [float("nan")] * 8), (700, [None] + [1.0] * 7), (800, []), (900, [1.0, 2.0]), (None, vector())]
    rows += [rows[310]]
    df = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = {q: v for q, v in _nearest(rows, lambda q: q % 20 == 0).items() if v}
    assert got.keys() == want.keys()
    for q in want:  # few rows: the windows hold all
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = _nearest(rows, lambda q: q % 100 == 0)
    got = {}
    for r in neighbours(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = sum(len(got[q] & {i for _, i in want[q]}) for q in want)
    assert found >= 0.9 * sum(len(v) for v in want.values())


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_sorted_suffixes_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(400):
        base = bytes(rng.choices(b"ab\0", k=120))
        keys = []
        for _ in range(rng.randint(1, 30)):
            key = bytearray(base[: rng.randint(0, 120)])
            if key and rng.random() < 0.7:
                key[rng.randrange(len(key))] = rng.choice(b"ab\0\xff")
            keys.append(bytes(key))
        groups = np.sort(np.array([rng.randint(0, 3) for _ in keys]))
        order, shared = deep_shallow(keys, groups)
        sorted_ = [(groups[n], keys[n]) for n in order]
        assert sorted(order) == list(range(len(keys))) and [g for g, _ in sorted_] == list(groups)
        for n in range(len(keys)):
            alone = n == 0 or sorted_[n][0] != sorted_[n - 1][0]
            assert shared[n] == (0 if alone else _common(sorted_[n][1], sorted_[n - 1][1]))
    order, shared = blind_trie([b"b", b"a", b"ab", b"b"])
    assert [(b"b", b"a", b"ab", b"b")[n] for n in order] == [b"a", b"ab", b"b", b"b"] and shared == [0, 1, 0, 1]


def _removed(texts):
    seen = {}
    for n, t in enumerate(texts):
        for i in range(len(t) - 199):
            seen.setdefault(t[i : i + 200], []).append((n, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for n, i in places:
                gone[n].update(range(i, i + 200))
    return [len(g) for g in gone]


@pytest.mark.parametrize("limit", [20_000, 1])
def test_repeated_bytes(spark, monkeypatch, limit):
    """limit 1 sends every anchor with different blocks through the split by windows."""
    monkeypatch.setattr(suffix_dedup, "MOST_BLOCKS", limit)
    monkeypatch.setattr(suffix_dedup, "SLICE", 4096)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choices("abcdé 🙂", k=n))
    common, other = make(300), make(230)
    texts = ["", "x" * 199, "x" * 500, make(9000), common, common, make(50) + common + make(80), common[:220] + make(5),
             make(20) + common[20:250] + make(300) + other, other[::-1] + other, "ab" * 300, make(6000) + common + make(9000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs).collect()}
    want = _removed([t.encode() for t in texts])
    assert [got[n]["n_removed"] for n in range(len(texts))] == want and sum(want) > 0


def test_mix_is_near_its_targets_and_repeats(spark):
    rng = random.Random(6)
    rows = [(n, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", "é", None])) for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = mix(docs), mix(docs.repartition(7))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    per = first.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"), F.sum("size").alias("size")).collect()
    total = sum(r["size"] for r in per)
    assert abs(sum(r["target"] for r in per) - total) < 1e-6 * total
    for r in per:
        assert abs(r["taken"] - r["target"]) <= r["most"] and r["target"] <= 3 * r["size"] + 1e-6
    times = {(r["doc_id"]): r["times"] for r in first.collect()}
    taken = mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in taken} == {k: v for k, v in times.items() if v}


def test_pipeline_stages(spark, odd_dir, empty_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    names = docs.columns
    counts = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, odd_dir).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        counts.append(docs.count())
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    clean = spark.read.parquet(f"{tmp_path}/0")
    ids = {r["doc_id"] for r in clean.collect()}
    assert {5, 6, 7, 8, 9, 10, 11, 17} <= ids and not {0, 1, 2, 3, 4, 13, 16} & ids
    assert "A | B | C | D" not in clean.filter("doc_id = 17").first()["text"]
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[4] == counts[3]
    assert corpus_pipeline.run(spark, odd_dir).count() == counts[4]
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
