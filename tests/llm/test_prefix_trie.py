"""The trie against plain Python: rebuilt conversations, splits at centroids, conversations over many tasks."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from riskloom.llm.prefix_trie import BLOCK, conversation_trie


def _rebuilt(rows, block):
    own = defaultdict(list)
    key = lambda r: (
        r[1] is not None, r[1] or 0, r[2] or "",
        hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest(),
    )
    for row in sorted((r for r in rows if r[0] is not None), key=key):
        own[row[0]].append((row[2] or "", row[3] or ""))
    if not block:
        return dict(own)
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (abs(conv) % block) * (1 if conv >= 0 else -1)
        out[conv] = own.get(base, [])[:h] + turns[h:]
    return out


def _expected(rows, block):
    held, ends = defaultdict(list), defaultdict(list)
    for conv, turns in _rebuilt(rows, block).items():
        ends[tuple(turns)].append(conv)
        for d in range(len(turns) + 1):
            held[tuple(turns[:d])].append(conv)
    children = defaultdict(int)
    for node in held:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in held.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(convs) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(c), len(n), min(held[n[:-1]]) if n else -999, len(c), children[n], leaves[n], saved[n], digest(ends[n]))
        for n, c in held.items()
    )


def _talk():
    rng = random.Random(6)
    rows = []
    for conv in [*range(-3, 60), *range(100, 130), 205, 310]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], rng.choice(["hi", "ho", "é🙂", "", "x" * 40])))
    rows += [(400, n, "user", f"t{n}") for n in range(300)]  # a long one, and a copy that leaves it late
    rows += [(401, n, "user", f"t{n}") for n in range(250)] + [(402, n, "user", f"t{n}") for n in range(300)]
    rows += [(500, 1, "a", "one"), (500, 1, "a", "one"), (500, None, None, None), (None, 0, "user", "no id"), (500, 1, "a", "b")]
    return rows


@pytest.mark.parametrize("block,local_nodes,parts", [(BLOCK, 4096, "4"), (BLOCK, 12, "7")])
def test_against_plain_python(spark, block, local_nodes, parts):
    rows = _talk()
    table = spark.createDataFrame(
        [r + (7,) for r in rows], "conv_id long, turn long, role string, text string, depth int"
    ).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = conversation_trie(table, block, local_nodes=local_nodes).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(tuple(-999 if v is None else v for v in r) for r in got) == _expected(rows, block)
