"""Deep-shallow sorting of byte strings inside groups.

Shallow: multikey quicksort, here by whole 8-byte words for all groups at once: a round orders
the strings that are still equal by their next word and splits their groups.  Strings that are
alone in their group are done.  Deep: what is still equal after the shallow depth has a long common
prefix; each such group is ordered by a blind trie, which looks at one byte per branch on the way
down and compares one whole string per insertion.
"""

from __future__ import annotations

import numpy as np

WORD_BYTES = 8
SHALLOW_WORDS = 8


def _common(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    differ = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    return size - (differ.bit_length() + 7) // 8


class _Branch:
    __slots__ = ("children", "depth")

    def __init__(self, depth: int):
        self.depth = depth
        self.children: dict[int, object] = {}


def _byte(key: bytes, depth: int) -> int:
    return key[depth] if depth < len(key) else -1


def blind_trie(keys: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the keys and, for each in that order, its common prefix with the one before (first: 0)."""
    root: object = [0]  # a leaf lists the numbers of equal keys
    for n in range(1, len(keys)):
        key, node = keys[n], root
        while isinstance(node, _Branch):
            node = node.children.get(_byte(key, node.depth)) or next(iter(node.children.values()))
        other = keys[node[0]]
        common = _common(key, other)
        if common == len(key) == len(other):
            node.append(n)
            continue
        above, node = None, root
        while isinstance(node, _Branch) and node.depth < common:
            above, node = node, node.children[_byte(key, node.depth)]
        if isinstance(node, _Branch) and node.depth == common:
            node.children[_byte(key, common)] = [n]
            continue
        branch = _Branch(common)
        branch.children[_byte(other, common)] = node
        branch.children[_byte(key, common)] = [n]
        if above is None:
            root = branch
        else:
            above.children[_byte(key, above.depth)] = branch
    order: list[int] = []
    shared: list[int] = []
    stack: list[tuple[object, int]] = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, _Branch):
            names = sorted(node.children)
            for name in names[:0:-1]:
                stack.append((node.children[name], node.depth))
            stack.append((node.children[names[0]], depth))
        else:
            order += node
            shared += [depth] + [len(keys[node[0]])] * (len(node) - 1)
    return order, shared


def deep_shallow(keys: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, key), and common prefix of each with the one before it (0 at a group's start).

    groups: ascending integers.
    """
    count = len(keys)
    width = SHALLOW_WORDS * WORD_BYTES
    heads = np.frombuffer(b"".join(k[:width].ljust(width, b"\0") for k in keys), ">u8")
    heads = heads.reshape(count, SHALLOW_WORDS).astype(np.uint64)
    lengths = np.fromiter(map(len, keys), np.int64, count)
    order, label = np.arange(count), np.asarray(groups).copy()
    starts = np.ones(count, bool)
    if count:
        starts[1:] = label[1:] != label[:-1]
    shared = np.zeros(count, np.int64)
    sizes = np.minimum(lengths, width)
    for depth in range(SHALLOW_WORDS + 1):
        part = np.cumsum(starts) - 1
        many = np.bincount(part)[part] > 1 if count else np.zeros(0, bool)
        if not many.any():
            break
        at = np.flatnonzero(many)
        # The last round parts strings that end inside the shallow depth from their zero-padded likes.
        word = heads[order[at], depth] if depth < SHALLOW_WORDS else sizes[order[at]].astype(np.uint64)
        sort = np.lexsort((word, part[at]))
        order[at], word = order[at][sort], word[sort]
        new = (word[1:] != word[:-1]) & (part[at][1:] == part[at][:-1])
        where = at[1:][new]
        if depth < SHALLOW_WORDS:
            differ = word[1:][new] ^ word[:-1][new]
            lead = sum((differ < (1 << 8 * k)).astype(np.int64) for k in range(1, WORD_BYTES))
            shared[where] = depth * WORD_BYTES + lead
        else:
            shared[where] = width
        starts[where] = True
    part = np.cumsum(starts) - 1
    edges = np.flatnonzero(starts)
    for a, b in zip(edges, [*edges[1:], count]):
        if b - a < 2:
            continue
        own = order[a:b]
        sub, depths = blind_trie([keys[n] for n in own])
        order[a:b] = own[sub]
        shared[a + 1 : b] = depths[1:]
    own = lengths[order]
    shared[1:] = np.minimum(shared[1:], np.minimum(own[1:], own[:-1]))  # padding is no common prefix
    return order, shared
