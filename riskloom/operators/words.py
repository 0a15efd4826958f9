"""Which rules can match a line: a search for many words at once over the bytes of all lines.

Carried to the workers by value, so it uses nothing of this package.
"""

import numpy as np
import pyarrow as pa

HEAD = 8  # so many bytes of a word are looked up at once
CHUNK_BYTES = 1 << 20
_HASH_BITS = 20
_HASH = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _hashed(keys: np.ndarray) -> np.ndarray:
    return (keys * _HASH) >> np.uint64(64 - _HASH_BITS)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … for count[0] numbers, then those of the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def _distinct(values: np.ndarray) -> np.ndarray:
    """In order, each once; by sorting, which is faster here than the hash table of np.unique."""
    values = np.sort(values)
    first = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


class Words:
    """Distinct words, lower case in A-Z; finds which of them each line has."""

    def __init__(self, words: list[bytes]):
        self.count = len(words)
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        # The first three bytes of a word say by one bit each which lengths are worth a look there.
        self.table = np.zeros(1 << 24, dtype=np.uint8)
        padded = [w + bytes(-len(w) % HEAD) for w in words]
        self.parts = np.frombuffer(b"".join(padded), dtype="<u8")
        self.first_part = np.cumsum([0] + [len(p) // HEAD for p in padded])[:-1]
        self.by_size = []
        for size in range(1, HEAD + 1):
            own = np.flatnonzero(np.minimum(self.sizes, HEAD) == size)
            if not len(own):
                continue
            for n in own:
                at = int.from_bytes(words[n][:3].ljust(3, b"\0"), "big")
                self.table[at : at + (1 << 8 * max(3 - size, 0))] |= np.uint8(1 << size - 1)
            heads = self.parts[self.first_part[own]]
            order = np.argsort(heads, kind="stable")
            keys, first, count = np.unique(heads[order], return_index=True, return_counts=True)
            seen = np.zeros(1 << _HASH_BITS, dtype=bool)
            seen[_hashed(keys)] = True
            self.by_size.append((size, keys, seen, first, count, own[order]))

    def on_lines(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """line * number of words + word, each once and in order; lines end at ``ends`` in ``text``."""
        low = np.zeros(len(text) + HEAD, dtype=np.uint8)
        np.take(_LOWER, text, out=low[: len(text)])
        code = low[: len(text)].astype(np.uint32)
        for n in (1, 2):
            code <<= 8
            code |= low[n : len(text) + n]
        lengths = self.table[code]
        at = np.flatnonzero(lengths)
        lengths = lengths[at]
        line = np.searchsorted(ends, at, side="right")
        room = ends[line] - at
        eight = np.ndarray((len(text) + 1,), "<u8", low, strides=(1,))
        heads = eight[at]
        found = []
        for size, keys, seen, first, count, words in self.by_size:
            here = np.flatnonzero((lengths & np.uint8(1 << size - 1)).astype(bool) & (room >= size))
            head = heads[here] & _mask(size)
            maybe = seen[_hashed(head)]
            here, head = here[maybe], head[maybe]
            entry = np.minimum(np.searchsorted(keys, head), len(keys) - 1)
            same = keys[entry] == head
            here, entry = here[same], entry[same]
            word = words[_ranges(first[entry], count[entry])]
            here = np.repeat(here, count[entry])
            whole = self.sizes[word] <= room[here]
            here, word = here[whole], word[whole]
            found.append(line[here] * self.count + word)
            if size == HEAD:
                rest, done = np.arange(len(word)), HEAD
                wrong = np.zeros(len(word), dtype=bool)
                while len(rest := rest[self.sizes[word[rest]] > done]):
                    left = np.minimum(self.sizes[word[rest]] - done, HEAD)
                    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (HEAD - left)).astype(np.uint64)
                    part = self.parts[self.first_part[word[rest]] + done // HEAD]
                    differs = (eight[at[here[rest]] + done] & mask) != part
                    wrong[rest[differs]] = True
                    rest, done = rest[~differs], done + HEAD
                found[-1] = found[-1][~wrong]
        return _distinct(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


class Needs:
    """Rules by what their matches contain: ``rules`` are (number, requirements), a requirement is a list of
    words, one of which must be in the line.  A rule without requirements can match every line."""

    def __init__(self, rules: list[tuple[int, list[list[str]]]]):
        rules = sorted(rules)
        ids: dict[bytes, int] = {}
        self.numbers = np.array([number for number, _ in rules], dtype=np.int32)
        self.free = np.array([n for n, (_, needs) in enumerate(rules) if not needs], dtype=np.int64)
        owner, sizes, words = [], [], []
        for n, (_, needs) in enumerate(rules):
            for need in needs:
                own = sorted({ids.setdefault(w.encode(), len(ids)) for w in need})
                owner.append(n)
                sizes.append(len(own))
                words.extend(own)
        self.owner, self.sizes = np.array(owner, dtype=np.int64), np.array(sizes, dtype=np.int64)
        self.words, self.first = np.array(words, dtype=np.int64), np.cumsum([0, *sizes])[:-1]
        self.rule_first = np.searchsorted(self.owner, np.arange(len(rules) + 1))
        self.known = Words(list(ids))

    def pairs(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """line * number of rules + rule, in order, for all rules whose requirements the line meets."""
        total, width = len(self.numbers), self.known.count
        found = [(np.arange(len(ends))[:, None] * total + self.free).ravel()]
        if width:
            keys = self.known.on_lines(text, ends)
            line, word = np.divmod(keys, width)
            lines = line[np.argsort(word, kind="stable")]
            count = np.bincount(word, minlength=width)
            before = np.cumsum(count) - count
            # A rule is looked up by the requirement that is rarest on these very lines.
            cost = np.add.reduceat(count[self.words], self.first)
            order = np.lexsort((cost, self.owner))
            _, head = np.unique(self.owner[order], return_index=True)
            chosen = order[head]
            chosen = chosen[cost[chosen] > 0]
            entry = _ranges(self.first[chosen], self.sizes[chosen])
            need = np.repeat(chosen, self.sizes[chosen])
            word = self.words[entry]
            need = np.repeat(need, count[word])
            line = lines[_ranges(before[word], count[word])]
            for step in range(int(np.max(np.diff(self.rule_first), initial=0))):
                other = self.rule_first[self.owner[need]] + step
                asked = np.flatnonzero((other < self.rule_first[self.owner[need] + 1]) & (other != need))
                met = np.zeros(len(asked), dtype=bool)
                other = other[asked]
                for n in range(int(np.max(self.sizes[other], initial=0))):
                    open_ = np.flatnonzero(~met & (n < self.sizes[other]))
                    query = line[asked[open_]] * width + self.words[self.first[other[open_]] + n]
                    at = np.minimum(np.searchsorted(keys, query), len(keys) - 1)
                    met[open_] = keys[at] == query
                kept = np.ones(len(need), dtype=bool)
                kept[asked[~met]] = False
                need, line = need[kept], line[kept]
            found.append(line * total + self.owner[need])
        return _distinct(np.concatenate(found))


def possible_rules(lines: pa.Array, needs: Needs) -> pa.Array:
    """Per list of lines: (index of a line, numbers of the rules that can match it) for lines with such rules."""
    flat = lines.values.cast(pa.large_string())
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    text = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    file_ends = lines.offsets.to_numpy().astype(np.int64)
    total = max(len(needs.numbers), 1)
    first, last = int(file_ends[0]), int(file_ends[-1])
    seen, sizes, numbers = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [needs.numbers[:0]]
    while len(needs.numbers) and first < last:
        # Lines are taken in chunks of bytes; one line at least.
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), last, first + max(CHUNK_BYTES // (8 * len(needs.free) + 1), 1))
        begin = offsets[first]
        pairs = needs.pairs(text[begin : offsets[end]], offsets[first + 1 : end + 1] - begin)
        line, rule = np.divmod(pairs, total)
        start = np.flatnonzero(np.diff(line, prepend=-1))
        seen.append(line[start] + first)
        sizes.append(np.diff(start, append=len(line)))
        numbers.append(needs.numbers[rule])
        first = end
    line = np.concatenate(seen)
    ends = pa.array(np.concatenate([[0], *sizes]).cumsum(), pa.int32())
    rules = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(numbers), pa.int32()))
    file = np.searchsorted(file_ends, line, side="right") - 1
    # Empty lists share their end with the next one: a line belongs to the last list that begins at or before it.
    index = pa.array(line - file_ends[file], pa.int32())
    ends = pa.array(np.searchsorted(line, file_ends), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([index, rules], names=["line", "rules"]))
