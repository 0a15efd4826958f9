"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file maps byte strings to ids.  The library works on characters, so every byte has a
printable character; merges are all splits of a token into two tokens, in the order of the token's
rank, which gives the merges a rank-driven encoder makes.  Texts are cut where the pattern always
begins a new match (a space after a non-space), so a text of any length is encoded in bounded
pieces.  A match that a worker has met before is not encoded again: ids of up to `KNOWN_WORDS`
matches are remembered.

Each document is one row in and one row out; nothing is shuffled.

Defined cases: null text is empty (no tokens); repeated rows give equal results; an empty table
gives no rows; further columns are kept or passed over, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskloom.llm.shared import table

PIECE_CHARS = 1 << 16
KNOWN_WORDS = 300_000


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits text before merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where it has one, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for one rank file and pattern; one per worker process."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_characters()
        spell = lambda token: "".join(chars[b] for b in token)
        merges = [
            (spell(token[:cut]), spell(token[cut:]))
            for token in sorted(ranks, key=ranks.get)
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        model = models.BPE({spell(t): n for t, n in ranks.items()}, merges, ignore_merges=True, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.matches = regex.compile(pattern).findall
        byte_of = {c: b for b, c in enumerate(chars)}
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for n in range(len(self.table)):
            token = self.tokenizer.id_to_token(n)
            self.table[n] = bytes(byte_of[c] for c in token) if token else b""
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> Iterator[str]:
        """Cuts before a space that follows a non-space: a new match begins there in any case."""
        start = 0
        while len(text) - start > PIECE_CHARS:
            at = text.find(" ", start + PIECE_CHARS)
            while at > 0 and text[at - 1].isspace():
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def _learn(self, words: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        for word, e in zip(words, found, strict=True):
            self.known[word] = np.asarray(e.ids, dtype="<u4").tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        matches = self.matches(piece)
        try:
            return b"".join(map(self.known.__getitem__, matches))
        except KeyError:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            self._learn([w for w in set(matches) if w not in self.known])
            return b"".join(map(self.known.__getitem__, matches))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) <= PIECE_CHARS:
            return self._encode_piece(text)
        return b"".join(map(self._encode_piece, self.pieces(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.encode(text), dtype="<u4").tolist()

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Code point span of each token; a token of part of a character has that character's span."""
        starts, spans, position = [], [], 0
        for n, char in enumerate(text):
            starts += [n] * len(char.encode())
        for i in self.ids(text):
            size = len(self.table[i])
            spans.append((starts[position], starts[position + size - 1] + 1))
            position += size
        return spans

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode_stream(self, batches: Iterator[Sequence[int]]) -> Iterator[str]:
        """Text of id batches; bytes of a character split over batches wait for the rest."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in batches:
            yield decoder.decode(self.decode_bytes(ids))
        yield decoder.decode(b"", final=True)


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_texts(
    rows: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """All columns of rows except the text, plus ids (array of int)."""
    usual = default_vocabulary()
    path, pattern = path or usual[0], pattern or usual[1]
    rest = [c for c in rows.columns if c != text]
    out = T.StructType([rows.schema[c] for c in rest] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = [own.encode(x or "") for x in batch.column(text).to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in found])
            ids = pa.LargeListArray.from_arrays(
                pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(found), "<i4"))
            ).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.select(rest).columns, ids], [*rest, "ids"])

    return rows.mapInArrow(run, out)


def decode_ids(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of rows plus bytes: the decoded bytes."""
    usual = default_vocabulary()
    path, pattern = path or usual[0], pattern or usual[1]
    out = T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            column = batch.column(ids)
            values, ends = column.flatten().to_pylist(), column.offsets.to_pylist()
            base = ends[0]
            decoded = [own.decode_bytes(values[a - base : b - base]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "bytes"]
            )

    return rows.mapInArrow(run, out)


def encoded_digests(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the bytes decoded from them."""
    usual = default_vocabulary()
    path, pattern = path or usual[0], pattern or usual[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                decoded = own.decode_bytes(np.frombuffer(ids, "<u4").tolist())
                of_bytes.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts, pa.int64()),
                    pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return rows.select("doc_id", "text").mapInArrow(run, out)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))
