"""Language identification from averaged hashed subword embeddings.

Texts become lower-case letters with one separator for anything else.  Every run of 2, 3 or 4
characters inside a word, its separators included, has a hashed embedding; the average of a
text's embeddings goes through a linear softmax.  Both layers are trained by stochastic gradient descent in numpy.
Averaging and the linear layer commute, so a prediction only sums rows of the product of both
tables.  Whole texts and short excerpts of a part of the sample that is not trained on give the temperature of the softmax and the
score below which a prediction is marked as rejected.

Training reads a bounded sample: at most `SAMPLE_PER_LABEL` labelled rows of each language, whole
texts, chosen by a hash of the id (a documented parameter).  Prediction reads every whole text of
every row; texts are taken in slices that end between words, so memory is bounded.

Defined cases: null text or text without letters: `und` with score 0; null labels are not
learned; without any labelled row everything is `und`; ties go to the smaller label; repeated rows
get equal results; an empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

import functools
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from riskloom.llm.shared import table

SAMPLE_PER_LABEL = 600
BUCKET_BITS, DIMENSIONS = 16, 16
EPOCHS, RATE = 6, 0.5
SIZES = (2, 3, 4)
SLICE_CHARS = 1 << 20
UNKNOWN = "und"
EXCERPT_WORDS = (1, 3, 6, 12)
REJECTED_SHARE = 0.01  # of right predictions on the calibration part
MIX = np.uint32(0x9E3779B1)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(n).isalpha() for n in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword and, ascending, the number of the text that it is in."""
    parts = [_points(" " + t.lower() + " ") for t in texts]
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    points = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    letter = _letters()[points]
    first = np.ones(len(points), bool)
    first[1:] = owner[1:] != owner[:-1]
    keep = letter | first
    keep[1:] |= letter[:-1]
    points, letter, owner = np.where(letter, points, 32)[keep].astype(np.uint32), letter[keep], owner[keep]
    buckets, owners = [], []
    shift = np.uint32(32 - BUCKET_BITS)
    for size in SIZES:
        if len(points) < size:
            continue
        count = len(points) - size + 1
        value = np.full(count, size, np.uint32)
        inside = np.ones(count, bool)
        for n in range(size):
            value = (value + points[n : n + count]) * MIX
            value ^= value >> np.uint32(15)
            if 0 < n < size - 1 or size == 2:
                inside &= letter[n : n + count]
        inside &= letter[1 : 1 + count]
        buckets.append(((value * MIX) >> shift)[inside])
        owners.append(owner[:count][inside])
    order = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    found = np.concatenate(buckets) if buckets else np.zeros(0, np.uint32)
    return found, order


def slices(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > SLICE_CHARS:
        cut = text.rfind(" ", start + 1, start + SLICE_CHARS)
        cut = cut if cut > start else start + SLICE_CHARS
        yield text[start:cut]
        start = cut
    yield text[start:]


def scores(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows of `weights` over each text's subwords, and their number."""
    sums = np.zeros((len(texts), weights.shape[1]))
    counts = np.zeros(len(texts), np.int64)
    pending: list[tuple[int, str]] = []

    def flush() -> None:
        found, owner = subwords([t for _, t in pending])
        at = np.array([n for n, _ in pending])
        if len(found):
            for c in range(weights.shape[1]):
                np.add.at(sums[:, c], at, np.bincount(owner, weights[found, c], minlength=len(at)))
            np.add.at(counts, at, np.bincount(owner, minlength=len(at)))
        pending.clear()

    size = 0
    for n, text in enumerate(texts):
        for part in slices(text):
            pending.append((n, part))
            size += len(part)
            if size >= SLICE_CHARS:
                flush()
                size = 0
    if pending:
        flush()
    return sums, counts


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def excerpts(text: str, random: np.random.Generator) -> list[str]:
    """The text and short runs of its words: whole texts alone are too easy to calibrate on."""
    words = text.split()
    starts = [(int(random.integers(0, max(1, len(words) - n + 1))), n) for n in EXCERPT_WORDS]
    return [text, *(" ".join(words[a : a + n]) for a, n in starts)]


def train(texts: list[str], labels: list[str], seed: int = 7) -> dict:
    """Model: labels, weights (bucket x label), temperature, least score."""
    names = sorted(set(labels))
    want = np.array([names.index(x) for x in labels])
    random = np.random.default_rng(seed)
    embed = random.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    linear = random.normal(0, 0.1, (DIMENSIONS, len(names)))
    bags = []
    for text in texts:
        found, _ = subwords(list(slices(text)))
        bucket, times = np.unique(found, return_counts=True)
        bags.append((bucket, times / max(1, times.sum())))
    order = random.permutation(len(texts))
    aside, learned = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(aside):
        aside = learned
    steps, total = 0, EPOCHS * max(1, len(learned))
    for _ in range(EPOCHS):
        for n in random.permutation(learned):
            bucket, share = bags[n]
            rate = RATE * (1 - steps / total)
            steps += 1
            if not len(bucket):
                continue
            mean = share @ embed[bucket]
            error = _softmax(mean @ linear)
            error[want[n]] -= 1
            back = linear @ error
            linear -= rate * np.outer(mean, error)
            # An average has many shares; scaling by their number keeps the step of each word alike.
            embed[bucket] -= rate * (share * len(bucket))[:, None] * back
    weights = (embed @ linear).astype(np.float32)
    short = [(part, want[n]) for n in aside for part in excerpts(texts[n], random)]
    sums, counts = scores([part for part, _ in short], weights)
    logits, right = sums / np.maximum(counts, 1)[:, None], np.array([w for _, w in short])
    likely = lambda t: -np.log(_softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=likely)
    chance = _softmax(logits / temperature)
    hits = chance.max(axis=1)[chance.argmax(axis=1) == right]
    least = float(np.quantile(hits, REJECTED_SHARE)) if len(hits) else 0.0
    return {"labels": names, "weights": weights, "temperature": float(temperature), "least": least}


def held_out() -> Column:
    """Rows that are never learned from."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def fit(documents: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> dict | None:
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # An id can come with many texts and a text more than once: the sample is of different (doc_id, lang, text).
    key = F.xxhash64("text")
    dealt = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "_text"), "doc_id", "_text")
    chosen = (
        labelled.select("doc_id", "lang", key.alias("_text")).distinct().withColumn("n", F.row_number().over(dealt))
        .filter(F.col("n") <= per_label)
        .select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "_text")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (key == F.col("_text"))
    sample = labelled.select("doc_id", "lang", "text").join(chosen, same).dropDuplicates(["_id", "_lang", "_text"]).select(
        "doc_id", "lang", "text"
    )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "lang", "text"])
        model = train(group["text"].tolist(), group["lang"].tolist())
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    sample = sample.withColumn("_all", F.lit(1))
    one = sample.groupBy("_all").applyInPandas(learn, "model binary").first()
    return pickle.loads(one["model"]) if one else None


def predict(documents: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row, from the text alone."""
    schema = T.StructType(
        [
            documents.schema["doc_id"], T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if model is None:
                names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
                rejected = np.ones(len(texts), bool)
            else:
                sums, counts = scores(texts, model["weights"])
                chance = _softmax(sums / np.maximum(counts, 1)[:, None] / model["temperature"])
                worded = np.array([n > 0 or any(c.isalpha() for c in t) for n, t in zip(counts, texts)], bool)
                best = np.where(worded, chance.max(axis=1), 0.0)
                at = chance.argmax(axis=1)
                names = [model["labels"][a] if w else UNKNOWN for a, w in zip(at, worded)]
                rejected = ~worded | (best < model["least"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(rejected)],
                schema.names,
            )

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, fit(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
