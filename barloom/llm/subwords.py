"""Quality by supervised subword embeddings: hashed vectors of words and their n-grams, averaged, then a softmax.

A text's features are, for each of its words (runs of anything but ASCII white
space, as UTF-8 bytes, in angle brackets), the word itself and its n-grams of
3 to 5 bytes; each has a hashed vector. Of pairs of neighbouring words those of
one and the same word are a feature, which all words share. The mean vector of
all features of the whole text goes through a linear layer and a softmax over
the two labels. All vectors and the layer are learnt by stochastic gradient
descent, in numpy, with step sizes that shrink for each vector by the squares it
has been moved by.

The fit sees a bounded sample of labelled rows (``SAMPLE``), whose features are
counted by tasks; scoring sees every row. A word's vectors are added up once and
kept for the words that follow, so that common words cost one look-up.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .toxicity import in_fold

#: Labelled rows of each label that the model is fitted on, at most.
SAMPLE = 1_000
BUCKETS = 1 << 16
SIZES = (3, 4, 5)
DIM = 8
EPOCHS = 5
RATE = 0.1
#: The bucket of a word that follows itself.
REPEAT = zlib.crc32(b"<=>") % BUCKETS
#: Labels whose crc32(doc_id) mod FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Bytes of words that are hashed at once, bytes of texts that are split at once, and words whose sums a task keeps.
PIECE, SLICE, KNOWN = 1 << 20, 1 << 20, 200_000


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): the buckets of the n-grams and of the word itself, for each of ``words`` by its number; sorted by owner."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # bytes from here to the word's end
    owners, buckets = [np.arange(len(words))], [np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % BUCKETS]
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = (h * np.uint32(16_777_619)) ^ text[at + k]
        owners.append(of[at])
        buckets.append(((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def pieces(words: list[bytes]) -> Iterator[list[bytes]]:
    """``words`` in lists of about PIECE bytes."""
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w) + 2
        if size >= PIECE:
            yield part
            part, size = [], 0
    if part:
        yield part


def counted(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, times) of a text's features."""
    total = np.zeros(BUCKETS, np.int64)
    split = (text or b"").split()
    total[REPEAT] = sum(map(bytes.__eq__, split[1:], split))
    words = Counter(split)
    for part in pieces(list(words)):
        owner, bucket = features(part)
        total += np.bincount(bucket, weights=np.array([words[w] for w in part], float)[owner], minlength=BUCKETS).astype(np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    """vectors: of each bucket; layer and bias: of the two labels."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def probability(self, mean: np.ndarray) -> np.ndarray:
        """Softmax for label 1 of mean vectors, one in each row."""
        z = mean @ self.layer + self.bias
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], weights: list[float], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """A model of feature counts and labels by stochastic gradient descent, one text at a time."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), rng.uniform(-1 / DIM, 1 / DIM, (DIM, 2)), np.zeros(2))
    moved, layer_moved, bias_moved = np.full((BUCKETS, DIM), 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(texts)):
            bucket, times = texts[i]
            share = times / max(1, times.sum())
            mean = share @ model.vectors[bucket]
            p = model.probability(mean[None])[0]
            slope = weights[i] * (np.array([1 - p, p]) - (np.arange(2) == labels[i]))
            down = model.layer @ slope
            grad = np.outer(mean, slope)
            layer_moved += grad**2
            bias_moved += slope**2
            model.layer -= step * grad / np.sqrt(layer_moved)
            model.bias -= step * slope / np.sqrt(bias_moved)
            grad = share[:, None] * down
            squares = moved[bucket] + grad**2
            moved[bucket] = squares
            model.vectors[bucket] -= step * grad / np.sqrt(squares)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """A model from at most ``sample`` rows of each label outside the fold ``held_out``, weighted as the labels are frequent.

    Rows with a NULL key or label are left out; of a key with several labels the
    larger one counts, of one with several texts the least. Without rows of both
    labels the model gives every text the share of the ones, smoothed.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~in_fold(F.col(key), held_out, folds)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    there = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(np.zeros((BUCKETS, DIM)), np.zeros((DIM, 2)), np.log([1 - share, share]))
    chosen = None
    for y in (0, 1):
        own = marked.where(F.col("label") == y).orderBy(F.xxhash64("key"), "key").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = there.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counted(t.encode() if t is not None else None) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"].astype(str), "label": batch["label"], "bucket": [b.astype(np.uint16).tobytes() for b, _ in found], "times": [t.astype(np.int32).tobytes() for _, t in found]})

    seen = sorted(tuple(r) for r in rows.mapInPandas(count, "key string, label int, bucket binary, times binary").collect())
    if {r[1] for r in seen} != {0, 1}:
        return Model(np.zeros((BUCKETS, DIM)), np.zeros((DIM, 2)), np.log([counts[0] + 1, counts[1] + 1]))
    taken = Counter(r[1] for r in seen)
    weights = [counts[y] / sum(counts.values()) / (taken[y] / len(seen)) for _, y, *_ in seen]
    texts = [(np.frombuffer(bytes(b), np.uint16).astype(np.int64), np.frombuffer(bytes(t), np.int32)) for *_, b, t in seen]
    return train(texts, [y for _, y, *_ in seen], weights)


class Scorer:
    """Mean vectors of texts; the sums of words that were seen are kept."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.sums, self.sizes = np.zeros((KNOWN, DIM)), np.zeros(KNOWN)

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > len(self.sizes):
            self.known.clear()
            if len(words) > len(self.sizes):  # more words than are kept, in one long text
                self.sums, self.sizes = np.zeros((len(words), DIM)), np.zeros(len(words))
        for part in pieces(list(words)):
            owner, bucket = features(part)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            at = len(self.known)
            self.sums[at : at + len(part)] = np.add.reduceat(self.model.vectors[bucket], first)
            self.sizes[at : at + len(part)] = np.diff(first, append=len(owner))
            self.known.update(zip(part, range(at, at + len(part)), strict=True))

    def means(self, texts: list[bytes | None]) -> np.ndarray:
        """The mean vector of each text, zeros for one without words."""
        out = np.zeros((len(texts), DIM))
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at + len(split) < len(texts) and size < SLICE:
                t = texts[at + len(split)] or b""
                split.append(t.split())
                size += len(t)
            new = {w for words in split for w in words if w not in self.known}
            if len(self.known) + len(new) > len(self.sizes):
                new = {w for words in split for w in words}
            if new:
                self._learn(new)
            for i, words in enumerate(split, at):
                if words:
                    ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                    again = np.count_nonzero(ids[1:] == ids[:-1])
                    out[i] = (self.sums[ids].sum(axis=0) + again * self.model.vectors[REPEAT]) / (self.sizes[ids].sum() + again)
            at += len(split)
        return out


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted, embedding) of each row: the probability of label 1, whether it is ``threshold`` or more, and the mean vector.

    NULL, empty and blank texts have a vector of zeros, so what the constant
    alone says. Texts are scored whole, whatever their length, one row for each
    row, NULL keys and repeated rows included; other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            means = scorer.means(batch.column(1).cast(pa.binary()).to_pylist())
            p = np.round(sent.value.probability(means), 9)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(means.ravel()), DIM).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), vectors], names=["key", "score", "predicted", "embedding"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, predicted int, embedding array<double>")
    return found.withColumnRenamed("key", key)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(in_fold(F.col("doc_id"), HELD_OUT, FOLDS), F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
