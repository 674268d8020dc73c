"""Language-model scores by Brown classes: a class bigram model from exchange clustering.

P(word | previous word) = P(class | previous class) * P(word | class).

Each training document is kept as unit numbers: one unit for each of the ``UNITS``
commonest words, and for the other words one of ``SUFFIXES`` units by their
last three bytes, so that every word has a class. The exchange steps move
units between classes: each step counts, over all documents, the classes
before and after every unit, and moves each unit to the class that gives the
training text the highest probability, given the class counts of that step.
Counts are added up in blocks of units, ``FAN`` tasks' counts at a time, in as
many levels as the number of tasks needs.

All word counts are kept in a table; the commonest ``FREQUENT`` words (a
threshold keeps them under that bound) travel to the tasks, the rest are joined.

Smoothing: absolute discounting within a class, whose freed mass is the class's
unknown word; class transitions are interpolated with class frequencies. The
probabilities of all words and of one unknown word for each class add up to 1.

Defined cases: NULL and empty texts have one token, their end; without any
training row the score is the base score; repeated rows count each time in
training and are scored apart; rows of a NULL id are scored, are never trained
on and have a NULL ``held_out``; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

CLASSES = 32
UNITS = 20_000
SUFFIXES = 4_096
FREQUENT = 100_000
STEPS = 5
BLOCK = 256  # units whose counts travel together
FAN = 32  # partial sums of a block that are added up at once
FLUSH = 1_000_000  # different words that a task counts before it passes them on
END = "\n"  # no word holds white space
PULL = 20.0  # how many observations the class frequencies are worth


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8; both bytes methods touch ASCII only."""
    return (text or "").encode().lower().split()


class _SuffixUnits(dict):
    def __missing__(self, suffix: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[suffix] = unit = UNITS + 1 + xxhash.xxh32_intdigest(suffix) % SUFFIXES
        return unit


_suffix_units = _SuffixUnits()


def suffix_unit(word: bytes) -> int:
    return _suffix_units[word[-3:]]


#: Unit UNITS is the end of a text; class CLASSES is its class.
N_UNITS = UNITS + 1 + SUFFIXES


def in_fold(key: Column, fold: int = 1, folds: int = 5) -> Column:
    return F.crc32(key.cast("string")) % folds == fold


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of a text is a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                seen.update((t or "").encode().lower().split())
            seen[END.encode()] += len(batch)
            if len(seen) >= FLUSH:
                yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})
                seen = Counter()
        if seen:
            yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})

    return docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int) -> tuple[list[tuple[str, int]], float]:
    """At most ``most`` words with the highest counts, above a threshold on the logarithm of counts; and that threshold."""
    level = F.floor(100 * F.log2(F.col("n").cast("double"))).cast("long")
    levels = counts.where(F.col("word") != END).groupBy(level.alias("level")).count().collect()  # 6,400 levels at most
    total, least = 0, math.inf
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    found = counts.where((F.col("word") != END) & (level >= (least if least < math.inf else 10**9))).collect()
    return sorted(((r["word"], r["n"]) for r in found), key=lambda x: (-x[1], x[0])), least


class Units:
    def __init__(self, frequent: list[tuple[str, int]]):
        self.index = {w.encode(): i for i, (w, _) in enumerate(frequent)}

    def encode(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        return np.array([i if (i := get(w, UNITS)) < UNITS else suffix_unit(w) for w in words] + [UNITS], np.int32)


def _unit_texts(docs: DataFrame, frequent: object) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = Units(frequent.value[:UNITS])
        for batch in batches:
            yield pd.DataFrame({"units": [units.encode(words_of(t)).tobytes() for t in batch["text"]]})

    return docs.select("text").mapInPandas(run, "units binary")


def _block_sums(texts: DataFrame, classes: np.ndarray) -> DataFrame:
    """(block, sums): of each unit of a block how often each class stands before and after it."""
    width = CLASSES + 1
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value.astype(np.int64)
        cells = np.zeros(N_UNITS * 2 * width, np.int64)
        for batch in batches:
            # texts one after another: the end of one is what stands before the next
            units = np.concatenate([np.array([UNITS], np.int32), *(np.frombuffer(u, np.int32) for u in batch["units"])]).astype(np.int64)
            kinds = of[units]
            cells += np.bincount(units[1:] * 2 * width + kinds[:-1], minlength=len(cells))
            cells += np.bincount(units[:-1] * 2 * width + width + kinds[1:], minlength=len(cells))
        part = TaskContext.get().partitionId()
        blocks = np.split(cells, range(BLOCK * 2 * width, len(cells), BLOCK * 2 * width))
        yield pd.DataFrame([(b, part, x.tobytes()) for b, x in enumerate(blocks) if x.any()], columns=["block", "part", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in group["sums"]], axis=0)
        return group[["block", "part"]].head(1).assign(sums=total.tobytes())

    kind = "block int, part int, sums binary"
    sums, parts = texts.mapInPandas(count, kind), texts.rdd.getNumPartitions()
    while True:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("block", "part").applyInPandas(add, kind)
        parts = -(-parts // FAN)
        if parts <= 1:
            return sums.select("block", "sums")


def _transitions(sums: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each, of fixed size."""
    width = CLASSES + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width), np.int64)
        for batch in batches:
            for block, raw in zip(batch["block"], batch["sums"], strict=True):
                before = np.frombuffer(raw, np.int64).reshape(-1, 2, width)[:, 0]
                np.add.at(total.T, classes[block * BLOCK : block * BLOCK + len(before)], before)
        at = np.argwhere(total)
        yield pd.DataFrame({"a": at[:, 0], "b": at[:, 1], "n": total[total > 0]})

    out = np.zeros((width, width))
    for r in sums.mapInPandas(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[r["a"], r["b"]] = r["n"]
    return out


def _smooth(pairs: np.ndarray) -> np.ndarray:
    """P(class | previous class), by rows."""
    share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * len(pairs))
    return (pairs + PULL * share) / (pairs.sum(1, keepdims=True) + PULL)


def _exchange(sums: DataFrame, classes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Each unit's best class, given the counts of this step."""
    width = CLASSES + 1
    log_p = np.log(_smooth(pairs))
    log_n = np.log(pairs.sum(0) + 0.5)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, raw in zip(batch["block"], batch["sums"], strict=True):
                x = np.frombuffer(raw, np.int64).reshape(-1, 2, width).astype(float)
                before, after = x[:, 0], x[:, 1]
                gain = (before @ log_p + after @ log_p.T - before.sum(1, keepdims=True) * log_n)[:, :CLASSES]
                unit = np.arange(block * BLOCK, block * BLOCK + len(x))
                best = gain.argmax(1)
                yield pd.DataFrame({"unit": unit, "best": best})[(unit != UNITS) & (before.sum(1) > 0)]

    out = classes.copy()
    for r in sums.mapInPandas(run, "unit int, best int").collect():  # N_UNITS rows at most
        out[r["unit"]] = r["best"]
    return out


def cluster(texts: DataFrame, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit and the class transition counts; starts from the units in turn, in order of frequency."""
    classes = np.arange(N_UNITS) % CLASSES
    classes[UNITS] = CLASSES
    for _ in range(steps):
        sums = stash(_block_sums(texts, classes), "sums")
        classes = _exchange(sums, classes, _transitions(sums, classes))
    return classes, _transitions(stash(_block_sums(texts, classes), "sums"), classes)


class Model:
    """What a task needs to score texts: classes, transitions and the frequent words' counts."""

    def __init__(self, frequent: list[tuple[str, int]], classes: np.ndarray, pairs: np.ndarray, types: np.ndarray, discount: float, n: int, v: int, ends: int):
        self.units = Units(frequent)
        self.classes, self.n, self.v = classes, n, v
        count = np.array([c for _, c in frequent], float)
        sizes = pairs.sum(0)
        self.log_t = np.log10(_smooth(pairs))
        self.log_z = np.log10(sizes + 0.5)
        self.log_unknown = np.log10(discount * types + 0.5)
        self.log_seen = np.log10(count - discount) if len(count) else count
        self.log_base = np.log10(count + 0.5)
        self.log_all = math.log10(n + 0.5 * (v + 1))
        self.log_end = math.log10(ends - discount) if ends else float(self.log_unknown[CLASSES])
        self.log_end_base = math.log10(ends + 0.5)
        self.known_end = int(ends > 0)

    def score(self, words: list[bytes]) -> tuple[int, int, float, float, dict[bytes, int]]:
        """(tokens, known, base score, score, others): without what the counts of the other words add."""
        get = self.units.index.get
        index = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        units = np.where(index < UNITS, index, -1)
        units = np.append(units, UNITS)
        for i in np.flatnonzero(units < 0):
            units[i] = suffix_unit(words[i])
        kinds = self.classes[units]
        before = np.concatenate([[CLASSES], kinds[:-1]])
        seen = index[index >= 0]
        score = self.log_t[before, kinds].sum() - self.log_z[kinds].sum() + self.log_seen[seen].sum() + self.log_end
        base = self.log_base[seen].sum() + self.log_end_base - (len(words) + 1) * self.log_all
        others = Counter(w for w, i in zip(words, index.tolist(), strict=True) if i < 0) if len(seen) < len(words) else {}
        return len(words) + 1, len(seen) + self.known_end, float(base), float(score), others


def train(docs: DataFrame) -> tuple[Model, DataFrame, float, float]:
    """The model, all word counts, the discount, and the level under which counts are joined."""
    spark = docs.sparkSession
    counts = stash(word_counts(docs), "counts")
    frequent, least = common_words(counts, FREQUENT)
    shared = spark.sparkContext.broadcast(frequent)
    classes, pairs = cluster(stash(_unit_texts(docs, shared), "units"))

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Units(shared.value[:UNITS]).index
        for batch in batches:
            words = [w.encode() for w in batch["word"]]
            kinds = [int(classes[UNITS if w == END.encode() else index[w] if w in index else suffix_unit(w)]) for w in words]
            yield batch.assign(kind=kinds).groupby("kind")["n"].agg(types="count", n="sum", ones=lambda x: (x == 1).sum(), twos=lambda x: (x == 2).sum()).reset_index()

    rows = counts.mapInPandas(tell, "kind int, types long, n long, ones long, twos long").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("types", "n", "ones", "twos"))).collect()
    types = np.zeros(CLASSES + 1)
    for r in rows:
        types[r["kind"]] = r["types"]
    ones, twos = sum(r["ones"] for r in rows), sum(r["twos"] for r in rows)
    discount = min(0.9, max(0.1, (ones + 0.5) / (ones + 2 * twos + 1)))
    ends = counts.where(F.col("word") == END).select("n").first()
    model = Model(frequent, classes, pairs, types, discount, int(sum(r["n"] for r in rows)), int(types.sum()), ends["n"] if ends else 0)
    return model, counts, discount, least


def score(docs: DataFrame, trained: tuple[Model, DataFrame, float, float], key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    model, counts, discount, _ = trained
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch["text"], strict=True):
                tokens, known, base, total, others = m.score(words_of(t))
                unseen = [float(m.log_unknown[m.classes[suffix_unit(w)]]) for w in others]
                rows.append((k, tokens, known, base, total, [w.decode() for w in others], list(others.values()), unseen))
            yield pd.DataFrame(rows, columns=[key, "n_tokens", "known", "base", "total", "words", "times", "unseen"])

    local = docs.select(key, "text").mapInPandas(run, f"{key} {kind}, n_tokens long, known long, base double, total double, words array<string>, times array<long>, unseen array<double>")
    local = stash(local.withColumn("row", F.monotonically_increasing_id()), "local")
    rest = local.select("row", F.explode(F.arrays_zip("words", "times", "unseen")).alias("x")).select("row", "x.*").join(counts, F.col("words") == F.col("word"), "left")
    c = F.coalesce("n", F.lit(0)).cast("double")
    added = rest.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("more_base"),
        F.sum(F.col("times") * F.when(c > 0, F.log10(c - discount)).otherwise(F.col("unseen"))).alias("more"),
    )
    zero = F.lit(0.0)
    base = F.col("base") + F.coalesce("more_base", zero)
    total = F.col("total") + F.coalesce("more", zero)
    return local.drop("words", "times", "unseen").join(added, "row", "left").select(
        key, "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), (total if model.n else base).alias("score")
    )


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trained = train(docs.where(~in_fold(F.col("doc_id"))))
    out = score(docs, trained)
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
