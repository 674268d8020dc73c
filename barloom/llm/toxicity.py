"""Toxicity scores from a lexicon that is matched with Levenshtein automata.

The lexicon is a trie of terms and of stems. Intersected with the Levenshtein
automaton of each entry it is one automaton, whose states (sets of trie node
and edits so far) are made deterministic as texts need them. It finds misspelt
terms in one pass over a word's letters. Around each hit a window of words
tells quotation from abuse: hits inside quotation marks, or near a word of
reporting, count as a feature of their own. A logistic regression on a handful
of features gives the score.

Terms, stems and weights are learnt from at most ``SAMPLE`` labelled rows,
taken in the order of a hash of their ids, from the training folds only. Only
words of 3 to 40 letters can become terms, and only with at least three toxic
holders and a surprise of 12 nats; so few labels may give no term of their own,
and the general terms decide.

Defined cases: NULL and empty texts are scored like texts without hits; a
document with several labels counts as toxic if any says so; unlabelled tables
leave the general terms and default weights; repeated rows give repeated rows;
rows of a NULL id are scored, never learnt from and have a NULL ``held_out``;
other columns are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE = 20_000  # labelled rows that terms and weights are learnt from, at most
SIDE = 6  # words on each side of a hit that are its window
STEMS = range(4, 9)  # letters of a stem
MOST_TIMES = 4  # a term may have to occur up to so many times to count

# General English terms of abuse, words of reporting, and letters that digits and signs stand for.
TERMS = ["idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "clown", "imbecile", "retard", "bastard", "bitch", "asshole", "fucking", "shit", "cretin", "vermin", "garbage"]
REPORTING = {"said", "says", "called", "calls", "wrote", "writes", "quote", "quoted", "quotes", "term", "word", "phrase", "alleged", "reported", "according"}
LEET = str.maketrans("013457@$!|", "oieastasil")
OPENING, CLOSING = "\"“«„", "\"”»“"

WORD = regex.compile(r"[^\W_]++(?:[@$*!|][^\W_]++)*+")
#: The same for the JVM, over lower-cased texts.
JVM_WORD = r"[\p{L}\p{N}]+"


def allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """The trie of ``entries`` (text, is_stem) with the automaton that accepts what is near them."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int | None] = [None]
        self.stem: list[int | None] = [None]
        self.budget: list[int] = [0]  # edits that some entry below a node allows
        for k, (text, is_stem) in enumerate(entries):
            at, most = 0, 0 if is_stem else allowed(text)
            self.budget[0] = max(self.budget[0], most)
            for c in text:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.budget.append(0)
                at = self.children[at][c]
                self.budget[at] = max(self.budget[at], most)
            (self.stem if is_stem else self.term)[at] = k
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []  # (entry, edits) if a word may end here
        self.stems: list[int | None] = []  # entry of a stem that has just been read
        self.dead = self._state({})
        self.start = self._state(self._close({0: 0}))

    def _close(self, reached: dict[int, int]) -> dict[int, int]:
        """Add what is reached by leaving out letters of an entry; keep the fewest edits of each node."""
        todo = list(reached.items())
        while todo:
            node, edits = todo.pop()
            if edits < self.budget[node]:
                for child in self.children[node].values():
                    if edits + 1 <= self.budget[child] and reached.get(child, 9) > edits + 1:
                        reached[child] = edits + 1
                        todo.append((child, edits + 1))
        return reached

    def _state(self, reached: dict[int, int]) -> int:
        key = frozenset(reached.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] is not None and e <= allowed(self.entries[self.term[n]][0])]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
            self.stems.append(min((self.stem[n] for n, e in key if e == 0 and self.stem[n] is not None), default=None))
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.budget[node] and reached.get(node, 9) > edits:
                reached[node] = edits

        for node, edits in self.members[state]:
            reach(node, edits + 1)
            for c, child in self.children[node].items():
                reach(child, edits + (c != letter))
        self.steps[state][letter] = s = self._state(self._close(reached))
        return s

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the nearest term, or of the first stem that the word begins with."""
        state, stem = self.start, None
        for c in word:
            following = self.steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if stem is None and self.stems[state] is not None:
                stem = self.stems[state]
            if state == self.dead:
                break
        found = self.accepts[state]
        return found if found and (stem is None or found[1] == 0) else None if stem is None else (stem, 0)


FEATURES = 6
#: Used where no labels can be learnt from.
DEFAULT = np.array([-4.0, 3.0, 1.0, 0.5, 0.3, 1.0, 0.5])


def _quoted(text: str, start: int, end: int, window: list[str]) -> bool:
    before, after = text[max(0, start - 60) : start], text[end : end + 60]
    inside = before.count('"') % 2 == 1 and '"' in after or any(before.rfind(o) > before.rfind(c) and c in after for o, c in zip(OPENING[1:], CLOSING[1:], strict=True))
    return inside or not REPORTING.isdisjoint(window)


def features(text: str | None, lexicon: Lexicon, least: list[int], weights: list[float], cache: dict) -> list[float]:
    """Of a text's hits: any, their weight as abuse, as quotation, as misspelling, number of different entries, share of words."""
    folded = (text or "").lower()
    abuse = quoted = fuzzy = 0.0
    entries = set()
    words = WORD.findall(folded)
    hits = []
    for k, w in enumerate(words):
        if w in cache:
            found = cache[w]
        else:
            if len(cache) >= 200_000:
                cache.clear()
            found = cache[w] = lexicon.match(w.translate(LEET) if not w.isalpha() else w)
        if found is not None:
            hits.append((k, found))
    times = Counter(entry for _, (entry, _) in hits)
    hits = [h for h in hits if times[h[1][0]] >= least[h[1][0]]]
    if hits:
        at = [(m.start(), m.end()) for m in WORD.finditer(folded)]
        for k, (entry, edits) in hits:
            if _quoted(folded, *at[k], words[max(0, k - SIDE) : k] + words[k + 1 : k + 1 + SIDE]):
                quoted += weights[entry]
            elif edits:
                fuzzy += weights[entry]
            else:
                abuse += weights[entry]
            entries.add(entry)
    return [float(abuse > 0), math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzy), math.log1p(len(entries)), math.log1p(100 * len(hits) / max(1, len(words)))]


def in_fold(key: Column, fold: int, folds: int = 5) -> Column:
    return F.crc32(key.cast("string")) % folds == fold


def _learn_terms(sample: DataFrame) -> list[tuple[str, bool, int, float]]:
    """(text, is_stem, least count, weight) of words and stems that toxic texts of the sample hold, so many times, far more often than chance lets others."""
    size, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == size:
        return []
    words = sample.select("doc_id", "toxic", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(JVM_WORD), F.lit(0))).alias("w")).where("length(w) between 3 and 40")
    words = words.groupBy("doc_id", "toxic", "w").agg(F.count("*").alias("times"))
    stems = words.select("doc_id", "toxic", "times", F.explode(F.transform(F.filter(F.array(*map(F.lit, STEMS)), lambda n: n <= F.length("w")), lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("w"))
    stems = stems.groupBy("doc_id", "toxic", "w").agg(F.sum("times").alias("times"))
    both = words.withColumn("stem", F.lit(False)).unionByName(stems.withColumn("stem", F.lit(True)))
    each = both.select("toxic", "w", "stem", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(MOST_TIMES)).cast("int"))).alias("least"))
    counts = each.groupBy("w", "stem", "least").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    base = toxic / size
    # how surprising it is that all but few holders are toxic, against a bound over all features of a sample
    surprise = F.col("k") * math.log(1 / base) - (F.col("n") - F.col("k")) * 3
    strong = counts.where((F.col("k") >= 3) & (F.col("k") >= 0.8 * F.col("n")) & (surprise > 12))
    # of a word or stem only the best least count can be kept; how many there are is bounded by the sample alone
    best = strong.groupBy("w", "stem").agg(F.min(F.struct((-surprise).alias("order"), "least", "n", "k")).alias("best")).select("w", "stem", "best.*")
    kept: dict[tuple[str, bool], tuple[int, float]] = {}
    starts: set[str] = set()  # the first letters of what is kept
    for r in best.orderBy("order", "stem", F.desc(F.length("w")), "w").collect():
        w, weight = r["w"], min(6.0, math.log((r["k"] + 0.5) / (r["n"] - r["k"] + 0.5)) - math.log(base / (1 - base)))
        if (w, False) in kept or (w, True) in kept or any((w[:n], True) in kept for n in STEMS) or r["stem"] and w in starts:
            continue
        starts |= {w[:n] for n in STEMS}
        kept[w, r["stem"]] = r["least"], weight
    return [(w, is_stem, least, x) for (w, is_stem), (least, x) in kept.items()]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression (first the constant), by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """terms: (text, is_stem, least count, weight); weights: of the constant and the features."""

    def __init__(self, terms: list[tuple[str, bool, int, float]], weights: np.ndarray = DEFAULT):
        self.terms, self.weights = terms, weights

    def runner(self) -> tuple[Lexicon, list[int], list[float], dict]:
        return Lexicon([(t, s) for t, s, *_ in self.terms]), [n for *_, n, _ in self.terms], [x for *_, x in self.terms], {}


def _feature_rows(docs: DataFrame, model: Model, key: str, text: str, extra: str = "") -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    others = [c.split()[0] for c in extra.split(", ")] if extra else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = model.runner()
        for batch in batches:
            x = np.array([features(t, *tools) for t in batch[text]]).reshape(len(batch), FEATURES)
            out = batch[[key, *others]].copy()
            for i in range(FEATURES):
                out[f"f{i}"] = x[:, i]
            yield out

    schema = f"{key} {kind}, " + (extra + ", " if extra else "") + ", ".join(f"f{i} double" for i in range(FEATURES))
    return docs.select(key, text, *others).mapInPandas(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 0) -> Model:
    """Terms and weights from at most ``sample`` labelled rows outside the fold ``held_out``."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), held_out)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").cache()
    general = [(t, False, 1, 3.0) for t in TERMS]
    learnt = _learn_terms(rows)
    known = {t for t, *_ in learnt}
    model = Model(learnt + [g for g in general if g[0] not in known])
    seen = _feature_rows(rows, model, "doc_id", "text", "toxic int").drop("doc_id").toPandas()
    rows.unpersist()
    if len(seen) and 0 < seen["toxic"].sum() < len(seen):
        model.weights = _fit(seen[[f"f{i}" for i in range(FEATURES)]].to_numpy(), seen["toxic"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of each row."""
    w = model.weights
    z = F.lit(float(w[0]))
    for i in range(FEATURES):
        z = z + F.lit(float(w[i + 1])) * F.col(f"f{i}")
    p = 1 / (1 + F.exp(-z))
    return _feature_rows(docs, model, key, text).select(key, p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the documents that are predicted to be toxic; all columns stay."""
    w = [float(x) for x in model.weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.runner()
        for batch in batches:
            keep = [w[0] + sum(a * b for a, b in zip(w[1:], features(t, *tools), strict=True)) < 0 for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", in_fold(F.col("doc_id"), 0).alias("held_out"), "score", "predicted")
