"""Subword embeddings: features and scores against loops, held-out accuracy, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import subwords
from barloom.llm.subwords import BUCKETS, DIM, SIZES, Scorer, counted, fit, score
from barloom.llm.toxicity import in_fold


def plain_features(text):
    """The buckets of all features of a text, one after the other."""
    words = text.encode().split()
    out = [subwords.REPEAT for v, w in zip(words, words[1:]) if v == w]
    for w in words:
        out.append(zlib.crc32(w) % BUCKETS)
        marked = b"<" + w + b">"
        for n in SIZES:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h * 16_777_619 & 0xFFFFFFFF) ^ c
                out.append((h ^ (h >> 15)) % BUCKETS)
    return out


def plain_score(text, model):
    found = plain_features(text)
    mean = [sum(model.vectors[b][d] for b in found) / max(1, len(found)) for d in range(DIM)]
    z = [sum(mean[d] * model.layer[d][y] for d in range(DIM)) + model.bias[y] for y in (0, 1)]
    return 1 / (1 + math.exp(z[0] - z[1]))


def made(spark, n=500, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["w%d" % rng.randrange(300) for _ in range(rng.randrange(5, 60))]
        good = rng.random() < 0.8
        if not good:
            words = [w + rng.choice(["%%%", "***"]) if rng.random() < 0.5 else w for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def random_text(rng):
    return "".join(rng.choice(["a", "B", "é", "漢", "<", ">", " ", " ", "a a", "\n", "\x1c", "\x0b", " ", "😀", "%"]) for _ in range(rng.randrange(60)))


def test_features_equal_loops():
    rng = random.Random(2)
    for _ in range(300):
        t = random_text(rng)
        bucket, times = counted(t.encode())
        assert dict(zip(bucket.tolist(), times.tolist(), strict=True)) == Counter(plain_features(t)), repr(t)
    assert not len(counted(None)[0]) and not len(counted(b" \n")[0])


def test_scores_equal_loops(monkeypatch):
    rng = random.Random(4)
    texts = [random_text(rng) for _ in range(200)] + ["", "word " * 3000]
    model = subwords.train([counted(t.encode()) for t in texts], [i % 2 for i in range(len(texts))], [1.0] * len(texts), epochs=2)
    want = [plain_score(t, model) for t in texts]
    sent = [t.encode() for t in texts] + [None]
    assert np.allclose(model.probability(Scorer(model).means(sent)), [*want, want[-2]])
    for name, value in (("KNOWN", 5), ("SLICE", 40), ("PIECE", 8)):  # words are forgotten, texts and words come in many parts
        monkeypatch.setattr(subwords, name, value)
    assert np.allclose(model.probability(Scorer(model).means(sent)), [*want, want[-2]])


def test_held_out_accuracy(spark):
    docs, labels = made(spark)
    model = fit(docs, labels)
    seen = score(docs, model).join(labels, "doc_id").where(in_fold(F.col("doc_id"), 2, 4)).toPandas()
    assert len(seen) > 80 and (seen["predicted"] == seen["quality"]).mean() > 0.97
    assert seen.loc[seen["quality"] == 1, "score"].mean() > 0.9 > 0.4 > seen.loc[seen["quality"] == 0, "score"].mean()


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs, labels = made(spark, 200)
    turned = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).where(in_fold(labels["doc_id"], 2, 4)).unionByName(labels.where(~in_fold(labels["doc_id"], 2, 4)))
    a, b = fit(docs, labels), fit(docs, turned)
    assert (a.vectors == b.vectors).all() and (a.layer == b.layer).all()


def test_odd_rows(spark):
    docs, labels = made(spark, 200)
    odd = [(None, "w1 w2"), (1001, None), (1002, ""), (1003, " \n"), (1004, "x" * 3_000_000), (1005, "w1 " * 400_000), (1005, "w1 " * 400_000), (1006, "\x00 é")]
    both = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 AS key", "2 AS score", "3 AS label")
    strange = labels.union(spark.createDataFrame([(None, 1), (1001, None), (1002, 7), (9999, 0), (3, 0), (3, 1)], labels.schema)).selectExpr("*", "4 AS text")
    rows = score(both, fit(both, strange)).collect()
    assert len(rows) == 208 and all(0 <= r["score"] <= 1 and len(r["embedding"]) == DIM for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (1001, 1002, 1003)}
    assert len(empty) == 1 and len({r["score"] for r in rows if r["doc_id"] == 1005}) == 1


@pytest.mark.parametrize("given,share", [([], 0.5), ([(i, 1) for i in range(20)], None)])
def test_without_both_labels(spark, given, share):
    docs, labels = made(spark, 20)
    model = fit(docs, spark.createDataFrame(given, labels.schema))
    found = {r["score"] for r in score(docs, model).collect()}
    assert len(found) == 1 and (share is None or abs(found.pop() - share) < 1e-9)
    assert score(docs.limit(0), model).count() == 0
