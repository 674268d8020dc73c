import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm.class_lm import CLASSES, END, op5_class_lm, score, suffix_unit, train


def made(n, seed=4):
    rng = random.Random(seed)
    sides = [["a%d" % i for i in range(60)], ["b%d" % i for i in range(60)]]
    rows = []
    for i in range(n):
        side = sides[rng.randrange(2)]
        words = [rng.choice(side) if rng.random() < 0.95 else "r%d" % rng.randrange(10**6) for _ in range(rng.randrange(1, 60))]
        rows.append((i, " ".join(words)))
    return rows


def test_base_and_held_out(spark, tmp_path):
    rows = [*made(400), (1000, None), (1001, ""), (1002, "A a\tÉ é"), (1002, "A a\tÉ é")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_class_lm(spark, str(tmp_path)).collect()
    split = lambda t: [*(w.decode() for w in (t or "").encode().lower().split()), END]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not fold(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, fold(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame(made(200), "doc_id long, text string")
    model, counts, discount, _ = train(docs)
    c = {r["word"]: r["n"] for r in counts.collect()}
    kind = lambda w: model.classes[model.units.index.get(w.encode(), suffix_unit(w.encode()))] if w != END else CLASSES
    t, z, u = 10**model.log_t, 10**model.log_z, 10**model.log_unknown
    for before in range(0, CLASSES + 1, 8):
        total = sum(t[before, kind(w)] * (n - discount) / z[kind(w)] for w, n in c.items()) + float((t[before] * u / z).sum())
        assert total == pytest.approx(1, abs=1e-9)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score(docs, train(docs.limit(0))).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score == got[1].base_score == pytest.approx(0)
    assert score(docs.limit(0), train(docs)).count() == 0


def test_classes_separate_contexts(spark):
    model, *_ = train(spark.createDataFrame(made(400), "doc_id long, text string"))
    a = {int(model.classes[model.units.index[b"a%d" % i]]) for i in range(60)}
    b = {int(model.classes[model.units.index[b"b%d" % i]]) for i in range(60)}
    assert not a & b and np.isfinite(model.log_t).all()
