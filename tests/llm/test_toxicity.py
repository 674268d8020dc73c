import random

from pyspark.sql import functions as F

from barloom.llm.toxicity import Lexicon, Model, allowed, drop_toxic, features, fit, in_fold, score


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    terms = ["idiot", "scum", "pathetic", "disgusting", "idiom", "loser"]
    lexicon = Lexicon([(t, False) for t in terms])
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "i", "s", "t"])
        w = "".join(w)
        near = [distance(w, t) for t in terms if distance(w, t) <= allowed(t)]
        found = lexicon.match(w)
        assert (found is None) == (not near), w
        if near:
            assert found[1] == min(near) == distance(w, terms[found[0]])


def test_stems_and_context():
    lexicon = Lexicon([("idiot", False), ("vequ", True)])
    assert lexicon.match("vequxyz") == (1, 0) and lexicon.match("veq") is None
    run = lambda t: features(t, lexicon, [1, 1], [2.0, 2.0], {})
    assert run("you idiot!")[1] > 0 and run("you idiot!")[2] == 0
    assert run('he wrote that "idiot" is rude')[2] > 0 and run('he wrote that "idiot" is rude')[1] == 0
    assert run("an 1d1ot")[1] > 0 and run("an idioot")[3] > 0
    assert run(None) == run("") == [0.0] * 6


def made(spark, n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = ["w%d" % rng.randrange(300) for _ in range(40)]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["grobian", "zzork" + rng.choice(["a", "b", "cc", "dd"])])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = made(spark)
    model = fit(docs, labels)
    got = score(docs, model).join(labels, "doc_id").where(in_fold(F.col("doc_id"), 0)).collect()
    assert len(got) > 80 and sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    # labels of the held-out fold have no influence
    other = labels.withColumn("toxic", F.when(in_fold(F.col("doc_id"), 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fit(docs, other).terms == model.terms


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", None), (3, "You stupid idiot, " * 3000, None), (3, "x", None), (3, "x", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(docs, labels)
    assert [t for t, *_ in model.terms][0] == "idiot"
    got = sorted((r.doc_id, r.predicted) for r in score(docs, model).collect())
    assert got == [(1, 0), (2, 0), (3, 0), (3, 0), (3, 1)]
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 3]
    assert score(docs.limit(0), Model(model.terms)).count() == 0
