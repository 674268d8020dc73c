import random
from collections import defaultdict

import numpy as np
import pytest

from barloom.llm.components import components
from barloom.llm.near_dedup import band_keys, estimate, keep_first, near_duplicates, registers, shingles, words_of


def brute(rows):
    """{(doc_id, text): (n, component)} by sets of word tuples and an inverted index."""
    sets = []
    for i, t in rows:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    at = defaultdict(list)
    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for o in at[g]:
                shared[o] += 1
            at[g].append(k)
        for o, c in shared.items():
            if 100 * c >= 75 * (len(s) + len(sets[o]) - c):
                parent[find(k)] = find(o)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of"]) if rng.random() < 0.2 else "w%d" % rng.randrange(3000)
    rows, shared = [], [word() for _ in range(60)]
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows[: max(1, len(rows) // 8)])[1].split() or ["x"]
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8]) * max(1, len(w) // 100)):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 12, 40, 70, 100, 400]))]
            if rng.random() < 0.4:
                w += shared
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = made(seed, 400)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo "), (6, "one"), (7, "É a b c d"), (8, "é a b c d"), (4, "One two"), (9, "x " * 5000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_shingles int, node int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 8), (9, 1, 9)]
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 4, 6, 7, 8, 9]
    assert near_duplicates(df.limit(0)).count() == 0


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    b = np.unique(np.concatenate([a[:15_000], rng.integers(0, 2**64, 5_000, dtype=np.uint64)]))
    a = np.unique(a)
    x, y = registers(a), registers(b)
    assert abs(estimate(x, y, np.array(len(a)), np.array(len(b)))[0] - 0.6) < 0.12
    assert (registers(np.unique(np.concatenate([a, b]))) == np.maximum(x, y)).all()
    u = np.array([3 << 56 | 1 << 54], np.uint64)
    assert registers(u)[3] >> 10 == 2
    assert len(band_keys(registers(u))) == 51


def test_similarity_at_the_threshold():
    words = [b"a%d" % i for i in range(104)]
    assert len(shingles(words)) == 100


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 101), (100, 102), (103, 102), (200, 201), (201, 200), (7, 7)]
    got = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 104)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
