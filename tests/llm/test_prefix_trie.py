"""The prefix trie against plain lists and dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from barloom.llm import prefix_trie as trie
from barloom.llm.queries import oracle_sql, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            k = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, k), role, text))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()]


def made(n=300, seed=2):
    rng = random.Random(seed)
    rows = []
    for c in range(-30, n):
        if rng.random() < 0.1:
            continue
        start = rng.choice([["hello  there", "hi"], ["hello  there", None, "c d\x0be"], [""], []])
        texts = (start + [rng.choice(["a b", "c", None, "", "é ü", "long " * 50]) for _ in range(rng.randrange(6))])[: rng.randrange(9)]
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", None]) if t % 2 == 0 else "assistant", x) for t, x in enumerate(texts)]
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again"), (5, 0, "user", "other")]  # repeated and tied turns
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(200) for t in range(4)]  # a large group of copies
    rows += [(None, 0, "user", "no conversation"), (2**40, 0, "x" * 100, "y " * 100_000)]
    rng.shuffle(rows)
    return rows


def key(row):
    return tuple((v is not None, v) if not isinstance(v, str) else v for v in row)


def found(spark, rows, heavy=trie.HEAVY):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS a", "'x' AS conv", "2 AS depth", "3 AS n", "4 AS pos")
    return sorted((tuple(r) for r in trie.prefix_trie(df, heavy).select(NAMES).collect()), key=key)


@pytest.mark.parametrize("heavy", [trie.HEAVY, 40])
def test_equals_plain_dictionaries(spark, heavy):
    rows = made()
    assert found(spark, rows, heavy) == sorted(plain(rows), key=key)


def test_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = [(c, t, "user", f"w {t}") for c in (0, 7, 21, 40) for t in range(300)] + [(60, t, "user", f"w {t if t < 250 else -t}") for t in range(260)]
    assert found(spark, rows, 30) == sorted(plain(rows), key=key)


def test_small_tables(spark):
    assert found(spark, []) == []
    for rows in ([(3, 0, "user", "a")], [(20, 0, None, None)], [(1, 0, "u", "a"), (2, 0, "u", "a b"), (3, None, "u", "a")]):
        assert found(spark, rows) == sorted(plain(rows), key=key)


def test_sql(spark, tmp_path):
    import duckdb

    rows = [r for r in made(150, 9) if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = con.execute(oracle_sql()["op13_prefix_trie"])
    at = [[d[0] for d in got.description].index(c) for c in NAMES]
    want = sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in NAMES) for r in queries()["op13_prefix_trie"](spark, str(tmp_path)).collect()), key=key) == want


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_slots_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-(2**63), 2**63, n), rng.integers(-(2**63), 2**63, n)
    a[: n // 2] = 7  # digests that are equal in one half
    t = trie.SlotTable(a, b)
    assert sorted(t.slot) == list(range(n)) and (t.find(a, b) == t.slot).all()
    assert (t.find(a, b + 1) == -1).all()


def test_add_up():
    rng = random.Random(1)
    ids = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(400)]
    up = [None] + [rng.randrange(i) for i in range(1, 400)]
    depth = [0] * 400
    for i in range(1, 400):
        depth[i] = depth[up[i]] + 1
    total = list(range(400))
    for i in range(399, 0, -1):
        total[up[i]] += total[i]
    nodes = pd.DataFrame([(*ids[i], *(ids[up[i]] if i else (0, 0)), depth[i], i, 1) for i in range(400)], columns=["a", "b", "up_a", "up_b", "depth", "x", "y"]).sample(frac=1, random_state=1)
    out = trie.add_up(nodes, ["x", "y"]).set_index("a")
    assert [out.loc[ids[i][0], "x"] for i in range(400)] == total and out.loc[ids[0][0], "y"] == 400
