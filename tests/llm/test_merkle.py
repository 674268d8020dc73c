"""The Merkle manifest against plain lists."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from barloom.llm import merkle
from barloom.llm.common import place
from barloom.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def walk(nodes):
    """The root, and of each node the (left, right) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 16 * 16
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 16])))
        nodes, at = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], paths


def plain(rows):
    by = {}
    for r in rows:
        low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], low)) if bad else None))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: walk([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, tops = walk([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (known, key, own, bad), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path, node = path + top, bad or own
            for a, b in path:
                node = H(a, node, b)
            out.append((key if known else None, own, trees[s][0], root, H(*(a + b for a, b in path)), node, node == root))
    return out


def made(n=700, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", None, "", "é", "Z", "a", f"s{rng.randrange(30)}"])
        text = rng.choice([None, "", "Some Text", "ÀB c", "Ab " * rng.randrange(40)])
        rows.append((i, source, rng.choice([None, "en"]), rng.choice([None, 3]), text))
    rows += [(i + 1000, "huge", "en", 1, "X" * (i % 3)) for i in range(300)]
    rows += rows[:20]  # repeated rows
    rows += [(5, "hot", None, None, t) for t in ("one", "Two")]  # a key with several rows
    rows += [(None, "hot", None, None, "No Key"), (None, None, None, None, None), (-7, "lone", "x", 0, "A" * 300_000)]
    rng.shuffle(rows)
    return rows


def found(spark, rows, tmp_path, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 AS tree", "2 AS pos", "'x' AS leaf", "3 AS at", "4 AS _size", "5 AS node", "6 AS n")
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries()["op11_merkle"](spark, str(tmp_path)).collect()]


def test_equals_plain_lists(spark, tmp_path):
    rows = made()
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    want = sorted(plain(rows), key=key)
    assert sorted(found(spark, rows, tmp_path), key=key) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_small_tables(spark, tmp_path):
    assert found(spark, [], tmp_path / "none") == []
    for rows in ([(0, "a", "b", 1, "T")], [(i, "a", None, None, "t") for i in range(17)], [(i, f"s{i:02}", None, None, "T") for i in range(33)]):
        assert sorted(found(spark, rows, tmp_path / str(len(rows)), extra=True)) == sorted(plain(rows))


def test_sql(spark, tmp_path):
    import duckdb

    rows = [r for r in made(200) if r[0] is not None]
    got = found(spark, rows, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(oracle_sql()["op11_merkle"]).fetchall()) == sorted(got)


def test_proofs_fold_to_the_root(spark):
    df = spark.createDataFrame(made(100), SCHEMA)
    out = merkle.manifest(df, fields=["text", "doc_id"])
    assert out.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()
    assert not out.where(merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count()


def test_place(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randrange(1000), i) for i in range(3000)]
    got = place(spark.createDataFrame(rows, "g string, x int, i int").repartition(7), ["g"], ["x", "i"], "k", "size").collect()
    for g in ("a", "b", None, "c"):
        own = sorted((x, i) for h, x, i in rows if h == g)
        assert sorted((r["k"], r["x"], r["i"], r["size"]) for r in got if r["g"] == g) == [(k, x, i, len(own)) for k, (x, i) in enumerate(own)]
    whole = place(spark.createDataFrame(rows, "g string, x int, i int"), [], ["i"]).collect()
    assert all(r["pos"] == r["i"] for r in whole)
