import random
import re

import pytest

from barloom.llm.line_dedup import dedup_lines


def brute(rows):
    lines = []
    for i, t in rows:
        for no, line in enumerate(t.split("\n") if t is not None else []):
            s = {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}
            if s:
                lines.append((i, no, s))
    gone = set()
    for i, no, s in lines:
        if any((j, m) < (i, no) and 4 * len(s & r) >= 3 * len(s | r) for j, m, r in lines):
            gone.add((i, no))
    return {i: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone) for i, t in rows}


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "of", "in", "a"]) if rng.random() < 0.3 else "W%d" % rng.randrange(400)
    pool, rows = [], []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(6)):
            if pool and rng.random() < 0.5:
                w = rng.choice(pool[: max(1, len(pool) // 5)])[:]
                for _ in range(rng.randrange(4)):
                    w[rng.randrange(len(w))] = word()
            else:
                w = [word() for _ in range(rng.choice([1, 4, 5, 6, 9, 20, 60]))]
            pool.append(w)
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed, 150)
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)


def test_edge_cases(spark):
    long = "\n".join(["one two three four five six"] * 3000)
    rows = [(5, None), (6, ""), (-3, "a b c d e f\n\nx"), (7, "A b c  d e\tF\nshort one\nshort one"), (8, "a b c d e g h"), (9, long), (9, long)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, at int")
    got = dedup_lines(df)
    assert got.columns == df.columns
    kept = "one two three four five six"
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text is not None) == [(-3, "a b c d e f\n\nx"), (6, ""), (7, "short one"), (8, "a b c d e g h"), (9, kept), (9, kept)]
    assert dedup_lines(df.limit(0)).count() == 0
