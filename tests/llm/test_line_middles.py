"""Near copies whose first line is far from the others are counted by their middle, not listed as pairs."""

import random

from barloom.llm.line_dedup import Join, dedup_lines

from .test_line_links import brute


def test_near_copies_of_an_odd_first_line_are_not_listed(spark):
    rng, rows = random.Random(6), []
    for i in range(150):
        words = [f"base{k}" for k in range(60)]
        for k in rng.sample(range(60), 7 if i == 0 else rng.randrange(1, 5)):
            words[k] = f"new{i}x{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = brute(rows)
    assert len(links) > 10_000
    assert Join(df, "doc_id", "text", 1, links=True).pairs.count() < 150
    assert Join(df, "doc_id", "text", 1, links=False).pairs.count() < 150
    assert {r.doc_id: r.n_links for r in dedup_lines(df, with_links=True).collect()} == {i: sum(x[0] == i for x in links) for i, _ in rows}
