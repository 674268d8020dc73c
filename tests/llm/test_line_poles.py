"""Large groups of near copies, which are counted instead of listed."""

import random
from decimal import Decimal

import pytest

from barloom.llm import line_dedup
from barloom.llm.line_dedup import dedup_lines, line_links

from .test_line_links import brute


def made(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        kind = rng.randrange(3)
        words = [f"base{kind}x{k}" for k in range(40)]
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(60)}"
        rows.append((i, " ".join(words) + "\n" + " ".join(f"r{rng.randrange(500)}" for _ in range(rng.choice([5, 100, 300])))))
    return rows


@pytest.mark.parametrize("large, block", [(2, 3), (8, 256)])
def test_links_of_poles_equal_brute_force(spark, monkeypatch, large, block):
    monkeypatch.setattr(line_dedup, "LARGE", large)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows = made(large)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = brute(rows)
    got = [tuple(r) for r in line_links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == links
    counts = {r.doc_id: (r.n_links, r.removed_lines) for r in dedup_lines(df, with_links=True).collect()}
    removed = {i: sorted({x[1] for x in links if x[0] == i}) for i, _ in rows}
    assert counts == {i: (sum(x[0] == i for x in links), removed[i]) for i, _ in rows}
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == {i: "\n".join(x for no, x in enumerate(t.split("\n")) if no not in removed[i]) for i, t in rows}


def test_repeated_rows_and_ids_beyond_long(spark):
    """Repeated rows are one line; ids that leave no room for line numbers order lines all the same."""
    text = "a b c d e f\na b c d e g h"
    rows = [(2**62 + 5, text), (2**62 + 5, text), (2**62 + 9, "a b c d e f g\nq"), (None, text), (None, None)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id) == [(2**62 + 5, "a b c d e f\na b c d e g h"), (2**62 + 5, "a b c d e f\na b c d e g h"), (2**62 + 9, "q")]
    assert sorted(str(r.text) for r in got if not r.doc_id) == ["None", text]


def test_clashing_names(spark):
    """Columns with the names that the operator uses stay the user's."""
    names = ["k", "no", "line", "at", "of", "removed", "links", "split", "_of", "x", "y", "words"]
    rows = [(1, "a b c d e f\nz"), (2, "z\na b c d e f"), (3, None)]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = dedup_lines(df)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect() if r.text is not None) == [(1, "a b c d e f\nz", *range(len(names))), (2, "", *range(len(names)))]


@pytest.mark.parametrize("kind, of", [("long", lambda i: i - 100), ("long", lambda i: (i - 80) * 2**55), ("string", lambda i: f"é{i:03d}"), ("decimal(38,0)", lambda i: Decimal(i - 80) * 10**30)])
def test_ids_of_every_kind(spark, monkeypatch, kind, of):
    """Negative, huge and text ids lose no pole and no link: the result is that of small ids in the same order."""
    monkeypatch.setattr(line_dedup, "LARGE", 2)
    rows = [(of(i), t) for i, t in made(2)]
    df = spark.createDataFrame([*rows, (None, "base0x1 base0x2")], f"doc_id {kind}, text string")
    links = brute(rows)
    assert {tuple(r) for r in line_links(df).collect()} == links
    counts = {r.doc_id: (r.n_links, r.removed_lines) for r in dedup_lines(df, with_links=True).collect() if r.doc_id is not None}
    assert counts == {i: (sum(x[0] == i for x in links), sorted({x[1] for x in links if x[0] == i})) for i, _ in rows}
    cut = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert cut == {None: "base0x1 base0x2"} | {i: "\n".join(x for no, x in enumerate(t.split("\n")) if no not in counts[i][1]) for i, t in rows}
    if kind == "long":
        lines = line_dedup.Lines(df, "doc_id", "text")
        assert (lines.ranks is None) == (of(0) > -1000)
        assert line_dedup._poles(line_dedup.Join(df, "doc_id", "text", 1, True).classes, lines).count() > 0
