"""Pairs are verified on lines, which are moved as they are, and once; lists of their words are larger."""

import random

from barloom.llm import line_dedup
from barloom.llm.line_dedup import Lines, dedup_lines

from .test_line_links import brute


def corpus() -> list[tuple[int, str]]:
    rng, rows = random.Random(11), []
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 12))] for _ in range(12)]
    for i in range(40):
        lines = []
        for _ in range(3):
            words = list(rng.choice(base))
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
            lines.append(rng.choice(" \t\x0b\x0c\r").join(words))
        rows.append((i, "\n".join(lines)))
    return rows


def test_lines_of_pairs_are_written_without_lists_of_words(spark, monkeypatch):
    written, stash = [], line_dedup.stash
    monkeypatch.setattr(line_dedup, "stash", lambda df, name: (written.append((name, dict(df.dtypes))), stash(df, name))[1])
    rows = corpus()
    found = {r.doc_id: r.n_links for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), with_links=True).collect()}
    links = brute(rows)
    assert links and found == {i: sum(x[0] == i for x in links) for i, _ in rows}
    texts = [columns for _, columns in written if "line" in columns]
    assert texts and all(columns == {"at": "bigint", "line": "string"} for columns in texts)
    assert not any("words" in columns for _, columns in written)


def test_lines_of_documents_that_are_not_repeated_are_not_shuffled(spark):
    rows = corpus()
    for repeated in (False, True):
        lines = Lines(spark.createDataFrame(rows + rows[:5] * repeated, "doc_id long, text string"), "doc_id", "text")
        wanted = lines.all().select("at").distinct()
        at = lines.at(wanted)
        assert ("min(line" in at._jdf.queryExecution().optimizedPlan().toString()) is repeated
        assert at.count() == at.select("at").distinct().count() == wanted.count()
