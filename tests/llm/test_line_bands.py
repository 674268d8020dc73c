"""Words are ordered by their length, without counting them, and pairs must agree in a band of sizes."""

from barloom.llm.line_dedup import Lines, dedup_lines, line_sets

from .test_line_links import brute


def test_longest_words_first_without_counts(spark):
    lines = Lines(spark.createDataFrame([(1, "a bb ccc dddd a\n" + "long " * 50), (5, None)], "doc_id long, text string"), "doc_id", "text")
    assert lines.place.base == 4  # room for the lines of a text, not for its bytes
    first = line_sets(lines.all()).orderBy("at").first()
    assert first.n == 4 and [31 - (t >> 58) for t in first.prefix] == [4, 3]


def test_no_pair_is_lost_between_bands(spark):
    rows = [(7 * n % 61, " ".join(f"w{k}" for k in range(n))) for n in range(1, 61)]
    links = brute(rows)
    got = {r.doc_id: r.n_links for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), with_links=True).collect()}
    assert len(links) > 400 and got == {i: sum(x[0] == i for x in links) for i, _ in rows}
