import pytest

from barloom.llm.line_dedup import dedup_lines, line_links, op4_line_dedup

from .test_line_dedup import made


def brute(rows, least=1):
    """Links of lines to earlier ones: copies to their first line, first lines to all similar first lines."""
    first, links = {}, set()
    for at, line in sorted(((i, no), line) for i, t in rows for no, line in enumerate(t.split("\n"))):
        s = frozenset(line.lower().split())
        if len(s) < least:
            continue
        if s in first:
            links.add((*at, *first[s], True))
            continue
        links |= {(*at, *y, False) for r, y in first.items() if 4 * len(s & r) >= 3 * len(s | r)}
        first[s] = at
    return links


@pytest.mark.parametrize("rows", [made(3, 120), [(i, " ".join(f"w{k}" for k in range(30) if k != i)) for i in range(25)] + [(90, "w1 w2\nw3")]])
def test_no_link_is_lost(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = brute(rows)
    got = [tuple(r) for r in line_links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == links
    counts = {r.doc_id: (r.n_links, len(r.removed_lines)) for r in dedup_lines(df, with_links=True).collect()}
    assert counts == {i: (sum(x[0] == i for x in links), len({x[1] for x in links if x[0] == i})) for i, _ in rows}


def test_short_lines_take_part(spark, tmp_path):
    """With one word or more; three words of four are similar too. op4_line_dedup leaves none out."""
    rows = made(4, 80) + [(100 + i, "Les.\n\na b c d\nha ha ha ha ha ha\nAll rights reserved.\nc b a") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    links = brute(rows, 1)
    assert (100, 5, 100, 2, False) in links
    got = {r.doc_id: (r.n_links, r.removed_lines) for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (sum(x[0] == i for x in links), ",".join(map(str, sorted({x[1] for x in links if x[0] == i})))) for i, _ in rows}
    assert got[129] == (5, "0,2,3,4,5")
    assert {r.doc_id: r.text for r in dedup_lines(df, min_words=1).collect()} == {i: "\n".join(x for no, x in enumerate(t.split("\n")) if str(no) not in got[i][1].split(",")) for i, t in rows}
