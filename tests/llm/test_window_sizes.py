"""Windows of every size are hashed from shared runs of words, never word by word again."""

import contextlib
import io
import random

import pytest

from barloom.llm.decontaminate import hits


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_windows_of_every_size(spark, most):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(4)}" for _ in range(n)]
    items = [(f"i{n}", text(n)) for n in range(18)]
    docs = [(i, text(n)) for i, n in enumerate([0, 1, 2, 12, 13, 14, 60, 200])]
    docs += [(20 + i, text(3) + w + text(2)) for i, (_, w) in enumerate(items)]
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w).upper()) for i, w in rows], name)
    found = hits(frame(docs, "doc_id long, text string"), frame(items, "item_id string, text string"), ["doc_id"], max_broadcast=most)
    expected = set()
    for i, w in docs:
        for item, v in items:
            size = min(len(v), 13)
            windows = [v[p : p + size] for p in range(len(v) - size + 1)] if v else []
            expected |= {(i, len(w), p + 1, size, item) for p in range(len(w) - size + 1) if w[p : p + size] in windows}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert {r for r in got if r[2]} == expected
    assert sorted(r[:3] for r in got if not r[2]) == sorted((i, len(w), 0) for i, w in docs)
    with contextlib.redirect_stdout(shown := io.StringIO()):
        found.explain("simple")
    assert "xxhash64(slice(" not in shown.getvalue()
