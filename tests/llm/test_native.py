import hashlib
import re

from pyspark.sql import functions as F

from barloom.llm.decontaminate import clean, cut_spans, judge
from barloom.llm.licences import RULES, SENTENCES, scan

BENCH = [(1, " ".join(f"w{i}" for i in range(20))), (2, "Short ITEM here"), (3, None), (4, "..."), (5, " ".join(f"w{i}" for i in range(13))), (10, "É été b")]
TEXTS = [
    None, "", "nothing of note", "x " * 50 + " ".join(f"W{i}," for i in range(20)), "a short, item; HERE!", "y " * 900 + " ".join(f"w{i}" for i in range(13)),
    " ".join(f"w{i}" for i in range(2, 15)), "short item", "É été b c", "é été b c", " ".join(f"w{i}" for i in range(12)),
]


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]


def brute(t):
    w, hit, items = words(t), set(), set()
    for item, text in BENCH:
        b = words(text)
        n = min(13, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                items.add(item)
    keys = ",".join(sorted(map(str, items)))
    return len(w), len(hit), len(items), hashlib.sha256(keys.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def tables(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (4, "other")]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string"), spark.createDataFrame(BENCH, "item_id long, text string"), rows


def test_judge_equals_brute_force(spark):
    docs, bench, rows = tables(spark)
    for most in (1000, 0):  # broadcast and shuffled
        from barloom.llm import decontaminate

        keep, decontaminate.MAX_BROADCAST = decontaminate.MAX_BROADCAST, most
        decontaminate.hits.__defaults__ = (13, most)
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in judge(docs, bench).collect())
        decontaminate.MAX_BROADCAST = keep
        decontaminate.hits.__defaults__ = (13, keep)
        assert got == sorted((i, *brute(t)) for i, t in rows)


def test_clean_and_cut(spark):
    docs, bench, rows = tables(spark)
    kept = clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in rows if not brute(t)[4])
    cut = {r.doc_id: r.text for r in cut_spans(docs, bench).where("doc_id <> 4").collect()}
    assert cut[3] == " ".join(["x"] * 50) and cut[2] == TEXTS[2] and cut[5] == " ".join(["y"] * 900)
    assert clean(docs, bench.limit(0)).count() == len(rows) and judge(docs.limit(0), bench).count() == 0


def test_licences(spark):
    mit = "\n".join(SENTENCES[s] for s in RULES[0][1])
    bsd = " ".join(SENTENCES[s] for s in ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"))
    texts = {
        1: None, 2: "", 3: "Released under the MIT licence.", 4: "Text.\nReleased under the  MIT License.\nMore", 5: "Licensed under the Apache License, Version 2.0. Released under the MIT License!",
        6: mit, 7: mit.replace("\n", "\nAn aside. Another.\n"), 8: mit.replace("\n", "\na b\nc d\ne f\ng h\n"), 9: "\n".join(reversed(mit.split("\n"))), 10: bsd, 11: "word " * 30_000 + "\nLICENSED UNDER CC BY-NC 4.0!",
    }
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, _x int")
    got = {r.doc_id: ",".join(r.licences) for r in scan(df).select("doc_id", "licences").collect()}
    assert got == {1: "", 2: "", 3: "", 4: "MIT", 5: "Apache-2.0,MIT", 6: "MIT", 7: "MIT", 8: "", 9: "", 10: "BSD-3-Clause", 11: "CC-BY-NC-4.0"}
    assert scan(df.where(F.lit(False))).count() == 0


def test_missing_ids_and_clashing_names(spark):
    """Rows of a NULL id are judged as others; columns with the names that the joins use stay the user's."""
    _, bench, _ = tables(spark)
    names = ["_text_key", "_id", "_key", "judged_id", "judged_key", "hit", "at", "size", "raw", "hash", "item_id"]
    rows = [(None, TEXTS[3]), (None, "fine"), (None, None), (7, TEXTS[3]), (8, "fine")]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text), *r[2:]) for r in kept.collect()) == sorted((str(i), str(t), *range(len(names))) for i, t in rows if t != TEXTS[3])
    cut = cut_spans(df, bench)
    assert cut.columns == df.columns and sorted(str(r.text) for r in cut.collect()) == sorted(["None", "fine", "fine"] + [" ".join(["x"] * 50)] * 2)
