import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm.bpe_tree import TreeBpe
from barloom.llm.edit_counts import TokenTree, count_after_edits, edit_trees, op2_edit_counts, revision, token_trees, with_edits

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
BPE = TreeBpe(PATH)
TEXT = st.text(alphabet=st.sampled_from(list("abth .,'\n 12<|>éß")), max_size=60)
EDIT = st.tuples(st.integers(0, 400), st.integers(0, 60), st.one_of(TEXT, st.sampled_from(["<|endoftext|>", "|endoftext|>", "   "])))


def applied(text, edits):
    for start, deleted, inserted in edits:
        start = min(start, len(text))
        text = text[:start] + inserted + text[start + deleted :]
    return text


def lib(text):
    return len(LIB.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=8), st.lists(EDIT, max_size=5))
def test_counts_equal_a_full_encoding(parts, edits):
    text = "<|endoftext|>".join(parts)
    tree = TokenTree(BPE, text)
    for e in edits:
        tree.edit(*e)
    want = applied(text, edits)
    assert tree.text() == want and tree.n_tokens == lib(want)


def test_only_the_neighbourhood_is_encoded():
    text = "some words of a long document. " * 20_000
    tree = TokenTree(BPE, text)
    tree.edit(300_000, 5, " new")
    assert tree.text() == applied(text, [(300_000, 5, " new")]) and tree.n_tokens == lib(tree.text())
    assert tree.encoded < 3_000


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, "one line"), (4, "first line\nsecond line\n" * 200), (4, "first line\nsecond line\n" * 200)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted(count_after_edits(docs, revision(F.col("text"))).collect())
    assert [r.n_tokens for r in got] == [lib(t or "") for _, t in rows]
    note = " This sentence was added later; it has 11 words.\n"
    for r, (_, t) in zip(got, rows, strict=True):
        t = t or ""
        rest = t[t.find("\n") + 1 :] if "\n" in t else t
        whole = rest[: len(rest) // 2] + note + rest[len(rest) // 2 :]
        whole = whole[:-10] + " [end]"
        assert (r.n_tokens_after, r.n_chars_after, r.after_sha256) == (lib(whole), len(whole), hashlib.sha256(whole.encode()).hexdigest())


def test_edit_table(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, "x")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 0, "zz "), (1, 1, 0, 4, None), (9, 1, 0, 0, "q")], "doc_id long, no int, start long, deleted long, inserted string")
    got = {r.doc_id: r for r in count_after_edits(with_edits(docs, edits), F.col("edits")).collect()}
    assert got[1].after_sha256 == hashlib.sha256(b"zz def").hexdigest() and got[1].n_edits == 2 and got[2].n_edits == 0
    assert count_after_edits(docs.limit(0), revision(F.col("text"))).count() == 0


def test_query_on_a_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b c\nd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op2_edit_counts(spark, str(tmp_path)).count() == 1


def test_many_edits_of_one_document():
    text, tree = "", TokenTree(BPE, "")
    for i in range(5_000):
        new = f" word{i} and more"
        tree.edit(len(text), 0, new)
        text += new
        if i % 7 == 0:
            tree.edit(3, 2, "xy z")
            text = text[:3] + "xy z" + text[5:]
    assert tree.text() == text and tree.n_tokens == lib(text) and tree.root.depth <= 64


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8), st.lists(EDIT, max_size=4), st.lists(EDIT, max_size=4))
def test_stored_trees_go_on(parts, first, then):
    text = "<|endoftext|>".join(parts)
    tree = TokenTree(BPE, text)
    for e in first:
        tree.edit(*e)
    again = TokenTree(BPE, *tree.parts())
    for e in then:
        again.edit(*e)
    want = applied(text, [*first, *then])
    assert again.text() == want and again.n_tokens == lib(want)


def test_tree_tables(spark, tmp_path):
    text = "some words of a long document. " * 3_000
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id long, text string")
    token_trees(docs).write.parquet(f"{tmp_path}/v1")
    edit = F.expr("array(named_struct('start', 500L, 'deleted', 4L, 'inserted', 'new words '))")
    edit_trees(spark.read.parquet(f"{tmp_path}/v1"), edit).write.parquet(f"{tmp_path}/v2")
    got = {r.doc_id: r for r in edit_trees(spark.read.parquet(f"{tmp_path}/v2"), edit).collect()}
    want = {i: applied(applied(t or "", [(500, 4, "new words ")]), [(500, 4, "new words ")]) for i, t in [(1, text), (2, None), (3, "x")]}
    assert {i: (r.text, r.n_tokens, sum(r.counts)) for i, r in got.items()} == {i: (t, lib(t), lib(t)) for i, t in want.items()}
    assert got[1].encoded_chars < 3_000 < len(text)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "abc", "mine")], "doc_id long, text string, edits string")
    edits = spark.createDataFrame([(1, 1, 0, 1, "z")], "doc_id long, no int, start long, deleted long, inserted string")
    both = with_edits(docs, edits)
    assert both.first().edits == "mine"
    assert count_after_edits(both, F.col("_edits")).first().n_chars_after == 3
