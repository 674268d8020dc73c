import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm.bpe_tree import Segment, TreeBpe, encode_decode, join_all

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
SMALL = TreeBpe(PATH, leaf=6, window=1)


def lib(text):
    return LIB.encode(text, add_special_tokens=False).ids


WORDS = st.text(alphabet=st.sampled_from(list("abcdeth .,'\n\t 12<|>éß中  \U0001f600")), max_size=80)


@settings(max_examples=400, deadline=None)
@given(WORDS)
def test_encode_equals_library(text):
    assert SMALL.encode(text) == lib(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_unicode(text):
    assert SMALL.encode(text) == lib(text)
    assert SMALL.decode(SMALL.encode(text)).decode() == LIB.decode(lib(text), skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(WORDS, st.sampled_from(["<|endoftext|>", "   ", "aaaaaaaaaaaaaaa", "<|endo"])), max_size=12), st.integers(1, 17))
def test_segments_join_exactly(parts, n):
    text = "".join(parts)
    cut = [text[i : i + n] for i in range(0, len(text), n)] or [""]
    done = join_all(SMALL, [Segment.encode(SMALL, c) for c in cut])
    whole = Segment.encode(SMALL, text)
    assert done.ids == lib(text)
    assert (done.chars, done.tokens) == (whole.chars, whole.tokens)


def test_every_token_encodes_to_itself():
    bpe = TreeBpe(PATH)
    assert all(bpe._plain(t) == [i] for i, t in bpe.letters_of.items() if t not in bpe.special)


def test_long_unsplit_text():
    rng = random.Random(1)
    text = "".join(rng.choice(["the", "in", "aa", "zq", "é"]) for _ in range(20_000))
    assert TreeBpe(PATH).encode(text) == lib(text)


@pytest.mark.parametrize("segment", [7, 50_000])
def test_frame(spark, segment):
    texts = [None, "", "Hello  world <|endoftext|> x", "a" * 100 + " b", "Hello  world <|endoftext|> x", "中文 1234567 été\n\n "]
    rows = [(i % 5, t, "extra") for i, t in enumerate(texts)]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), segment=segment, with_ids=True).collect()
    want = sorted((i, len(lib(t or "")), hashlib.sha256(",".join(map(str, lib(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), lib(t or "")) for i, t, _ in rows)
    assert sorted(map(tuple, got)) == want


def test_empty_frame(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_long_rows(spark):
    rows = [(1, "x" * 40), (1, "x" * 40), (1, "y" * 40)]
    assert encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), segment=8).count() == 3
