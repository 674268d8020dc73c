"""BPE encoding and decoding by tree concatenation.

Long unsplit text is cut into halves that are encoded on their own; the halves
are joined by re-encoding a growing window around the join until its first
token is the left side's and its last token the right side's. Two neighbouring
tokens are a valid encoding exactly if their own two-token text encodes to
them, so agreement at both edges makes the whole sequence the exact encoding.

Two levels use this: pre-tokens longer than ``leaf`` characters inside a text,
and texts longer than ``SEGMENT`` characters, whose segments Spark deals out to
different tasks and joins pairwise. At the upper level the window also covers
the splitting of text into pre-tokens.

Defined cases: NULL and empty texts have no tokens and decode to an empty text;
repeated rows give repeated results; a literal special-token string in a text
is that special token, as in the library; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SEGMENT = 32_768  # characters of a long text that one task encodes on its own
LEAF = 256  # characters of a pre-token that are encoded at once
WINDOW = 4  # tokens on each side of a join at first
CACHE = 150_000  # pre-tokens that a worker remembers

#: Characters whose class all Unicode versions in use agree on; texts with others are split by the library itself.
_STABLE = regex.compile(r"[\x00-ͷЀ-ԯ‐-⁞₠-₿←-⏺ぁ-ゖ゠-ヿ一-龥가-힣]*+")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class TreeBpe:
    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.reach = max(map(len, self.special), default=0)
        self.leaf, self.window = leaf, window
        self.split = regex.compile(public_tokenizers.PATTERN)
        letters = _byte_letters()
        self.to_letters = dict(enumerate(letters))
        byte_of = {c: i for i, c in enumerate(letters)}
        self.letters_of = {i: t for t, i in self.library.get_vocab().items()}
        self.bytes_of = [b""] * (max(self.letters_of) + 1)
        for i, t in self.letters_of.items():
            self.bytes_of[i] = t.encode() if t in self.special else bytes(byte_of[c] for c in t)
        self.cache: dict[str, tuple[int, ...]] = {}

    # -- within a pre-token -------------------------------------------------
    def _plain(self, letters: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(letters)]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined text of two encodings that lie inside one pre-token."""
        k = self.window
        while True:
            a, b = left[-k:], right[:k]
            middle = self._plain("".join(self.letters_of[i] for i in a + b))
            fits_left = k >= len(left) or middle[0] == a[0]
            fits_right = k >= len(right) or middle[-1] == b[-1]
            if fits_left and fits_right:
                return left[:-k] + middle + right[k:]
            k *= 2

    def _tree(self, letters: str) -> list[int]:
        if len(letters) <= self.leaf:
            return self._plain(letters)
        half = len(letters) // 2
        return self.join(self._tree(letters[:half]), self._tree(letters[half:]))

    def pre_token(self, piece: str) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            if piece in self.special:
                return (self.special[piece],)
            ids = tuple(self._tree(piece.encode().decode("latin-1").translate(self.to_letters)))
            if len(piece) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    # -- splitting ----------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text, in order; joined they are the text."""
        stable = _STABLE.fullmatch(text) is not None
        if "<|" not in text:
            return self.split.findall(text) if stable else self._library_pieces(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            part = text[at : m.start()]
            out += self.split.findall(part) if stable else self._library_pieces(part)
            out.append(m.group())
            at = m.end()
        part = text[at:]
        return out + (self.split.findall(part) if stable else self._library_pieces(part))

    def _library_pieces(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, make = self.cache.get, self.pre_token
        for p in self.pieces(text):
            out += get(p) or make(p)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").encode()


class Segment:
    """An encoded stretch of text with the character and token positions at which its pre-tokens begin."""

    def __init__(self, text: str, ids: list[int], chars: list[int], tokens: list[int]):
        self.text, self.ids, self.chars, self.tokens = text, ids, chars, tokens

    @classmethod
    def encode(cls, bpe: TreeBpe, text: str) -> Segment:
        ids, chars, tokens, at = [], [], [], 0
        for p in bpe.pieces(text):
            chars.append(at)
            tokens.append(len(ids))
            ids += bpe.pre_token(p)
            at += len(p)
        return cls(text, ids, chars, tokens)

    def join(self, bpe: TreeBpe, right: Segment) -> Segment:
        """Split a growing window around the join anew until its boundaries meet those of both sides."""
        if not self.text or not right.text:
            return right if not self.text else self
        cut, text = len(self.text), self.text + right.text
        # what begins this far before the cut is split alike in the whole text
        first = max(0, bisect_right(self.chars, cut - bpe.reach - 1) - 1)
        if cut <= bpe.reach:
            first = 0
        start = self.chars[first]
        span = 256
        while True:
            stop = min(len(text), cut + span)
            cuts, found = [start], None
            pieces = bpe.pieces(text[start:stop])
            for p in pieces:
                end = cuts[-1] + len(p)
                cuts.append(end)
                # the last pieces of a window that ends inside the text may change with what follows
                if end >= cut and (stop == len(text) or end <= stop - bpe.reach - 1) and self._begins(right, end - cut, len(text) - cut):
                    found = end
                    break
            if found is not None:
                break
            span *= 4
        ids, chars, tokens = self.ids[: self.tokens[first]], self.chars[:first], self.tokens[:first]
        for i, p in enumerate(pieces[: len(cuts) - 1]):
            chars.append(cuts[i])
            tokens.append(len(ids))
            ids += self._across(bpe, right, p, cuts[i], cuts[i + 1], cut)
        r = bisect_left(right.chars, found - cut)
        shift = len(ids) - (right.tokens[r] if r < len(right.tokens) else len(right.ids))
        chars += [c + cut for c in right.chars[r:]]
        tokens += [t + shift for t in right.tokens[r:]]
        ids += right.ids[right.tokens[r] :] if r < len(right.tokens) else []
        return Segment(text, ids, chars, tokens)

    @staticmethod
    def _begins(right: Segment, at: int, length: int) -> bool:
        i = bisect_left(right.chars, at)
        return at == length or i < len(right.chars) and right.chars[i] == at

    def _across(self, bpe: TreeBpe, right: Segment, piece: str, a: int, b: int, cut: int) -> tuple[int, ...] | list[int]:
        """A long pre-token over the cut is joined from the tokens of its two halves where each half was one pre-token."""
        if not (a < cut < b) or len(piece) <= bpe.leaf or piece in bpe.special:
            return bpe.pre_token(piece)
        i, j = bisect_left(self.chars, a), bisect_left(right.chars, b - cut)
        whole_left = i == len(self.chars) - 1 and self.chars[i] == a
        whole_right = j == 1 or j == len(right.chars) == 1
        if not (whole_left and whole_right) or self.text[a:] in bpe.special or piece[cut - a :] in bpe.special:
            return bpe.pre_token(piece)
        return bpe.join(self.ids[self.tokens[i] :], right.ids[: right.tokens[1] if len(right.tokens) > 1 else None])

    def pack(self) -> tuple[str, bytes, bytes, bytes]:
        return self.text, *(np.array(x, np.int32).tobytes() for x in (self.ids, self.chars, self.tokens))

    @classmethod
    def unpack(cls, text: str, *arrays: bytes) -> Segment:
        return cls(text, *(np.frombuffer(a, np.int32).tolist() for a in arrays))


def join_all(bpe: TreeBpe, parts: list[Segment]) -> Segment:
    """Join neighbours pairwise, level by level."""
    while len(parts) > 1:
        parts = [a.join(bpe, b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + (parts[-1:] if len(parts) % 2 else [])
    return parts[0]


@lru_cache(maxsize=2)
def load(path: str) -> TreeBpe:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TreeBpe(path)


_RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(bpe: TreeBpe, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def encode_decode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, segment: int = SEGMENT, with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) of each text.

    Texts up to ``segment`` characters are encoded where they lie. Longer ones
    are exploded into segments, dealt out by (key, digest, segment number),
    encoded apart, and joined as a tree; a group then holds one text.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = df.schema[key].dataType.simpleString()
    result = _RESULT + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in result.split(", ")]
    docs = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    is_long = F.char_length("t") > segment

    def row(bpe: TreeBpe, ids: list[int]) -> tuple:
        return (*_result(bpe, ids), ids) if with_ids else _result(bpe, ids)

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            out = pd.DataFrame([row(bpe, bpe.encode(t)) for t in batch["t"]], columns=names)
            out.insert(0, key, batch["k"])
            yield out

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            packed = [Segment.encode(bpe, t).pack() for t in batch["part"]]
            yield pd.concat([batch[["k", "digest", "copies", "no"]], pd.DataFrame(packed, columns=["part", "ids", "chars", "tokens"], index=batch.index)], axis=1)

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        bpe = load(path)
        group = group.sort_values("no")
        done = join_all(bpe, [Segment.unpack(*r) for r in group[["part", "ids", "chars", "tokens"]].itertuples(index=False)])
        out = pd.DataFrame([row(bpe, done.ids)] * int(group["copies"].iloc[0]), columns=names)
        out.insert(0, key, group["k"].iloc[0])
        return out

    alone = docs.where(~is_long).mapInPandas(short, f"{key} {kind}, {result}")
    cut = (
        docs.where(is_long)
        .withColumn("digest", F.sha2("t", 256))
        .groupBy("k", "digest")
        .agg(F.first("t").alias("t"), F.count("*").alias("copies"))
        .select("k", "digest", "copies", "t", F.posexplode(F.sequence(F.lit(0), (F.char_length("t") - 1).cast("int"), F.lit(segment))).alias("no", "start"))
        .select("k", "digest", "copies", "no", F.expr(f"substring(t, start + 1, {segment})").alias("part"))
        .repartition("k", "digest", "no")
        .mapInPandas(parts, f"k {kind}, digest string, copies long, no int, part string, ids binary, chars binary, tokens binary")
        .groupBy("k", "digest")
        .applyInPandas(whole, f"{key} {kind}, {result}")
    )
    return alone.unionByName(cut)


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
