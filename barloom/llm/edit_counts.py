"""Token counts that follow edits: a segment tree of pre-token counts for each document.

A document is kept as pre-tokens with their token counts, in leaves of about
``LEAF`` pre-tokens, and a tree of sums over the leaves: characters and tokens.
An edit (start, deleted, inserted) finds its leaves by walking down the character
sums, splits and encodes again only the text from a safe pre-token before the
edit until the boundaries meet the old ones again, and adds the difference to the
sums on the way up. The number of tokens is then the root's. A tree that has
grown too deep is put together anew from its leaves, without encoding.

``token_trees`` makes a table of trees: the text, the length and the token count
of each pre-token, from which the sums are added up. ``edit_trees`` takes such a
table and edits to the next one, which can be stored and edited again.

Defined cases: NULL and empty texts have no tokens and can be inserted into;
edits beyond the end are moved to the end; NULL parts of an edit count as 0 or
''; the edits of a document are applied in the order given; edits of unknown
documents are ignored; repeated document rows get the same edits each; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_tree import TreeBpe, load
from .common import free_name, table

LEAF = 64  # pre-tokens in a leaf at first


class _Node:
    """A leaf with its pre-tokens and their token counts, or an inner node; both with sums over what is below."""

    __slots__ = ("chars", "counts", "depth", "left", "pieces", "right", "tokens")

    def __init__(self, pieces: list[str] | None, counts: list[int] | None, left: _Node | None = None, right: _Node | None = None):
        self.pieces, self.counts, self.left, self.right = pieces, counts, left, right
        if pieces is None:
            self.chars, self.tokens, self.depth = left.chars + right.chars, left.tokens + right.tokens, 1 + max(left.depth, right.depth)
        else:
            self.chars, self.tokens, self.depth = sum(map(len, pieces)), sum(counts), 0


class TokenTree:
    """The pre-tokens of a text with their token counts summed in a segment tree."""

    def __init__(self, bpe: TreeBpe, text: str, lengths: Sequence[int] | None = None, counts: Sequence[int] | None = None):
        """Of a text, or of what ``parts`` returned; ``built`` characters were encoded for it and ``encoded`` since."""
        self.bpe, self.encoded = bpe, 0
        if lengths is None:
            pieces = bpe.pieces(text)
            counts = self._count(pieces)
        else:
            ends = list(accumulate(map(int, lengths)))
            pieces, counts = [text[a:b] for a, b in zip([0, *ends], ends)], list(map(int, counts))  # noqa: B905
        self.root = self._joined([_Node(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)])
        self.built, self.encoded = self.encoded, 0

    def parts(self) -> tuple[str, list[int], list[int]]:
        """The text, and the lengths and the token counts of its pre-tokens."""
        leaves = [leaf for _, leaf in self._leaves(self.root, 0, 0, self.root.chars)]
        pieces = [p for leaf in leaves for p in leaf.pieces]
        return "".join(pieces), list(map(len, pieces)), [c for leaf in leaves for c in leaf.counts]

    def _count(self, pieces: list[str]) -> list[int]:
        self.encoded += sum(map(len, pieces))
        return [len(self.bpe.pre_token(p)) for p in pieces]

    @staticmethod
    def _joined(leaves: list[_Node]) -> _Node:
        """A tree of the least depth over leaves."""
        leaves = leaves or [_Node([], [])]
        while len(leaves) > 1:
            leaves = [_Node(None, None, *leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]

    @property
    def n_tokens(self) -> int:
        return self.root.tokens

    def _leaves(self, node: _Node, start: int, low: int, high: int) -> Iterator[tuple[int, _Node]]:
        """(start, leaf) of the leaves that touch the characters from low to high."""
        if start > high or start + node.chars < low:
            return
        if node.pieces is not None:
            yield start, node
        else:
            yield from self._leaves(node.left, start, low, high)
            yield from self._leaves(node.right, start + node.left.chars, low, high)

    def text(self, low: int = 0, high: int | None = None) -> str:
        high = self.root.chars if high is None else high
        found = [(s, "".join(n.pieces)) for s, n in self._leaves(self.root, 0, low, high)]
        return "".join(t for _, t in found)[low - found[0][0] : high - found[0][0]] if found else ""

    def _boundaries(self, low: int, high: int) -> list[int]:
        out = []
        for start, leaf in self._leaves(self.root, 0, low, high):
            for p in leaf.pieces:
                out.append(start)
                start += len(p)
        return out

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        size = self.root.chars
        start = min(max(start, 0), size)
        stop = min(start + max(deleted, 0), size)
        reach = self.bpe.reach + 1
        # what begins this far before the edit is split as before; an earlier start is safe as well
        first = max([b for b in self._boundaries(max(0, start - reach - 256), start) if b <= start - reach], default=None)
        if first is None:
            first = max([b for b in self._boundaries(0, start) if b <= start - reach], default=0)
        span = 64
        while True:
            high = min(size, stop + span)
            fresh = self.text(first, start) + inserted + self.text(stop, high)
            shift = len(inserted) - (stop - start)
            old = {b for b in self._boundaries(stop, high) if b >= stop}
            pieces, at, met = self.bpe.pieces(fresh), first, None
            for k, p in enumerate(pieces):
                at += len(p)
                if at - shift >= stop and at >= start + len(inserted) and (high == size or at - shift <= high - reach) and (at - shift in old or at - shift == size):
                    met = k + 1
                    break
            if met is not None or high == size:
                break
            span *= 4
        pieces = pieces[:met]
        self._replace(first, first + sum(map(len, pieces)) - shift, pieces)

    def _replace(self, low: int, high: int, pieces: list[str]) -> None:
        """Put ``pieces`` in the place of the characters from low to high, which are whole pre-tokens; sums follow."""
        self.root = self._put(self.root, 0, low, high, (pieces, self._count(pieces)))[0]
        if self.root.depth > 64:
            leaves = [leaf for _, leaf in self._leaves(self.root, 0, 0, self.root.chars) if leaf.pieces]
            merged: list[_Node] = []
            for leaf in leaves:  # small neighbours become one
                if merged and len(merged[-1].pieces) + len(leaf.pieces) <= LEAF:
                    leaf = _Node(merged[-1].pieces + leaf.pieces, merged.pop().counts + leaf.counts)
                merged.append(leaf)
            self.root = self._joined(merged)

    def _put(self, node: _Node, start: int, low: int, high: int, new: tuple[list[str], list[int]] | None) -> tuple[_Node, tuple | None]:
        """The node without what lies in [low, high), with ``new`` at low; and ``new`` if it is still to be placed."""
        stop = start + node.chars
        if stop < low or start > high or (start == high and new is None):
            return node, new
        if node.pieces is not None:
            kept: list[tuple[list[str], list[int]]] = [([], []), ([], [])]
            at = start
            for p, c in zip(node.pieces, node.counts, strict=True):
                if at < low or at >= high:
                    kept[at >= low][0].append(p)
                    kept[at >= low][1].append(c)
                at += len(p)
            place = new is not None and start <= low <= stop
            (a, b), (c, d) = kept
            pieces, counts = (a + new[0] + c, b + new[1] + d) if place else (a + c, b + d)
            size = max(LEAF, -(-len(pieces) // max(1, len(pieces) // LEAF)))
            return self._joined([_Node(pieces[i : i + size], counts[i : i + size]) for i in range(0, len(pieces), size)]), None if place else new
        middle = start + node.left.chars
        left, new = self._put(node.left, start, low, high, new)
        right, new = self._put(node.right, middle, low, high, new)
        return _Node(None, None, left, right), new


_TREE = "text string, lengths array<int>, counts array<int>, n_tokens long, encoded_chars long"
_EDITS = "array<struct<start:long,deleted:long,inserted:string>>"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def token_trees(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, text, lengths, counts, n_tokens, encoded_chars): the tree of each document as it can be stored; its sums are those of counts."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                tree = TokenTree(bpe, t)
                rows.append((k, *tree.parts(), tree.n_tokens, tree.built))
            yield pd.DataFrame(rows, columns=[key, *_names(_TREE)])

    chosen = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    return chosen.mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, {_TREE}")


def edit_trees(trees: DataFrame, edits: Column, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """The next version of ``token_trees``, whose encoded_chars tells how much text was encoded for the edits.

    ``edits`` is a column array<struct<start, deleted, inserted>>, in order.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            rows = []
            for k, t, lengths, counts, todo in zip(*(batch[c] for c in ("k", "text", "lengths", "counts", "todo")), strict=True):
                tree = TokenTree(bpe, t, lengths, counts)
                for e in todo:
                    tree.edit(int(e["start"] or 0), int(e["deleted"] or 0), e["inserted"] or "")
                rows.append((k, *tree.parts(), tree.n_tokens, tree.encoded))
            yield pd.DataFrame(rows, columns=[key, *_names(_TREE)])

    chosen = trees.select(F.col(key).alias("k"), "text", "lengths", "counts", F.coalesce(edits.cast(_EDITS), F.array().cast(_EDITS)).alias("todo"))
    return chosen.mapInPandas(run, f"{key} {trees.schema[key].dataType.simpleString()}, {_TREE}")


_RESULT = "n_tokens long, n_tokens_after long, n_edits long, encoded_chars long, n_chars_after long, after_sha256 string, built_chars long"


def count_after_edits(docs: DataFrame, edits: Column, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, n_tokens_after, n_edits, encoded_chars, n_chars_after, after_sha256, built_chars).

    The trees of ``token_trees`` and ``edit_trees`` without storing them.
    ``edits`` is a column array<struct<start, deleted, inserted>>, in order.
    encoded_chars tells how much text was encoded again for the edits,
    built_chars how much for the trees.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            rows = []
            for k, t, todo in zip(batch["k"], batch["t"], batch["edits"], strict=True):
                tree = TokenTree(bpe, t)
                before = tree.n_tokens
                for e in todo:
                    tree.edit(int(e["start"] or 0), int(e["deleted"] or 0), e["inserted"] or "")
                after = tree.text()
                rows.append((k, before, tree.n_tokens, len(todo), tree.encoded, len(after), hashlib.sha256(after.encode()).hexdigest(), tree.built))
            yield pd.DataFrame(rows, columns=[key, *_names(_RESULT)])

    chosen = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"), F.coalesce(edits.cast(_EDITS), F.array().cast(_EDITS)).alias("edits"))
    return chosen.mapInPandas(run, f"{key} {kind}, {_RESULT}")


def with_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the edits (key, no, start, deleted, inserted) of each document as an array, in the order of ``no``.

    The array is called ``edits``, or ``_edits`` and so on where ``docs`` has that name.
    """
    own = free_name("edits", docs)
    packed = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "start", "deleted", "inserted"))).alias("_all"))
    packed = packed.select(key, F.transform("_all", lambda e: F.struct(e["start"].alias("start"), e["deleted"].alias("deleted"), e["inserted"].alias("inserted"))).alias(own))
    return docs.join(packed, key, "left")


def revision(text: Column) -> Column:
    """Edits that make a next version of any text: its first line goes, a sentence comes in the middle, the last ten characters are written anew."""
    size = F.char_length(F.coalesce(text, F.lit(""))).cast("long")
    line = F.when(F.contains(text, F.lit("\n")), F.instr(text, "\n")).otherwise(F.lit(0)).cast("long")
    left = size - line
    note = F.lit(" This sentence was added later; it has 11 words.\n")
    edit = lambda start, deleted, inserted: F.struct(start.alias("start"), deleted.alias("deleted"), inserted.alias("inserted"))
    tail = F.greatest(left + F.char_length(note) - 10, F.lit(0))
    return F.array(edit(F.lit(0).cast("long"), line, F.lit("")), edit(F.floor(left / 2).cast("long"), F.lit(0).cast("long"), note), edit(tail, F.lit(10).cast("long"), F.lit(" [end]")))


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_after_edits(docs, revision(F.col("text")))
