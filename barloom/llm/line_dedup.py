"""Line dedup: an exact set-similarity join of lines (DataFrame functions only).

A line's set is its distinct lower-cased words. Lines of fewer than
``min_words`` distinct words are left alone; by default every line that has a
word takes part. A line is removed if an earlier
line, in the order (doc_id, line number), has a Jaccard similarity of 0.75 or
more with it, whether or not that earlier line stays itself.

Equal sets are one class, of which the first line stands for all. The words of
a class are ordered, the longest first; two similar sets share a word of their prefixes.
Every class is joined, by all prefix words, with all earlier classes, under the
length, positional and parity filters, and every pair is verified on its words;
equal sets are given by membership.

Large groups of near copies are not expanded into pairs. Of each group of at
least ``LARGE`` classes that agree in the smallest and the largest hash of their
words the class nearest to the middle is a pole: the one whose parities differ
least from those that most of the group have. Classes that share a prefix
word with a pole are held against it; each belongs to that similar pole which
most classes are similar to, with its ``delta``, the words that only one of the
two has. Sets of n and m words are
similar if they differ in (n + m) / 7 words at most. So two classes of a pole
whose deltas have up to n / 7 and m / 7 words are similar in any case, and such
links are only counted (``near_links``). Other classes of the pole are compared
by their deltas in blocks (``far_links``): two sets differ in the words that are
in one of the deltas. All pairs of no common pole are listed.

To cut lines one link of a line is enough: ``removed_lines`` leaves out the
pairs of a common pole and those of classes that are known to be similar to an
earlier one by their pole.

Any order of words that is the same for all sets loses no pair; rare words first
leave the fewest pairs to filter. Long words are rare, and their bytes are known
without counting words over all documents: length, then hash.

Of a pair the longer set (of equally long ones the later) looks for the shorter
one, which needs only the first n / 7 + 1 of its prefix for that. Both must agree
in the band of the longer set's size: the shorter one, of m words, has a row in
each band of sizes from m to (4 m - 7 j) / 3, for its word at position j.

Defined cases: ids are of any type that has an order, negative and huge ones too
(texts are ordered by their bytes); NULL texts and rows of NULL ids stay as they
are and have no lines; repeated rows have the same lines at the same place and are kept or cut
alike; empty lines and lines of fewer than ``min_words`` words stay; other
columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import MAX_BROADCAST, free_name, known_join, only, place, stash, table

MIN_WORDS = 1
LARGE = 32  # smaller groups of near copies are listed as pairs: at most so many for each class
LONG, LONGER = 80, 150  # sets of more words have 128 and 256 parities instead of 64
PARITIES = ["parity", "parity2", "parity3", "parity4"]
MAX_COPIES = 1_000_000  # places, of 8 bytes each, that may be broadcast
MOST = (1 << 16) - 1  # larger sets are stored with this size
BAND = 1.6  # sizes of a band differ by this factor at most; narrower bands leave fewer pairs and need more rows
DIGIT = 4  # bits of a place that near_links takes at a time
BLOCK = 256  # classes of a pole that are compared at once


def split_words(text: Column) -> Column:
    """Words between white space, and '' for each further blank; a split at one character needs no pattern."""
    blank = F.when(text.rlike(r"[\x09-\x0D]"), F.regexp_replace(text, r"[\x09-\x0D]", " ")).otherwise(text)
    return F.split(blank, " ")


def words_of(line: Column) -> Column:
    return F.array_remove(F.array_distinct(split_words(line)), "")


class Place:
    """Puts the number of a document and that of a line into one long that orders lines."""

    def __init__(self, most_lines: int, numbers: int):
        bits = max(1, most_lines.bit_length())
        if numbers.bit_length() + bits > 62:
            raise ValueError("places of lines need more than 62 bits")
        self.base, self.digits = 1 << bits, -(-(numbers.bit_length() + bits) // DIGIT)

    def of(self, number: Column, line: Column) -> Column:
        return number * F.lit(self.base).cast("long") + line

    def split(self, at: Column) -> tuple[Column, Column]:
        return F.shiftright(at, self.base.bit_length() - 1), at.bitwiseAND(F.lit(self.base - 1).cast("long")).cast("int")


class Lines:
    """The lines of ``docs``, at places that order them by document and number.

    The number of a document, ``k``, is how far its id is from the smallest one,
    if ids are integers with room for line numbers; else (texts, decimals, ids of
    a wide range) it is the id's rank, which is joined to the texts once.
    """

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.key_type = docs.schema[key].dataType
        whole = isinstance(self.key_type, IntegralType)
        ends = [F.min(key), F.max(key)] if whole else [F.lit(0), F.lit(0)]
        breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n")))
        low, high, most, rows, ids = docs.agg(*ends, F.max(breaks) + 1, F.count(key), F.count_distinct(key)).first()
        self.low, span, most = low or 0, (high or 0) - (low or 0), int(most or 0)
        self.unique = rows == ids  # no document is repeated
        self.ranks: DataFrame | None = None
        found = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
        if whole and span.bit_length() + most.bit_length() <= 62:
            self.docs = found.select((F.col("k").cast("long") - F.lit(self.low).cast("long")).alias("k"), "text")
        else:
            self.ranks = stash(place(found.select(F.col("k").alias("id")).distinct(), [], ["id"], "rank"), "ranks")
            self.docs = stash(found.join(self.ranks, F.col("k") == F.col("id")).select(F.col("rank").alias("k"), "text"), "ranked")
            span = ids
        self.place = Place(most, span)

    def named(self, df: DataFrame, **names: str) -> DataFrame:
        """``df`` with the ids in place of the numbers in its columns ``names``, which get the names given there."""
        for number, name in names.items():
            value = (F.col(number) + F.lit(self.low).cast("long")).cast(self.key_type)
            columns = df.columns
            if self.ranks is not None:
                df, value = df.join(self.ranks.select(F.col("id").alias("_id"), F.col("rank").alias("_rank")), F.col(number) == F.col("_rank")), F.col("_id")
            df = df.select(*(value.alias(name) if c == number else F.col(c) for c in columns))
        return df

    def all(self) -> DataFrame:
        """(at, line), lower-cased."""
        return self._split(self.docs, F.lower("text"))

    def _split(self, docs: DataFrame, text: Column) -> DataFrame:
        each = docs.select("k", F.posexplode(F.split(text, "\n")).alias("no", "line"))
        return each.select(self.place.of(F.col("k"), F.col("no")).alias("at"), "line")

    def at(self, wanted: DataFrame) -> DataFrame:
        """(at, line), lower-cased, of the places in ``wanted``; only their documents are split. Repeated rows count once."""
        ids = stash(wanted.select(self.place.split(F.col("at"))[0].alias("k")).distinct(), "ids")
        found = only(self._split(only(self.docs, ids, "k"), F.col("text")), wanted, "at").select("at", F.lower("line").alias("line"))
        return found if self.unique else found.groupBy("at").agg(F.min("line").alias("line"))


def _prefix(n: Column) -> Column:
    """A set of n shares one of its n - ceil(0.75 n) + 1 first tokens with each similar set."""
    return F.shiftright(n, 2) + 1


def line_sets(lines: DataFrame) -> DataFrame:
    """(at, h1, h2, ends, n, parity, ..., parity4, prefix) of each line.

    A word's token has its length in bytes, modulo 64, in the upper 6 bits, so
    that longer words come first, and 58 bits of its hash. h1 and h2 are the
    digest of a set, ends that of the smallest and largest hash, prefix its first
    tokens, cut to their upper 40 bits. parity has a bit
    for each of 64 groups of words, set if the set holds an odd number of them:
    two sets differ in at least as many words as their parities in bits. Long
    sets have more groups: parity2 counts the words with bit 6 of their hash,
    parity3 those with bit 7 and parity4 those with both; else these are NULL.
    """
    token = lambda w: F.shiftrightunsigned(F.xxhash64(w), 6).bitwiseXOR(F.shiftleft((31 - F.octet_length(w)).cast("long"), 58))
    tokens = F.array_remove(F.array_distinct(F.transform(split_words(F.col("line")), token)), token(F.lit("")))
    sets = lines.select("at", F.sort_array(tokens).alias("tokens"))
    sets = sets.select("at", "tokens", F.transform("tokens", lambda t: F.shiftright(F.shiftleft(t, 6), 32).cast("int")).alias("hashes"))
    one = F.lit(1).cast("long")

    def parity(least: int, mask: int) -> Column:
        flip = lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", one, h))  # noqa: E731  by the last 6 bits of h
        of = lambda a, h: flip(a, h) if not mask else F.when(h.bitwiseAND(F.lit(mask)) == mask, flip(a, h)).otherwise(a)
        return F.when(F.size("hashes") > least, F.aggregate("hashes", F.lit(0).cast("long"), of))

    return sets.select(
        "at",
        F.xxhash64("tokens").alias("h1"),
        F.xxhash64(F.lit(1), "tokens").alias("h2"),
        F.xxhash64(F.array_min("hashes"), F.array_max("hashes")).alias("ends"),
        F.size("tokens").alias("n"),
        *(parity(*how).alias(name) for name, how in zip(PARITIES, ((0, 0), (LONG, 64), (LONGER, 128), (LONGER, 192)), strict=True)),
        F.transform(F.slice("tokens", 1, _prefix(F.size("tokens"))), lambda t: t.bitwiseAND(F.lit(-1 << 24).cast("long"))).alias("prefix"),
    )


def copies(sets: DataFrame) -> DataFrame:
    """(x, y): lines x whose set is that of an earlier line, and the first line y of their class."""
    light = sets.select("at", "h1", "h2")
    firsts = light.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").drop("last")
    firsts = stash(firsts, "firsts")
    small = firsts.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return light.join(F.broadcast(firsts) if small else firsts, ["h1", "h2"]).where("at <> first").select(F.col("at").alias("x"), F.col("first").alias("y")).distinct()


def verify(pairs: DataFrame, lines: Lines) -> DataFrame:
    """(x, y, words_x, words_y) of the pairs of places of lines whose word sets have Jaccard 0.75 or more; the words as they stand, '' among them."""
    wanted = stash(pairs.select(F.col("x").alias("at")).union(pairs.select(F.col("y").alias("at"))).distinct(), "wanted")
    texts = stash(lines.at(wanted), "texts")
    side = lambda c: texts.select(F.col("at").alias(c), F.col("line").alias(f"line_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    # lines are moved, which are smaller than lists of their words; inline keeps the filter from splitting them twice
    both = both.select("x", "y", F.inline(F.array(F.struct(*(split_words(F.col(f"line_{c}")).alias(f"words_{c}") for c in "xy")))))
    same, all_words = (F.size(F.array_remove(of("words_x", "words_y"), "")) for of in (F.array_intersect, F.array_union))
    return both.where(4 * same >= 3 * all_words)


def _band(size: Column) -> Column:
    return F.floor(F.log(F.least(size, F.lit(MOST)).cast("double")) * (1 / math.log(BAND))).cast("long")


def _index(classes: DataFrame, reach: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """(entry, ...): a row for each prefix token, in the band of the set's size; or in the bands of the sizes from ``reach`` (size, position).

    entry holds 34 bits of the token's hash, the band, the size of the set and
    the token's position. Positions beyond 255 are stored as 255, and as 0 in sets
    of more than ``MOST`` words, which only lets more pairs pass.
    """
    rest = [c for c in classes.columns if c not in ("n", "prefix")]
    each = classes.select("n", _band(F.col("n")).alias("band"), *rest, F.posexplode("prefix").alias("pos", "token"))
    each = each.withColumns({"n": F.least("n", F.lit(MOST)), "pos": F.when(F.col("n") < MOST, F.least("pos", F.lit(255))).otherwise(0)})
    if reach:
        each = each.select("n", "pos", "token", *rest, F.explode(F.sequence(*map(_band, reach(F.col("n"), F.col("pos"))))).alias("band"))
    low = F.shiftleft("band", 24).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 8)).bitwiseOR(F.col("pos").cast("long"))
    return each.select(F.shiftleft("token", 6).bitwiseOR(low).alias("entry"), *rest)


def _side(index: DataFrame, c: str) -> DataFrame:
    return index.select(*((F.col(f).alias(c) if f == "at" else F.col(f).alias(f"{f}_{c}")) for f in index.columns))


def _token(entry: str) -> Column:
    """A token's hash and a band."""
    return F.shiftright(entry, 24)


def _sizes(c: str) -> tuple[Column, Column]:
    """The size and the position of an entry."""
    return F.shiftright(f"entry_{c}", 8).bitwiseAND(F.lit(MOST).cast("long")).cast("int"), F.col(f"entry_{c}").bitwiseAND(F.lit(255).cast("long")).cast("int")


def _alike() -> Column:
    """The filters of pairs (x, y) of entries of one token, the cheapest first.

    What follows a first shared token, at positions i and j, bounds the overlap:
    n - i and m - j are at least 3 (n + m) / 7, which bounds the lengths too;
    entries of later shared tokens may go, as that of the first stays. Then the
    parities bound the difference. Sizes stored as ``MOST`` only let more pass.
    """
    (n, i), (m, j) = _sizes("x"), _sizes("y")
    a, b, c, d = (F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y")) for p in PARITIES)
    bits = lambda *ps: F.bit_count(reduce(Column.bitwiseXOR, ps))
    differing = F.coalesce(bits(d) + bits(b, d) + bits(c, d) + bits(a, b, c, d), bits(b) + bits(a, b), bits(a))
    return (4 * n - 7 * i >= 3 * m) & (4 * m - 7 * j >= 3 * n) & (7 * differing <= n + m)


def _candidates(x: DataFrame, y: DataFrame, more: Column) -> DataFrame:
    """(x, y): pairs that share a prefix token and a band and pass the filters and ``more``."""
    return x.join(y, _token("entry_x") == _token("entry_y")).where(_alike() & more).select("x", "y").distinct()


def _middles(classes: DataFrame) -> DataFrame:
    """(at): of each group of classes with the same ends, ``LARGE`` of which or more are near its middle, the one nearest to that.

    The middle is only known by its parity, which has each bit as most of the
    group have it; so groups of any size are sums of 64 bits.
    """
    groups = stash(classes.groupBy("ends").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE).select("ends"), "groups")
    members = stash(only(classes.select("ends", "at", "n", "parity"), groups, "ends"), "members")
    most = lambda b: 2 * F.sum(F.getbit("parity", F.lit(b))) > F.count("*")
    bits = members.groupBy("ends").agg(*(most(b).alias(f"b{b}") for b in range(64)))
    middle = reduce(Column.bitwiseOR, (F.when(F.col(f"b{b}"), F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)))
    off = F.bit_count(F.col("parity").bitwiseXOR(F.col("middle")))
    placed = known_join(members, stash(bits.select("ends", middle.alias("middle")), "middles"), ["ends"])
    found = placed.groupBy("ends").agg(F.min_by("at", F.struct(off, "at")).alias("at"), F.count_if(7 * off <= 2 * F.col("n")).alias("near"))
    return found.where(F.col("near") >= LARGE).select("at")


def _poles(classes: DataFrame, lines: Lines) -> DataFrame:
    """(x, pole, n, delta): the classes, of n words, that are similar to poles or are one, with that pole which most are similar to."""
    columns = ["at", "n", *PARITIES, "prefix"]
    poles = stash(only(classes, stash(_middles(classes), "poles"), "at").select(columns), "poles")
    of_pole = _side(_index(poles, lambda m, j: (F.greatest(F.floor(3 * m / 4), F.lit(1)), F.floor(4 * m / 3))), "y")
    small = of_pole.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    pairs = _candidates(_side(_index(classes.select(columns)), "x"), F.broadcast(of_pole) if small else of_pole, F.col("x") != F.col("y"))
    only_one = F.array_remove(F.concat(F.array_except("words_x", "words_y"), F.array_except("words_y", "words_x")), "")
    n = F.size(F.array_remove(F.array_distinct("words_x"), ""))
    found = verify(stash(pairs, "pairs"), lines).select("x", "y", n.alias("n"), only_one.alias("delta"))
    found = stash(found.union(poles.select("at", "at", "n", F.array().cast("array<string>"))), "of_poles")
    sizes = found.groupBy("y").agg(F.count("*").alias("size"))
    found = known_join(found, stash(sizes, "sizes"), ["y"])
    first = F.struct(-F.col("size"), "y")
    return stash(found.groupBy("x").agg(F.min_by("y", first).alias("pole"), F.first("n").alias("n"), F.min_by("delta", first).alias("delta")), "at_poles")


def _pairs(classes: DataFrame, skip: DataFrame, lines: Lines) -> DataFrame:
    """(x, y): all similar pairs of a class x and an earlier class y but those to be skipped.

    ``skip`` has (at, mark): pairs of one pole, which is mark, or -1 - mark, and
    those of a class x with a mark below 0 are skipped.
    """
    sets = classes.join(skip, "at", "left").select("n", "parity", "at", "mark", *PARITIES[1:], "prefix")
    longer = _side(_index(sets), "x")
    (n, _), (m, _) = _sizes("x"), _sizes("y")
    # a set of m words can be the shorter one at positions j <= m / 7 only, whatever n >= m is: 3 n is at most 4 m - 7 j
    first = F.when(F.col("n") < MOST, F.slice("prefix", 1, (F.col("n") / 7).cast("int") + 1)).otherwise(F.col("prefix"))
    shorter = _side(_index(sets.withColumn("prefix", first), lambda m, j: (m, F.greatest(m, F.floor((4 * m - 7 * j) / 3)))), "y")
    late = F.col("y") < F.col("x")
    order = (n > m) | ((n == m) & (late | (m == MOST)))
    pole = lambda c: F.greatest(F.col(c), -1 - F.col(c))
    skipped = F.coalesce(pole("mark_x") == pole("mark_y"), F.lit(False)) | F.coalesce(F.when(late, F.col("mark_x")).otherwise(F.col("mark_y")) < 0, F.lit(False))
    pairs = _candidates(longer, shorter, order & (F.col("x") != F.col("y")) & ~skipped).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    return verify(stash(pairs, "pairs"), lines).select("x", "y")


def _matched(members: DataFrame) -> DataFrame:
    """(at): members of poles that are similar to an earlier member: to the pole, both are near it, or by their differences."""
    first = members.where(_near()).groupBy("pole").agg(F.min("x").alias("first"))
    late = (F.col("pole") < F.col("x")) | (_near() & (F.col("first") < F.col("x")))
    known = stash(members.join(first, "pole", "left").withColumn("late", F.coalesce(late, F.lit(False))), "known")
    return known.where("late").select(F.col("x").alias("at")).union(far_links(known.drop("first")).select("x")).distinct()


def _near() -> Column:
    return F.expr("7 * size(delta) <= n")


def near_links(members: DataFrame, digits: int) -> DataFrame:
    """(x, links): how many earlier near members of its pole each near member has; all of them are similar.

    Places are compared digit by digit: y < x if they agree in all higher digits
    and y has a smaller one. So a pole's members are only ever gathered as
    counts of one digit under common higher digits.
    """
    levels = F.sequence(F.lit(0), F.lit(max(digits, 1) - 1))
    up = lambda by: F.call_function("shiftright", F.col("x"), (DIGIT * (F.col("level") + by)).cast("int"))
    each = members.where(_near()).select("x", "pole", F.explode(levels).alias("level"))
    each = each.select("x", "pole", "level", up(1).alias("above"), up(0).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long")).cast("int").alias("digit"))
    cells = each.groupBy("pole", "level", "above", "digit").agg(F.count("*").alias("c"))
    groups = cells.groupBy("pole", "level", "above").agg(F.collect_list(F.struct("digit", "c")).alias("all")).where(F.size("all") > 1)
    cell = groups.select("pole", "level", "above", "all", F.explode("all.digit").alias("digit"))
    before = F.aggregate("all", F.lit(0).cast("long"), lambda a, o: F.when(o["digit"] < F.col("digit"), a + o["c"]).otherwise(a))
    counts = cell.select("pole", "level", "above", "digit", before.alias("links")).where("links > 0")
    return each.join(counts, ["pole", "level", "above", "digit"]).groupBy("x").agg(F.sum("links").alias("links"))


def far_links(members: DataFrame, listed: bool = False) -> DataFrame:
    """(x, links): the number of earlier similar members of x's pole, in rows of some of them, for pairs of which one or both are far.

    With ``listed`` (x, y), a row for each of them. Members that are known to be
    ``late``, if that column is there, look for no earlier ones.
    """
    sizes = members.groupBy("pole", _near().alias("near")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = stash(sizes.groupBy("pole").agg(*(F.coalesce(F.max(F.when(c, F.col("blocks"))), F.lit(0)).alias(n) for n, c in (("near_blocks", F.col("near")), ("far_blocks", ~F.col("near"))))).where("far_blocks > 0"), "blocks")
    own = members.join(sizes, "pole").withColumn("near", _near())
    lists = own.groupBy("pole", F.col("near").alias("listed"), F.pmod(F.xxhash64("x"), F.when(_near(), F.col("near_blocks")).otherwise(F.col("far_blocks"))).cast("int").alias("block"))
    lists = lists.agg(F.collect_list(F.struct("x", "n", "delta")).alias("others"))
    blocks = lambda c, listed: F.transform(F.sequence(F.lit(1), F.col(c)), lambda b: F.struct(F.lit(listed).alias("listed"), (b - 1).alias("block")))
    far, near = blocks("far_blocks", False), F.when(F.col("near") | (F.col("near_blocks") == 0), F.array()).otherwise(blocks("near_blocks", True))
    asked = (own.where("not late") if "late" in own.columns else own).select("pole", "x", "n", "delta", F.inline(F.concat(far, near)))
    both = asked.join(lists, ["pole", "listed", "block"])
    differ = lambda o: F.size("delta") + F.size(o["delta"]) - 2 * F.size(F.array_intersect(F.col("delta"), o["delta"]))
    found = F.filter("others", lambda o: (o["x"] < F.col("x")) & (7 * differ(o) <= F.col("n") + o["n"]))
    if listed:
        return both.select("x", F.explode(F.transform(found, lambda o: o["x"])).alias("y"))
    return both.select("x", F.size(found).cast("long").alias("links")).where("links > 0")


class Join:
    """The similarity join of the lines of ``docs``: copies (x, y), at_poles (x, pole, n, delta) and further pairs (x, y).

    Pairs of one pole are not among them. Without ``links`` pairs lack those of lines in matched, (at), too, which have an earlier similar line.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, min_words: int, links: bool):
        self.lines = Lines(docs, key, text)
        sets = stash(line_sets(self.lines.all()), "lines").where(F.col("n") >= max(min_words, 1))
        self.copies = stash(copies(sets), "copies")
        gone, rest = self.copies.select(F.col("x").alias("at")), ["ends", "n", *PARITIES, "prefix"]
        small = self.lines.unique and gone.limit(MAX_COPIES + 1).count() <= MAX_COPIES
        self.classes = sets.select("at", *rest).join(F.broadcast(gone) if small else gone.hint("merge"), "at", "left_anti")
        if not small:  # rows of one place, from repeated documents, are one
            self.classes = stash(self.classes.groupBy("at").agg(*(F.first(c).alias(c) for c in rest)), "classes")
        self.at_poles = _poles(self.classes, self.lines)
        self.matched = None if links else stash(_matched(self.at_poles), "matched")
        skip = self.at_poles.select(F.col("x").alias("at"), F.col("pole").alias("mark"))
        if not links:
            late = self.matched.withColumn("late", F.lit(True))
            skip = skip.join(late, "at", "left").select("at", F.when(F.col("late"), -1 - F.col("mark")).otherwise(F.col("mark")).alias("mark"))
        self.pairs = stash(_pairs(self.classes, skip, self.lines), "links")


def line_links(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, no, to_key, to_no, same): every similar pair of classes of lines, and with ``same`` each copy's membership.

    A class is known by its first line; the pair stands with the later one. This
    lists what ``linked_lines`` only counts, so it is as large as the number of links.
    """
    join = Join(docs, key, text, min_words, links=True)
    at, near = join.lines.place, join.at_poles.where(_near())
    known = near.select("x", "pole").join(near.select(F.col("x").alias("y"), "pole"), "pole").where("y < x").select("x", "y")
    known = known.union(far_links(join.at_poles, listed=True))
    both = join.pairs.union(known).withColumn("same", F.lit(False)).union(join.copies.withColumn("same", F.lit(True)))
    (k, no), (to, to_no) = at.split(F.col("x")), at.split(F.col("y"))
    return join.lines.named(both.select(k.alias("k"), no.alias("no"), to.alias("to"), to_no.alias("to_no"), "same"), k=key, to=f"to_{key}")


def linked_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, removed, links): as ``removed_lines``, with the number of links that the lines have to earlier ones."""
    join = Join(docs, key, text, min_words, links=True)
    one = F.lit(1).cast("long").alias("links")
    links = join.pairs.select("x", one).union(join.copies.select("x", one)).union(near_links(join.at_poles, join.lines.place.digits))
    links = links.union(far_links(join.at_poles))
    k, number = join.lines.place.split(F.col("x"))
    gone = links.groupBy("x").agg(F.sum("links").alias("links")).select(k.alias("k"), number.alias("no"), "links")
    return join.lines.named(gone.groupBy("k").agg(F.array_sort(F.collect_list("no")).alias("removed"), F.sum("links").alias("links")), k=key)


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, removed): the numbers of the lines to cut, sorted, of each document that has any."""
    join = Join(docs, key, text, min_words, links=False)
    k, number = join.lines.place.split(F.col("x"))
    gone = join.pairs.select("x").union(join.copies.select("x")).union(join.matched.select("at")).distinct()
    return join.lines.named(gone.select(k.alias("k"), number.alias("no")).groupBy("k").agg(F.array_sort(F.collect_list("no")).alias("removed")), k=key)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", with_links: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later similar lines cut out of ``text``; with ``with_links`` also their numbers, in ``removed_lines``, and n_links, how many links they have."""
    gone = linked_lines(docs, key, text, min_words) if with_links else removed_lines(docs, key, text, min_words)
    of, removed, links, split = (free_name(c, docs) for c in ("of", "removed", "links", "split"))
    gone = stash(gone, "removed")
    gone = gone.withColumnsRenamed(dict(zip(gone.columns, (of, removed, links), strict=False)))
    rows, numbers = gone.agg(F.count("*"), F.coalesce(F.sum(F.size(removed)), F.lit(0))).first()
    small = rows <= MAX_BROADCAST and numbers <= 4 * MAX_BROADCAST
    joined = docs.join(F.broadcast(gone) if small else gone, F.col(key) == F.col(of), "left")
    joined = joined.withColumn(split, F.when(F.col(removed).isNotNull(), F.split(F.col(text), "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(removed))
    new = F.when(F.col(removed).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    out = [new.alias(text) if c == text else F.col(c) for c in docs.columns]
    if with_links:
        out += [F.coalesce(removed, F.array().cast("array<int>")).alias("removed_lines"), F.coalesce(links, F.lit(0)).cast("long").alias("n_links")]
    return joined.select(*out)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, with_links=True)
    return out.select(
        "doc_id",
        "n_links",
        F.array_join("removed_lines", ",").alias("removed_lines"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
