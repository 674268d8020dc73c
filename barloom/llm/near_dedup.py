"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct five-word shingles, as 64-bit fingerprints.
Each of 256 buckets keeps, of the smallest fingerprint that falls into it, the
number of leading zeros and ten mantissa bits. Bands of five such compressed
registers (empty buckets borrow from a filled one, by a fixed probe order) give
candidates; the registers then give a collision-corrected Jaccard estimate, and
what may still be similar is verified on the full sets. Sets of up to 64
shingles, for which 256 buckets say little, are found by the prefixes of their
sorted fingerprints, which miss nothing.

Documents of equal sets are one class, known by a 128-bit digest of the set, of
which the first stands for all.

Candidate pairs are not all pairs of a bucket. First each member is held
against the bucket's smallest one; links join into components. A document that
is half similar or more to such a smallest one has the one with most of these as
its pole. Where a pole has documents outside of its own component, all documents
of the pole are told apart by their deltas, the fingerprints that only they or
the pole have: two sets differ in what is in one of their deltas. Documents
outside meet the others in blocks there, and give one link for each component.

Only where a bucket still has several components of several poles, its members
outside the smallest one's component are compared with those of other components,
register against register, in blocks; nodes linked with the smallest one are left
out of this where the triangle inequality of the Jaccard distance rules a link out.

Defined cases: NULL and wordless texts have an empty set and stay alone;
repeated rows and equal texts share a component; rows of one id are one
document, which is kept or not as a whole; a row of a NULL id has a NULL
``kept``, and ``keep_first`` keeps it; other columns are ignored by ``near_duplicates`` and
kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import known_join, only, stash, table
from .components import components

SHINGLE = 5
BUCKETS = 256
MANTISSA = 10
BAND = 5  # registers in a band; 51 bands find a pair of similarity 0.75 with probability 1 - 1e-6
SMALL = 64  # sets of up to so many shingles are found by prefixes
SMALL_TOO = SMALL * 4 // 3 + 1  # and the largest sets that can be similar to them
DEVIATIONS = 4.5  # a pair is verified unless its estimate is more than so many standard deviations too low
TINY = 12  # sets for which a single shared bucket tells too much: always verified
BLOCK = 512
WORDS = 100_000  # word fingerprints that a worker remembers

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def words_of(text: str | None) -> list[bytes]:
    """Words without white space, A-Z lower-cased: both bytes methods touch ASCII only."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct fingerprints of the five-word shingles; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return _mix((h * _ODD[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _ODD[0]
    for i in range(1, SHINGLE):
        s += h[i : i + n] * _ODD[i]
    return np.unique(_mix(s))


def registers(u: np.ndarray) -> np.ndarray:
    """Of sorted fingerprints: for each bucket 0 if empty, else leading zeros + 1 and, below, the inverted mantissa; larger is a smaller hash."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(u):
        bucket = (u >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = (u[first] << np.uint64(8)) | np.uint64(255)
        zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)  # 53 bits are exact in a double
        tail = (rest << zeros.astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = ((zeros + 1) << MANTISSA) | (2**MANTISSA - 1 - tail.astype(np.int64))
    return out


_PROBES = (_mix(np.arange(BUCKETS * 64, dtype=np.uint64) + np.uint64(77)) % np.uint64(BUCKETS)).astype(np.int64).reshape(BUCKETS, 64)
_BANDS = BUCKETS // BAND


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key for each band of registers; an empty register takes the first filled one of its probe order."""
    full = regs > 0
    source = np.arange(BUCKETS)
    empty = np.flatnonzero(~full)
    if len(empty):
        tried = full[_PROBES[empty]]
        some = tried.any(1)
        source[empty[some]] = _PROBES[empty[some], tried[some].argmax(1)]
        source[empty[~some]] = np.flatnonzero(full)[0]
    values = regs[source].astype(np.uint64)[: _BANDS * BAND].reshape(_BANDS, BAND)
    return _mix((values * _ODD).sum(1) + np.arange(1, _BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def keys_of(u: np.ndarray, regs: np.ndarray) -> np.ndarray:
    keys = []
    if 0 < len(u) <= SMALL_TOO:
        keys.append(u[: len(u) // 4 + 1] ^ np.uint64(0x5555555555555555))
    if len(u) > SMALL:
        keys.append(band_keys(regs))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate of register rows and its standard deviation at most.

    Of the registers filled in either, the share of equal ones, less those
    expected to be equal by chance.
    """
    either = ((a > 0) | (b > 0)).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    ratio = n_a / np.maximum(n_b, 1)
    chance = 0.17 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2 * either
    return np.maximum(equal - chance, 0) / np.maximum(either - chance, 1), np.sqrt(0.25 / np.maximum(either, 1))


def _may_have(least: float, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether sizes and registers leave a similarity of ``least`` possible."""
    smaller = np.minimum(n_a, n_b)
    about, deviation = estimate(a, b, n_a, n_b)
    return (smaller >= least * np.maximum(n_a, n_b)) & ((smaller <= TINY) | (about >= least - DEVIATIONS * 2 * np.sqrt(least * (1 - least)) * deviation))


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, n, h1, h2, regs, keys, words) of each row; node is a number of its own, fixed once this is written."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                w = words_of(t)
                u = shingles(w)
                regs = registers(u)
                digest = np.frombuffer(xxhash.xxh3_128_digest(u.tobytes()), np.int64)
                rows.append((k, len(u), *digest, regs.tobytes(), keys_of(u, regs), b" ".join(w)))
            yield pd.DataFrame(rows, columns=[key, "n", "h1", "h2", "regs", "keys", "words"])

    made = docs.select(key, text).mapInPandas(run, f"{key} {kind}, n int, h1 long, h2 long, regs binary, keys array<long>, words binary")
    return made.withColumn("node", F.monotonically_increasing_id())


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of equal keys in rows that are sorted by them, over batches."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        if not len(batch):
            continue
        changes = np.flatnonzero(np.logical_or.reduce([columns[k][1:] != columns[k][:-1] for k in keys])) + 1
        for a, b in zip([0, *changes], [*changes, len(batch)], strict=True):
            part = {c: v[a:b] for c, v in columns.items()}
            if held is not None and all(held[k][0] == part[k][0] for k in keys):
                held = {c: np.concatenate([held[c], part[c]]) for c in held}
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held


def _regs(column: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, BUCKETS)


def _held_against(pairs: DataFrame, sketch: DataFrame, made: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``made`` of each u of ``pairs`` and its partners v: (u, its fingerprints, its registers, v, n, registers, words).

    The words of v travel to u; a u with many partners is split into groups of
    about ``BLOCK``, each with its own copy of u's words.
    """
    wanted = stash(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), "wanted")
    texts = only(sketch, wanted, "node").select("node", "n", "regs", "words")
    degree = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = pairs.join(degree, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    named = texts.select(F.col("node").alias("t"), "n", "regs", "words")
    left = dealt.join(named, F.col("v") == F.col("t")).select("u", "part", "v", "n", "regs", "words")
    # u itself comes first in each of its groups
    right = dealt.select("u", "part").distinct().join(named, F.col("u") == F.col("t")).select("u", "part", F.lit(-1).cast("long").alias("v"), "n", "regs", "words")
    rows = left.unionByName(right).repartition("u", "part").sortWithinPartitions("u", "part", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["u", "part"]):
            start = int((g["v"] < 0).sum())
            if start and start < len(g["v"]):
                regs = _regs(g["regs"])
                yield made(g["u"][0], shingles(g["words"][0].split()), regs[:1], g["v"][start:], g["n"][start:], regs[start:], g["words"][start:])

    return rows.mapInPandas(run, schema)


def verify(pairs: DataFrame, sketch: DataFrame, with_near: bool = False) -> DataFrame:
    """(u, v, linked) of the pairs whose similarity is, or may be, 0.5 or more.

    Without ``with_near`` only the linked ones are returned.
    linked is whether their full sets have 100 * intersection >= 75 * union;
    only pairs whose registers rule that out go without a look at the sets.
    """

    def made(u: int, own: np.ndarray, own_regs: np.ndarray, v: np.ndarray, n: np.ndarray, regs: np.ndarray, words: np.ndarray) -> pd.DataFrame:
        sides = regs, own_regs, n, np.full(len(n), len(own))
        may = _may_have(0.75, *sides)
        near = _may_have(0.5, *sides) if with_near else np.zeros(len(n), bool)
        linked = np.zeros(len(n), bool)
        for i in np.flatnonzero(may):
            s = shingles(words[i].split())
            both = np.isin(s, own, assume_unique=True).sum()
            union = len(s) + len(own) - both
            linked[i], near[i] = 100 * both >= 75 * union, with_near and 2 * both >= union
        told = near | linked
        return pd.DataFrame({"u": u, "v": v[told], "linked": linked[told]})

    return _held_against(pairs, sketch, made, "u long, v long, linked boolean")


def deltas(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(u, v, n, delta) of pairs: the fingerprints that one of the two has, sorted, as bytes; n is the size of v."""

    def made(u: int, own: np.ndarray, own_regs: np.ndarray, v: np.ndarray, n: np.ndarray, regs: np.ndarray, words: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"u": u, "v": v, "n": n, "delta": [np.setxor1d(shingles(w.split()), own, assume_unique=True).tobytes() for w in words]})

    return _held_against(pairs, sketch, made, "u long, v long, n int, delta binary")


def _pole_links(members: DataFrame, sketch: DataFrame) -> DataFrame:
    """(u, v): links between documents of one pole, enough to join their components.

    ``members`` has (pole, node, label, pole_label) of the poles that have
    documents of other components. Those are compared with all documents of the
    pole, of which each task holds one block.
    """
    made = deltas(members.select(F.col("pole").alias("u"), F.col("node").alias("v")), sketch)
    known = stash(made.withColumnsRenamed({"u": "pole", "v": "node"}).join(members, ["pole", "node"]), "deltas")
    blocks = known.groupBy("pole").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = known.join(blocks, "pole")
    columns = ["node", "label", "n", "delta"]
    right = dealt.select("pole", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("inside"), *columns)
    left = dealt.where("label <> pole_label").select("pole", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("inside"), *columns)
    rows = left.unionByName(right).repartition("pole", "block").sortWithinPartitions("pole", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["pole", "block"]):
            inside = g["inside"].astype(bool)
            if inside.all() or not inside.any():
                continue
            sets = [np.frombuffer(d, np.uint64) for d in g["delta"]]
            held = np.flatnonzero(inside)
            n, label, node, sizes = g["n"][held], g["label"][held], g["node"][held], np.array([len(sets[k]) for k in held])
            order = np.argsort(all_ := np.concatenate([sets[k] for k in held]), kind="stable")
            values, owners = all_[order], np.repeat(np.arange(len(held)), sizes)[order]
            us, vs = [], []
            for i in np.flatnonzero(~inside):
                own = sets[i]
                lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, "right")
                found = owners[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())]
                differ = sizes + len(own) - 2 * np.bincount(found, minlength=len(held))
                # of n + m - differ = 2 both and n + m + differ = 2 union
                total = n + g["n"][i]
                near = np.flatnonzero((100 * (total - differ) >= 75 * (total + differ)) & (label != g["label"][i]))
                other = node[near[np.unique(label[near], return_index=True)[1]]]
                us.append(np.minimum(other, g["node"][i]))
                vs.append(np.maximum(other, g["node"][i]))
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return rows.mapInPandas(run, "u long, v long").distinct()


def _poles(near: DataFrame) -> DataFrame:
    """(node, pole): of the documents u that a document v is half similar to, the one with most of such."""
    degree = near.groupBy("u").agg(F.count("*").alias("degree"))
    return near.select("u", "v").join(degree, "u").groupBy(F.col("v").alias("node")).agg(F.max_by("u", F.struct("degree", -F.col("u"))).alias("pole"))


def _other_pairs(named: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs of different components and poles that share a bucket, but for those with its smallest node, which were verified.

    ``named`` has (key, node, head, label, pole, linked) of all buckets with
    several nodes; linked tells of the head and the node, NULL if they are not
    near. 1 - similarity is a distance: a node can only be linked with one that
    is linked with the head if it has itself a similarity of 0.5 with the head.
    Others are not compared with the nodes linked with the head.
    """
    outside, near, head = F.col("label") != F.col("head_label"), F.col("linked").isNotNull(), F.col("node") == F.col("head")
    rest = lambda c: (F.min(F.when(~head, F.col(c))) != F.max(F.when(~head, F.col(c)))).alias(f"{c}s")
    open_ = named.groupBy("key").agg(F.max(F.when(head, F.col("label"))).alias("head_label"), rest("label"), rest("pole")).where("labels and poles").select("key", "head_label")
    members = named.join(open_, "key").where("node <> head").select("key", "node", "label", "pole", "head_label", (outside & near).alias("near"), F.coalesce("linked", F.lit(False)).alias("linked"))
    members = stash(members, "open")
    sizes = members.groupBy("key").agg(F.bool_or("near").alias("any_near"), F.count_if(~F.col("linked")).alias("others"), F.count_if("linked").alias("links"))
    # what has no one to be compared with drops out
    sizes = sizes.where("others > 1 or (any_near and links > 0)").select("key", "any_near", F.ceil((F.col("others") + F.when(F.col("any_near"), F.col("links")).otherwise(0)) / BLOCK).cast("int").alias("blocks"))
    members = stash(members.join(sizes, "key").where("any_near or not linked").drop("any_near"), "open")
    wanted = stash(members.select("node").distinct(), "wanted")
    regs_of = only(sketch, wanted, "node").select(F.col("node").alias("s_node"), F.col("n").alias("s_n"), F.col("regs").alias("s_regs"))
    members = members.join(regs_of, F.col("node") == F.col("s_node")).withColumnsRenamed({"s_n": "n", "s_regs": "regs"})
    columns = ["node", "label", "pole", "head_label", "near", "linked", "n", "regs"]
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    right = members.select("key", block.alias("block"), F.lit(True).alias("inside"), *columns)
    left = members.where("label <> head_label").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("inside"), *columns)
    rows = left.unionByName(right).repartition("key", "block").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["key", "block"]):
            inside = g["inside"].astype(bool)
            if inside.all() or not inside.any():
                continue
            all_regs, near = _regs(g["regs"]), g["near"].astype(bool)
            regs, n, node, label, pole = all_regs[inside], g["n"][inside], g["node"][inside], g["label"][inside], g["pole"][inside]
            linked, apart = g["linked"][inside].astype(bool), label != g["head_label"][inside]
            us, vs = [], []
            for i in np.flatnonzero(~inside):
                k, m = g["node"][i], g["n"][i]
                todo = np.flatnonzero((label != g["label"][i]) & (pole != g["pole"][i]) & (~apart | (node > k)) & (near[i] | ~linked) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)))
                if len(todo):
                    other = node[todo[_may_have(0.75, all_regs[i][None, :], regs[todo], np.full(len(todo), m), n[todo])]]
                    us.append(np.minimum(other, k))
                    vs.append(np.maximum(other, k))
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return rows.mapInPandas(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each document row."""
    sketch = stash(sketches(docs, key, text), "sketches")
    firsts = sketch.where("n > 0").groupBy("h1", "h2").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").drop("last")
    copies = stash(known_join(sketch.select("node", "h1", "h2"), stash(firsts, "firsts"), ["h1", "h2"]).where("node <> first").select("node", "first"), "copies")
    keys = known_join(sketch.select("node", "keys"), copies.select("node"), ["node"], "left_anti").select("node", F.explode("keys").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head")
    shared = stash(keys.join(heads, "key"), "buckets")

    near = stash(verify(stash(shared.where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")).distinct(), "pairs"), sketch, True), "near")
    labels = components(near.where("linked").select("u", "v"))
    poles = stash(_poles(near).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "poles")
    of_pole = labels.select(F.col("node").alias("pole"), F.col("label").alias("pole_label"))
    members = poles.join(of_pole, "pole", "left").withColumn("pole_label", F.coalesce("pole_label", "pole"))
    mixed = members.where("label <> pole_label").select("pole").distinct()
    first = stash(_pole_links(stash(members.join(mixed, "pole", "left_semi"), "members"), sketch), "pole_links")

    merged = _merged(labels, first)
    named = shared.join(merged, "node", "left").join(poles.select("node", "pole"), "node", "left").select("key", "node", "head", F.coalesce("label", "node").alias("label"), F.coalesce("pole", "node").alias("pole"))
    named = named.join(near.select(F.col("u").alias("head"), F.col("v").alias("node"), "linked"), ["head", "node"], "left")
    more = stash(verify(stash(_other_pairs(named, sketch), "pairs"), sketch).where("linked").select("u", "v"), "more")
    merged = _merged(merged, more)

    first_of = sketch.select(key, "node", "n").join(copies, "node", "left").withColumn("node", F.coalesce("first", "node"))
    named = stash(first_of.join(merged, "node", "left").select(key, "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label")), "named")
    ids = named.where("label is not null").groupBy("label").agg(F.min(key).alias("component_id"))
    out = named.join(ids, "label", "left").withColumn("component_id", F.coalesce("component_id", key))
    return out.select(key, F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col(key) == F.col("component_id")).alias("kept"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further links, which join whole components, for which their labels stand."""
    name = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    ends = links.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    tops = components(stash(ends.distinct(), "merged")).select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    new = tops.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    return stash(old.union(new), "labels")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id."""
    gone = near_duplicates(docs, key, text).where("not kept").select(key).distinct()
    return docs.join(gone, key, "left_anti").select(docs.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
