"""Prefix trie of conversations: nodes by prefix digests, subtree sums over minimal-perfect-hash tables.

Each turn of a conversation has a digest of its role and text, salted by its
depth; the xor of the first d of them is the digest of a prefix, so that prefixes
of a conversation of any length come from block sums. Equal prefixes are one node.

What needs a node's subtree is summed as follows. A node with a single member
is known at once. Of the others, those whose members have over ``HEAVY`` turns
from here on are *heavy*; the trees below heavy nodes are small and are dealt to
shards. A shard's digests get a minimal perfect hash: one slot each, found by
hash and displace, and verified by the digest that the slot holds. Counts are
scattered into flat arrays by slot, and levels are added to their parents' slots,
the deepest first. Heavy nodes are few and add up what hangs on them by
doubling the distance to the ancestor, in joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, place, stash, table

#: Turns of members, from a node on, beyond which the node is heavy; a shard has about so many nodes.
HEAVY = 4_096
#: Turns of a conversation whose digests one window sums up.
BLOCK = 1_024
#: Ids that are joined to one text before they are hashed; at most so many, as they share their id div CHUNK.
CHUNK = 256
WORDS = r"[^\x20\x09-\x0D]+"


def shared_turns(conv: Column) -> Column:
    """The turns that a conversation takes from the first one of its twenty."""
    return F.crc32(conv.cast("string")) % 4


def turn_digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, length, depth, turn, words) of the turns of rebuilt conversations, and a row of depth 0 for each of them.

    ``turn`` is a digest of role and text. Turns of equal number are in the
    order of their digests; rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("number"), turn_digest(role, text).alias("turn"), F.regexp_count(text, F.lit(WORDS)).alias("words"))
    placed = stash(place(stash(rows, "turns"), ["conv"], ["number", "turn"], "pos", "n"), "placed")
    sizes = placed.groupBy("conv").agg(F.max("n").alias("n"))
    heads = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    asked = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % 20).alias("base"), shared_turns(F.col("conv")).alias("h"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = stash(asked.join(heads, "base", "left").withColumn("taken", taken).select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "plan")
    own = placed.join(plan, "conv").where("pos >= h").select("conv", "length", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "turn", "words")
    first = placed.where("pos < 3 and conv % 20 = 0").select(F.col("conv").alias("base"), "pos", "turn", "words")
    lent = plan.join(first, "base").where("pos < taken").select("conv", "length", (F.col("pos") + 1).alias("depth"), "turn", "words")
    roots = plan.select("conv", "length", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("turn"), F.lit(0).alias("words"))
    return own.unionByName(lent).unionByName(roots)


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` of ``rebuilt`` with (a, b), the digest of the prefix that ends there, and (up_a, up_b), that of the prefix before; NULL for depth 0."""
    salted = lambda k: F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "turn")).otherwise(F.lit(0).cast("long"))
    rows = turns.withColumns({"x": salted(1), "y": salted(2), "block": F.floor(F.col("depth") / BLOCK)})
    inner = Window.partitionBy("conv", "block").orderBy("depth")
    blocks = rows.groupBy("conv", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    blocks = blocks.select("conv", "block", *(F.coalesce(F.bit_xor(c).over(earlier), none).alias(c) for c in ("bx", "by")))
    found = rows.withColumns({"px": F.bit_xor("x").over(inner), "py": F.bit_xor("y").over(inner)}).join(blocks, ["conv", "block"])
    found = found.withColumns({"a": F.col("px").bitwiseXOR(F.col("bx")), "b": F.col("py").bitwiseXOR(F.col("by"))})
    up = lambda c, own: F.when(F.col("depth") > 0, F.col(c).bitwiseXOR(F.col(own)))
    return found.select("conv", "length", "depth", "words", "a", "b", up("a", "x").alias("up_a"), up("b", "y").alias("up_b"))


# -- one shard ------------------------------------------------------------------
def _mixed(a: np.ndarray, b: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """64 mixed bits of each digest (a, b) under a seed."""
    with np.errstate(over="ignore"):
        h = a ^ (np.asarray(seed, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + b
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


class SlotTable:
    """A minimal perfect hash of n different digests: each has its own slot of n, and a slot tells its digest.

    Digests are dealt to buckets. Buckets of several, the largest first, try
    seeds until all of theirs land on free slots; a bucket of one just names a
    slot that is left. The seed or slot of each bucket is the whole table.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.salt = a.astype(np.uint64), b.astype(np.uint64), 0
        while not self._build():
            self.salt += 1
        slot = self._slots(self.a, self.b)
        keys = np.empty((len(slot), 2), np.uint64)
        keys[slot, 0], keys[slot, 1] = self.a, self.b
        self.keys, self.slot = keys, slot

    def _bucket(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (_mixed(a, b, (1 << 40) + self.salt) % np.uint64(len(self.told))).astype(np.int64)

    def _build(self, tries: int = 1 << 14, at_once: int = 32) -> bool:
        n = len(self.a)
        self.told, self.single = np.zeros(max(1, n // 2), np.int64), np.zeros(max(1, n // 2), bool)
        bucket = self._bucket(self.a, self.b)
        order = np.argsort(bucket, kind="stable")
        names, first, sizes = np.unique(bucket[order], return_index=True, return_counts=True)
        free = np.ones(n, bool)
        for k in np.argsort(-sizes, kind="stable"):
            if sizes[k] == 1:
                break
            own = order[first[k] : first[k] + sizes[k]]
            for seed in range(0, tries, at_once):
                seeds = np.arange(seed, seed + at_once, dtype=np.uint64)
                at = (_mixed(self.a[own][None], self.b[own][None], seeds[:, None]) % np.uint64(n)).astype(np.int64)
                there = np.sort(at, axis=1)
                good = free[at].all(axis=1) & (np.diff(there, axis=1) > 0).all(axis=1)
                if good.any():
                    i = int(good.argmax())
                    self.told[names[k]], free[at[i]] = seed + i, False
                    break
            else:
                return False
        alone = names[sizes == 1]
        self.told[alone], self.single[alone] = np.flatnonzero(free), True
        return True

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bucket = self._bucket(a, b)
        told = self.told[bucket]
        return np.where(self.single[bucket], told, (_mixed(a, b, told.astype(np.uint64)) % np.uint64(len(self.a))).astype(np.int64))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that the table doesn't hold."""
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        slot = self._slots(a, b)
        return np.where((self.keys[slot, 0] == a) & (self.keys[slot, 1] == b), slot, -1)


def add_up(nodes: pd.DataFrame, sums: list[str]) -> pd.DataFrame:
    """``nodes`` (a, b, up_a, up_b, depth, sums) with each sum over the node's subtree, as far as it is in ``nodes``."""
    slots = SlotTable(nodes["a"].to_numpy(), nodes["b"].to_numpy())
    at = slots.slot
    up, depth = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    depth[at] = nodes["depth"].to_numpy()
    up[at] = np.where(nodes["depth"] > 0, slots.find(nodes["up_a"].to_numpy(), nodes["up_b"].to_numpy()), -1)
    flat = np.empty((len(at), len(sums)), np.int64)
    flat[at] = nodes[sums].to_numpy()
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[up[level] >= 0]
        np.add.at(flat, up[level], flat[level])
    return nodes.assign(**{s: flat[at, i] for i, s in enumerate(sums)})


# -- all shards -----------------------------------------------------------------
SUMS = ["leaves", "saved"]
ID = ["a", "b"]


def _double(heavy: DataFrame) -> DataFrame:
    """(a, b, sums) over the subtrees of heavy nodes (a, b, up_a, up_b, sums), all of whose ancestors are heavy.

    After k rounds a sum covers what is less than 2^k below, and (up_a, up_b) is the ancestor 2^k above.
    """
    now = stash(heavy, "heavy")
    while not now.where("up_a is not null").isEmpty():
        below = now.where("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(*(F.sum(s).alias(f"{s}_below") for s in SUMS))
        above = now.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("next_a"), F.col("up_b").alias("next_b"))
        both = now.join(below, ID, "left").join(above, ["up_a", "up_b"], "left")
        now = stash(both.select("a", "b", F.col("next_a").alias("up_a"), F.col("next_b").alias("up_b"), *((F.col(s) + F.coalesce(F.col(f"{s}_below"), F.lit(0))).alias(s) for s in SUMS)), "heavy")
    return now.select(*ID, *SUMS)


def subtree_sums(nodes: DataFrame, members: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(a, b, leaves, saved) of nodes with several members, and of the root: both summed over the subtree.

    nodes: (a, b, up_a, up_b, depth, conv, n_convs, turns_below, leaves, saved) with what each gives by itself;
    members: (conv, depth, a, b), the nodes of each conversation.
    """
    core = nodes.where("n_convs > 1 or depth = 0")
    large = stash(core.where(F.col("turns_below") > heavy).select("a", "b", "up_a", "up_b", *SUMS), "large")
    known = large.select("a", "b")
    few = known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    # of each conversation the first node that isn't heavy: the top of a shard's tree
    tops = members.join(F.broadcast(known) if few else known, ID, "left_anti").groupBy("conv").agg(F.min_by(F.struct("a", "b"), "depth").alias("top"))
    small = core.where(F.col("turns_below") <= heavy).join(tops, "conv")
    shards = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-small.count() // heavy))
    up = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("up_a", "up_b")]  # NULL in the root alone
    dealt = small.select("a", "b", *up, "depth", *SUMS, (F.col("top") == F.struct("a", "b")).alias("is_top"), F.pmod(F.xxhash64("top"), F.lit(shards)).alias("shard"))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        return add_up(shard, SUMS)[["a", "b", "up_a", "up_b", "is_top", *SUMS]]

    done = stash(dealt.groupBy("shard").applyInPandas(run, "a long, b long, up_a long, up_b long, is_top boolean, leaves long, saved long"), "shards")
    hung = done.where("is_top").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(*(F.sum(s).alias(f"{s}_hung") for s in SUMS))
    start = large.join(hung, ID, "left").select("a", "b", "up_a", "up_b", *((F.col(s) + F.coalesce(F.col(f"{s}_hung"), F.lit(0))).alias(s) for s in SUMS))
    return done.select(*ID, *SUMS).unionByName(_double(start))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): of each node of ``ends`` (conv, a, b) the digest of its convs' decimals, ascending, joined by commas.

    Ids are joined in chunks of a bounded number first; a node's chunks stream through one hash.
    """
    chunks = ends.groupBy("a", "b", F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, hashed = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(batch["a"], batch["b"], batch["text"], strict=True):
                if (a, b) == node:
                    hashed.update(f",{text}".encode())
                    continue
                if node is not None:
                    out.append((*node, hashed.hexdigest()))
                node, hashed = (a, b), hashlib.sha256(text.encode())
            yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, hashed.hexdigest())], columns=["a", "b", "ends_sha256"])

    return chunks.repartition("a", "b").sortWithinPartitions("a", "b", "chunk").mapInPandas(run, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest) of every distinct prefix.

    ``conversations`` has conv_id, turn, role and text; other columns are not
    looked at. NULL roles and texts are empty, a NULL turn comes first, repeated
    rows are turns of their own, rows without conv_id are left out, and without
    conversations there is no root. ``digest`` is the prefix's, in hex.
    """
    members = stash(prefixes(rebuilt(conversations)), "members")
    made = members.groupBy("a", "b").agg(
        F.min("depth").alias("depth"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.max("words").alias("words"), F.count("*").alias("n_convs"), F.min("conv").alias("conv"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("turns_below"), F.count_if(F.col("length") == F.col("depth")).alias("n_ends"),
    )
    made = stash(made, "nodes")
    kids = made.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    nodes = made.join(kids, ID, "left").fillna(0, ["n_children", "alone"])
    # a child of one member has one leaf and saves nothing: it is counted here and is no part of the sums below it
    nodes = nodes.withColumns({"leaves": F.col("alone") + (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    nodes = stash(nodes, "nodes")
    sums = subtree_sums(nodes, members.select("conv", "depth", "a", "b"), heavy)
    above = made.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("parent"))
    ended = ends_digest(members.where("length = depth").select("conv", "a", "b"))
    out = nodes.select("a", "b", "up_a", "up_b", "conv", "depth", "n_convs", "n_children").join(sums, ID, "left").join(ended, ID, "left").join(above, ["up_a", "up_b"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), F.lower(F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0"))).alias("digest"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("digest")


#: Prefixes as lists of digests, and each node joined with all its ancestors.
OP13_SQL = r"""WITH o AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS turns FROM o GROUP BY conv_id),
c AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS base,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, 3988292384::BIGINT * (d & 1))))) % 4 AS h FROM own),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) AS turns FROM c LEFT JOIN own b ON b.conv_id = c.base),
m AS (
  SELECT conv_id, d, sha256(array_to_string(list_transform(turns[1:d], lambda x: x.k), '')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[1:d - 1], lambda x: x.k), '')) END AS up,
         CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w, d = len(turns) AS done FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (
  SELECT node, max(d) AS depth, max(up) AS up, max(w) AS w, count(*) AS n_convs, min(conv_id) AS conv_id, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE done), '')) AS ends_sha256 FROM m GROUP BY node),
k AS (SELECT up, count(*) AS n_children FROM n GROUP BY up),
pairs AS (SELECT DISTINCT m.node, a.node AS above FROM m JOIN m a ON a.conv_id = m.conv_id AND a.d <= m.d),
t AS (
  SELECT above AS node, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.w)::BIGINT AS saved_tokens
  FROM pairs JOIN n USING (node) LEFT JOIN k ON k.up = n.node GROUP BY above)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM n JOIN t ON t.node = n.node LEFT JOIN n p ON p.node = n.up LEFT JOIN k ON k.up = n.node"""
