"""Merkle manifest of a dataset: trees of fan-out 16 by slot pivots, with a proof for each row.

A row is a leaf, a group (``source``) a subtree, and the subtrees' roots are the
leaves of the tree on top. A level is made by a *slot pivot*: conditional
aggregates spread the up to 16 children of a parent into 16 columns. Those
columns, concatenated, are what the parent hashes; without the own slot's column
they are a child's siblings. So all that is ever grouped are 16 rows, however
large a source is, and a proof is put together from parents, of which there are
a 16th of the rows.

Digests are lower-case hex text of SHA-256.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, UPPER, ascii_lower, place, stash, table

FANOUT = 16
#: The columns of documents in the order in which a leaf hashes them.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: What a level of a proof is: the siblings before and after the own node, concatenated.
STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(col: Column) -> Column:
    """A value as a leaf holds it: ``-`` for NULL, else its bytes' number, a colon, and the value itself."""
    text = col.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(*map(field, fields))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (array of STEP) lead to."""
    return F.aggregate(proof, leaf, lambda own, step: digest(step["left"], own, step["right"]))


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings of a proof, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _joined(columns: list[str]) -> str:
    return f"concat_ws({', '.join([repr(''), *columns])})"


#: The slots' columns, and of each slot what a parent's columns hold before and after it; SQL, since hundreds of Column calls take seconds.
SLOTS = [f"s{k}" for k in range(FANOUT)]
SIBLINGS = "array(" + ", ".join(f"named_struct('left', {_joined(SLOTS[:k])}, 'right', {_joined(SLOTS[k + 1 :])})" for k in range(FANOUT)) + ")"


def _children(**names: str) -> Column:
    """The children of a parent as rows (slot, names), of the columns with the prefixes given."""
    each = ", ".join(f"named_struct('slot', {k}, {', '.join(f"'{name}', {p}{k}" for name, p in names.items())})" for k in range(FANOUT))
    return F.expr(f"inline(filter(array({each}), x -> x.{next(iter(names))} is not null))")


def _pivot(nodes: DataFrame, extra: dict[str, str]) -> DataFrame:
    """(tree, pos, n, s0.., extra slots, node): parents of ``nodes`` (tree, pos, n, node), with each child in its slot's column.

    n is the number of nodes of the children's level; a level of one node is its own parent.
    """
    columns = {"node": "s"} | extra
    spread = [F.expr(f"max(CASE WHEN pos % {FANOUT} = {k} THEN {c} END) AS {p}{k}") for c, p in columns.items() for k in range(FANOUT)]
    made = nodes.groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(F.max("n").alias("n"), *spread)
    return made.withColumn("node", F.expr(f"CASE WHEN n = 1 THEN s0 ELSE sha2({_joined(SLOTS)}, 256) END"))


def _own_step(slot: Column) -> Column:
    """The step from a slot's node to its parent: none where a level has one node."""
    none = F.array().cast(STEP)
    return F.when(F.col("n") == 1, none).otherwise(F.array(F.get("siblings", slot)))


@dataclass
class Forest:
    """levels: the parents of each level, the leaves' first; tops: (tree, root) of each tree."""

    levels: list[DataFrame]
    tops: DataFrame


def grow(leaves: DataFrame, extra: dict[str, str] | None = None) -> Forest:
    """The trees over ``leaves`` (tree, pos, n, node); columns of ``extra`` are spread into the lowest level's slots too."""
    nodes, levels, tops = leaves, [], []
    while True:
        level = stash(_pivot(nodes, (extra or {}) if not levels else {}), "merkle-level")
        levels.append(level)
        tops.append(level.where(F.col("n") <= FANOUT).select("tree", F.col("node").alias("root")))
        nodes = level.where(F.col("n") > FANOUT).select("tree", "pos", F.ceil(F.col("n") / FANOUT).alias("n"), "node")
        if nodes.isEmpty():
            break
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return Forest(levels, found)


def _descend(forest: Forest, above: DataFrame) -> DataFrame:
    """The lowest level's parents with ``proof``: their own steps up to what ``above`` (tree, proof, ...) holds of each tree."""
    told = [c for c in above.columns if c not in ("tree", "proof")]
    paths = None
    for level in reversed(forest.levels):
        own = level.where(F.col("n") <= FANOUT).select("tree", "pos").join(above, "tree").select("tree", "pos", "proof", *told)
        paths = own if paths is None else own.unionByName(paths)
        joined = level.join(paths, ["tree", "pos"])
        if level is forest.levels[0]:
            return joined
        each = joined.select("tree", "pos", "n", F.expr(SIBLINGS).alias("siblings"), "proof", *told, _children(node="s"))
        paths = each.select("tree", (F.col("pos") * FANOUT + F.col("slot")).alias("pos"), F.concat(_own_step(F.col("slot")), F.col("proof")).alias("proof"), *told)
    raise ValueError("a forest without levels")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: list[str] | None = None, changed: Column | None = None) -> DataFrame:
    """(key, group, leaf, proof, subroot, root, changed_leaf) of every row of ``docs``.

    Leaves hash ``fields`` in their order; rows of a group ascend by key, then
    by leaf, so that repeated keys have a defined order and repeated rows differ
    only in their proofs. ``proof`` is an array of (left, right), the siblings
    of each level up to the root; ``fold`` leads from a leaf to the root.
    ``changed_leaf`` is ``changed``, another leaf digest, if given: it is kept
    apart from the trees. NULL keys come first; a NULL group is a group and comes
    first. NULL and empty fields differ. No rows have no root and no result.
    Other columns of ``docs`` are not looked at, whatever their names.
    """
    fields = fields or FIELDS
    kind = docs.schema[key].dataType
    leaf = leaf_digest([F.col(f"`{c}`") for c in fields])
    rows = docs.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{key}`").alias("key"), leaf.alias("node"), (changed if changed is not None else F.lit(None).cast("string")).alias("changed"))
    placed = place(stash(rows, "leaves"), ["grp"], ["key", "node"], "pos", "n")
    groups = place(placed.groupBy("grp").agg(F.first("n").alias("n")), [], ["grp"], "tree", "trees")
    groups = stash(groups, "groups")
    few = groups.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    names = groups.select(F.col("grp").alias("of"), "tree")
    known = placed.join(F.broadcast(names) if few else names, F.col("grp").eqNullSafe(F.col("of"))).select("tree", "pos", "n", "node", "key", "changed")
    below = grow(known, {"key": "k", "changed": "c"})
    roots = below.tops.join(groups.select("tree", "grp", "trees"), "tree").select("grp", F.col("tree").alias("pos"), F.lit(0).alias("tree"), F.col("trees").alias("n"), F.col("root").alias("node"))
    if roots.isEmpty():
        return docs.sparkSession.createDataFrame([], f"`{key}` {kind.simpleString()}, `{group}` {docs.schema[group].dataType.simpleString()}, leaf string, proof {STEP}, subroot string, root string, changed_leaf string")
    top = grow(roots, {"pos": "t", "grp": "g"})
    root = top.tops.first()["root"]  # one digest
    over = _descend(top, top.tops.select("tree", F.array().cast(STEP).alias("proof")))
    over = over.withColumn("siblings", F.expr(SIBLINGS)).select("n", "siblings", "proof", _children(subroot="s", of="t", grp="g"))
    above = stash(over.select(F.col("of").alias("tree"), "grp", "subroot", F.concat(_own_step(F.col("slot")), F.col("proof")).alias("proof")), "above")
    under = _descend(below, above).withColumn("siblings", F.expr(SIBLINGS))
    rows = under.select("n", "siblings", "proof", "grp", "subroot", _children(leaf="s", key="k", changed_leaf="c"))
    return rows.select(F.col("key").alias(key), F.col("grp").alias(group), "leaf", F.concat(_own_step(F.col("slot")), F.col("proof")).alias("proof"), "subroot", F.lit(root).alias("root"), "changed_leaf")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = leaf_digest([F.col(c) if c != "text" else ascii_lower(F.col(c)) for c in FIELDS])
    picked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = manifest(docs, changed=F.when(picked, tampered))
    folded = found.withColumn("folded_root", fold(F.coalesce("changed_leaf", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, 3988292384::BIGINT * (d & 1))))"
    up = f"list_transform(range(0, (len(nodes) + {FANOUT - 1}) // {FANOUT}), lambda i: sha256(array_to_string(nodes[i * {FANOUT} + 1 : i * {FANOUT} + {FANOUT}], '')))"

    def tree(name: str) -> str:
        """Levels of a tree as lists of nodes; a node's run is a slice of its level's list."""
        return f"{name} AS (SELECT src, 0 AS level, nodes FROM {name}_0 UNION ALL SELECT src, level + 1, {up} FROM {name} WHERE len(nodes) > 1)"

    before = lambda at: f"array_to_string(l.nodes[({at} >> (4 * l.level)) // {FANOUT} * {FANOUT} + 1 : {at} >> (4 * l.level)], '')"
    after = lambda at: f"array_to_string(l.nodes[({at} >> (4 * l.level)) + 2 : ({at} >> (4 * l.level)) // {FANOUT} * {FANOUT} + {FANOUT}], '')"
    return f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('+' || source, '') AS src, {leaf('text')} AS leaf,
         CASE WHEN xor(4294967295::BIGINT, {crc}) % 5 = 0 THEN {leaf(lower)} END AS bad FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
trees_0 AS (SELECT src, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY src),
{tree('trees')},
subroots AS (SELECT src, nodes[1] AS subroot, row_number() OVER (ORDER BY src) - 1 AS pos FROM trees WHERE len(nodes) = 1),
tops_0 AS (SELECT '' AS src, list(subroot ORDER BY pos) AS nodes FROM subroots),
{tree('tops')},
steps AS (
  SELECT p.src, p.pos, l.level, {before('p.pos')} AS a, {after('p.pos')} AS b FROM placed p JOIN trees l ON l.src = p.src AND len(l.nodes) > 1
  UNION ALL
  SELECT p.src, p.pos, 1000 + l.level, {before('s.pos')}, {after('s.pos')} FROM placed p JOIN subroots s ON s.src = p.src JOIN tops l ON len(l.nodes) > 1),
proofs AS (SELECT src, pos, string_agg(a || b, '' ORDER BY level) AS siblings, list({{'a': a, 'b': b}} ORDER BY level) AS path FROM steps GROUP BY src, pos),
folds AS (
  SELECT p.src, p.pos, 0 AS k, coalesce(p.bad, p.leaf) AS node, coalesce(f.path, []) AS path FROM placed p LEFT JOIN proofs f ON f.src = p.src AND f.pos = p.pos
  UNION ALL
  SELECT src, pos, k + 1, sha256(path[k + 1].a || node || path[k + 1].b), path FROM folds WHERE k < len(path)),
folded AS (SELECT src, pos, node FROM folds WHERE k = len(path)),
root AS (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1)
SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(coalesce(f.siblings, '')) AS proof_sha256, d.node AS folded_root, d.node = t.root AS verified
FROM placed p JOIN subroots s ON s.src = p.src JOIN folded d ON d.src = p.src AND d.pos = p.pos LEFT JOIN proofs f ON f.src = p.src AND f.pos = p.pos CROSS JOIN root t"""


#: The same trees as lists of nodes, level by level.
OP11_SQL = _sql()
