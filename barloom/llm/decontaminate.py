"""Benchmark decontamination: broadcast hash set of normalised test n-grams (DataFrame functions only).

Every window of ``n`` consecutive words of a benchmark item (an item with fewer
words is one window) is hashed. Document windows are hashed in place, from the
hashes of runs of 1, 2, 4, ... words that all window sizes share, matched against
that set, and each hit is verified word by word. What remains is spans
of hit words, from which documents are judged, cut or dropped.

The set is broadcast only while it has at most ``MAX_BROADCAST`` windows, which
is counted first; beyond that the same join runs as a shuffled hash join, whose
other side holds document windows only, as hashes; the few hits then meet their
documents again to be verified.

Defined cases: NULL and empty texts have no words, are never contaminated and
are kept; NULL or wordless items match nothing; repeated document rows are
judged apart and all returned; rows of a NULL doc_id are judged like all others; other
columns pass through ``clean`` and ``cut_spans``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, table

N = 13
MAX_BROADCAST = 2_000_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
RAW_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), RAW_BREAKS), "")


def _hashed(words: DataFrame, raw: str, n: int) -> DataFrame:
    """``words`` with run0, run1, ...: the hashes of the runs of 1, 2, 4, ... lower-cased words, up to n, that begin at each word.

    Two runs make the next one, so a word is read once. Runs that go beyond the end are there too, and mean nothing.
    """
    out = words.withColumn("run0", F.transform(raw, lambda w: F.xxhash64(F.lower(w))))
    for k in range(1, n.bit_length()):
        out = out.withColumn(f"run{k}", _joined(k - 1, 1 << (k - 1)))
    return out


def _joined(k: int, by: int) -> Column:
    """The hashes of the runs of run``k`` together with those ``by`` words later."""
    later = F.slice(f"run{k}", F.lit(by + 1), F.size("run0"))
    return F.zip_with(f"run{k}", later, lambda a, b: F.xxhash64(a, b))


def _windows(size: int) -> Column:
    """The hashes of windows of ``size`` words from each word on: two runs that may overlap."""
    k = size.bit_length() - 1
    return F.col(f"run{k}") if size == 1 << k else _joined(k, size - (1 << k))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item_id, size, hash, window): the distinct windows of each item; window is its words joined by a space."""
    words = benchmark.select("item_id", raw_words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    words = _hashed(words.withColumn("size", F.least(F.size("w"), F.lit(n))), "w", n)
    hashes = F.coalesce(*(F.when(F.col("size") == s, _windows(s)) for s in range(1, n + 1)))
    at = words.select("item_id", "w", "size", F.posexplode(F.slice(hashes, F.lit(1), F.size("w") - F.col("size") + 1)).alias("at", "hash"))
    return at.select("item_id", "size", "hash", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("window")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, key: list[str], n: int = N, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(key..., n_words, at, size, item_id) of every verified window occurrence; one row with at = 0 for each document row.

    Candidates are hashed over fully lower-cased words (a superset of those
    equal after A-Z alone), so that whole texts need no second rewriting; the
    few hits are compared as the contract says.
    """
    grams = benchmark_windows(benchmark, n)
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most n numbers
    small = grams.limit(max_broadcast + 1).count() <= max_broadcast
    grams = grams.withColumnsRenamed({"size": "g_size", "hash": "g_hash"})
    grams = F.broadcast(grams) if small else grams.hint("shuffle_hash")

    words = docs.select(*key, raw_words(F.col("text")).alias("raw"))
    hashed = _hashed(words, "raw", max(sizes, default=1)).withColumn("count", F.size("raw"))
    # a hash for each size and word; the first place is that of the row itself
    every = F.concat(F.array(F.lit(None).cast("long")), *map(_windows, sizes))
    number = F.col("pos") - 1
    size = F.get(F.array(*map(F.lit, sizes)), F.floor(number / F.col("count")).cast("int")) if sizes else F.lit(0)
    placed = {"at": F.when(F.col("pos") == 0, 0).otherwise(number % F.col("count") + 1).cast("int"), "size": F.when(F.col("pos") == 0, 0).otherwise(size).cast("int")}
    inside = F.col("at") + F.col("size") <= F.col("count") + 1
    lowered = lambda c: F.array_join(F.transform(F.slice("raw", F.col("at"), F.col("size")), ascii_lower), " ") == F.col(c)
    if small:
        each = hashed.select(*key, "count", "raw", F.posexplode(every).alias("pos", "hash"))
        found = each.join(grams, F.col("hash") == F.col("g_hash"), "left").where("pos = 0 or item_id is not null").withColumns(placed)
        same = inside & (F.col("size") == F.col("g_size"))
        return found.where((F.col("pos") == 0) | F.when((F.col("pos") > 0) & same, lowered("window"))).select(*key, F.col("count").cast("long").alias("n_words"), "at", "size", "item_id")
    each = hashed.select(*key, "count", F.posexplode(every).alias("pos", "hash")).where("pos > 0").withColumns(placed).where(inside).select(*key, "at", "size", "hash")
    found = each.join(grams, (F.col("size") == F.col("g_size")) & (F.col("hash") == F.col("g_hash"))).select(*(F.col(k).alias(f"of_{k}") for k in key), "at", "size", "item_id", "window").distinct()
    sized = words.select(*key, F.size("raw").cast("long").alias("n_words"), "raw")
    of = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]
    verified = sized.dropDuplicates(key).join(found, of).where(lowered("window")).select(*key, "n_words", "at", "size", "item_id")
    return sized.select(*key, "n_words", F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id")).union(verified)


def spans(found: DataFrame, key: list[str]) -> DataFrame:
    """(key..., n_words, copies, n_hit, items, hit): hit is the sorted array of the hit word numbers, from 0."""
    hit = F.flatten(F.collect_set(F.when(F.col("at") > 0, F.sequence(F.col("at") - 1, F.col("at") + F.col("size") - 2))))
    return found.groupBy(*key, "n_words").agg(
        F.count_if(F.col("at") == 0).alias("copies"),
        F.array_sort(F.array_distinct(hit)).alias("hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )


def judge(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = 20) -> DataFrame:
    """The contract's columns: a document is contaminated if any word is hit and at least 1 / ``share`` of its words are.

    Rows of the same doc_id and text are alike and counted, so all come back.
    """
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    s = spans(hits(marked, benchmark, ["doc_id", "text_key"], n), ["doc_id", "text_key"])
    n_hit = F.size("hit").cast("long")
    out = s.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "hit", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out


def _with_judged(docs: DataFrame, judged: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with rows (doc_id, text_key, ...) of ``judged`` by id, NULL included, and text."""
    found = judged.select(F.col("doc_id").alias("judged_id"), F.col("text_key").alias("judged_key"), *(c for c in judged.columns if c not in ("doc_id", "text_key")))
    found = found.withColumnsRenamed({c: free_name(c, docs) for c in found.columns})
    of_id, of_key = (found[free_name(c, docs)] for c in ("judged_id", "judged_key"))
    return docs.join(found, docs["doc_id"].eqNullSafe(of_id) & (F.xxhash64(docs["text"]) == of_key), how)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay."""
    bad = judge(docs, benchmark, n, share).where("contaminated").select("doc_id", "text_key").distinct()
    return _with_judged(docs, bad, "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with the hit words taken out; texts with hits become their remaining lower-cased words joined by a space."""
    found = judge(docs, benchmark, n).where("n_hit > 0").select("doc_id", "text_key", "hit").dropDuplicates(["doc_id", "text_key"])
    hit = F.col(free_name("hit", docs))
    kept = F.array_except(F.sequence(F.lit(1), F.size(raw_words(F.col("text")))), F.transform(hit, lambda i: i + 1))
    left = F.array_join(F.transform(kept, lambda i: F.get(raw_words(ascii_lower(F.col("text"))), i - 1)), " ")
    return _with_judged(docs, found, "left").withColumn("text", F.when(hit.isNull(), F.col("text")).otherwise(left)).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "benchmark")).drop("text_key", "hit", "copy")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM g),
x AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, s WHERE len(w) >= size)),
h AS (SELECT doc_id, p, x.size, item_id FROM x JOIN g ON x.g = g.g AND x.size = g.size),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
