"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed once; a span of WINDOW words has WINDOW - GRAM + 1 hashes of GRAM words each, of which the smallest is
its fingerprint. What is smallest follows from the span alone, so a span that a document shares with an item has the same
fingerprint in both: no shared span is missed. Documents' fingerprints are joined with the distinct ones of the items;
hits are extended to their whole windows, which are joined by 128 bits of hash with the distinct windows of the items.
An item of fewer words is one window of its length and its own fingerprint.

Fingerprints and windows of items are distinct before they meet the documents, so a place in a document matches at most
one window of each length, however many items or documents share it. Up to BROADCAST rows they are broadcast; beyond that
the same rows are shuffled and joined by key. Items of a document are worked out once for each distinct set of windows,
so that copies of a passage cost no more than one.

Edge cases: null or empty texts have no words and no hits, on either side. Rows are told apart by id and text: repeated
rows give equal rows, null ids are ids of their own, and an id with two texts gives two results. Null item ids count as an item named by the
empty string. Empty tables give no rows, or no hits. Windows may overlap themselves. Other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words of a window and of a fingerprint.
WINDOW, GRAM = 10, 5
#: Words that windows are cut from at once.
SEGMENT = 512
#: Rows of items' windows or fingerprints (some 24 bytes each) that may be broadcast.
BROADCAST = 1_000_000
#: A-Z, and what stands between words, as a pattern.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words in order; an empty text has none. Of ASCII letters only A-Z have a lower case, so such texts take the faster way."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _by_size(sizes: list[int], of: Callable[[int], Column]) -> Column:
    """of(size) for the row's own size."""
    if len(sizes) == 1:
        return of(sizes[0])
    return functools.reduce(lambda c, s: c.when(F.col("size") == s, of(s)), sizes[1:], F.when(F.col("size") == sizes[0], of(sizes[0])))


def fingerprint(sizes: list[int], window: int, gram: int) -> Column:
    """Of the window of `size` words at `at`: the smallest hash of gram words in a full one, the hash of all words of a shorter one."""

    def of(size: int) -> Column:
        if size < window:
            return F.xxhash64(F.lit(size), *[F.get("h", F.col("at") + i) for i in range(size)])
        grams = [F.xxhash64(F.lit(0), *[F.get("h", F.col("at") + i) for i in range(j, j + gram)]) for j in range(window - gram + 1)]
        return F.least(*grams) if len(grams) > 1 else grams[0]

    return _by_size(sizes, of)


def window_keys(sizes: list[int]) -> dict[str, Column]:
    """128 bits that stand for a window's words: two hashes of their hashes, seeded by size."""
    key = lambda seed: _by_size(sizes, lambda size: F.xxhash64(F.lit(seed + size), *[F.get("h", F.col("at") + i) for i in range(size)]))
    return {"key_a": key(1 << 20), "key_b": key(1 << 21)}


def segments(rows: DataFrame, overlap: int) -> DataFrame:
    """rows (with h) with base and h of each run of SEGMENT words and the `overlap` words after it: a row of windows never carries a whole text's words."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("h") - 1, F.lit(0)) / SEGMENT).cast("int"))
    cut = F.explode(F.transform(starts, lambda s: F.struct((s * SEGMENT).alias("base"), F.slice("h", s * SEGMENT + 1, F.lit(SEGMENT + overlap)).alias("h"))))
    return rows.withColumn("_s", cut).drop("h").select("*", "_s.*").drop("_s")


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item, size, print, key_a, key_b: the distinct windows of each item."""
    h = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), hashed(F.col("text")).alias("h")).withColumn("size", F.least(F.size("h"), F.lit(window)))
    cut = segments(h.where("size > 0"), window - 1)
    placed = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.least(F.lit(SEGMENT - 1), F.size("h") - F.col("size")))))
    # the last segment of an item may hold less than a window, which the one before has seen
    placed = placed.where(F.col("at").between(0, F.size("h") - F.col("size")))
    sizes = list(range(1, window + 1))
    return placed.select("item", "size", fingerprint(sizes, window, gram).alias("print"), *[c.alias(k) for k, c in window_keys(sizes).items()]).distinct()


def occurrences(docs: DataFrame, marks: DataFrame, known: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, n, at, size, copies, set_id: windows of documents that an item holds, and for each document a row of its own with at = -1.

    marks: item_windows; known: their distinct windows with set_id. Equal document rows are one; `copies` says how many
    there are.
    """
    # the window and the lengths of short items: ten at most
    sizes = sorted({window} | {r["size"] for r in marks.select("size").distinct().collect()})
    prints = marks.select("print", F.lit(True).alias("met")).distinct()
    small = known.count() <= BROADCAST
    own = F.col("at") < 0
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), hashed(F.col("text")).alias("h")).withColumn("n", F.size("h"))
    rows = segments(rows, window - 1)
    first, last = F.when(F.col("base") == 0, -1).otherwise(0), F.least(F.lit(SEGMENT - 1), F.size("h") - sizes[0])
    rows = rows.withColumn("at", F.explode(F.sequence(first, F.greatest(last, first))))
    rows = rows.withColumn("size", F.explode(F.array(*map(F.lit, sizes))) if len(sizes) > 1 else F.lit(sizes[0]))
    rows = rows.where((own & (F.col("size") == sizes[0])) | (~own & (F.col("at") + F.col("size") <= F.size("h"))))
    # a document's own row has a key that spreads and that nothing answers to
    rows = rows.withColumn("print", F.when(own, F.col("text_hash")).otherwise(fingerprint(sizes, window, gram)))
    keys = {k: F.when(~own, c) for k, c in window_keys(sizes).items()}
    if small:
        rows = rows.join(F.broadcast(prints), "print", "left").where(own | F.col("met")).withColumns(keys)
    else:
        rows = rows.withColumns(keys).drop("h").join(prints, "print", "left").where(own | F.col("met"))
    rows = rows.withColumn("at", F.when(own, -1).otherwise(F.col("base") + F.col("at")))
    found = rows.groupBy("doc_id", "text_hash", "n", "at", "size", "key_a", "key_b").agg(F.count(F.lit(1)).alias("copies"))
    found = found.withColumn("key_a", F.coalesce("key_a", "text_hash"))
    match = known.withColumnRenamed("size", "known_size").withColumn("met", F.lit(True))
    match = F.broadcast(match) if small else match
    return found.join(match, ["key_a", "key_b"], "left").where(own | (F.col("met") & (F.col("size") == F.col("known_size")))).select("doc_id", "text_hash", "n", "at", "size", "copies", F.when(~own, F.col("set_id")).alias("set_id"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of docs."""
    marks = written(item_windows(items, window, gram), "winnow-items")
    # windows that the same items hold belong together: a passage shared by many items is one set
    sets = written(marks.groupBy("size", "key_a", "key_b").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("set_id", F.md5(F.concat_ws(",", "items").cast("binary"))), "winnow-sets")
    found = occurrences(docs, marks, sets.select("size", "key_a", "key_b", "set_id"), window, gram)
    # a document's own row covers no words
    before = F.max(F.when(F.col("at") >= 0, F.col("at") + F.col("size"))).over(Window.partitionBy("doc_id", "text_hash", "n").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("at") + F.col("size") - F.greatest("at", F.coalesce(before, F.lit(0))))
    per_doc = found.withColumn("fresh", F.when(F.col("at") >= 0, fresh).otherwise(0)).groupBy("doc_id", "text_hash", "n").agg(
        F.sum("fresh").alias("n_hit"), F.max(F.when(F.col("at") < 0, F.col("copies"))).alias("copies"), F.sort_array(F.collect_set("set_id")).alias("set_ids"))
    # documents without hits get a key of their own, so that they spread
    combo = F.when(F.size("set_ids") > 0, F.md5(F.concat_ws(",", "set_ids").cast("binary"))).otherwise(F.concat(F.lit("-"), F.col("text_hash").cast("string")))
    per_doc = written(per_doc.withColumn("combo", combo), "winnow-docs")
    combos = per_doc.where(F.size("set_ids") > 0).groupBy("combo").agg(F.first("set_ids").alias("set_ids"))
    listed = combos.select("combo", F.explode("set_ids").alias("set_id")).join(sets.groupBy("set_id").agg(F.first("items").alias("items")), "set_id")
    listed = listed.select("combo", F.explode("items").alias("item")).groupBy("combo").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = listed.select("combo", F.size("items").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"))
    out = per_doc.join(listed, "combo", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
