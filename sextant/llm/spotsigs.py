"""Document fingerprints: SpotSigs.

A signature is a chain of CHAIN content words that follows a common word (an anchor); further common words inside the
chain are passed over. A document's fingerprint is its set of signatures, as sorted 32-bit hashes. Two fingerprints are
likened by Jaccard. `similar_pairs` partitions fingerprints by set length, so that only sets whose lengths can reach the
threshold meet, and prunes by length and by what is left to share before it counts.

Only DataFrame functions. Edge cases: a null text counts as empty; a text without chains is its own single signature, so
equal texts have equal fingerprints; the empty text's fingerprint is empty, and two empty ones have likeness 1; an empty
table gives an empty result; repeated rows each get a row (ties of an id: by text); other columns are ignored. Texts of
any length are read whole.

The registered query stops at fingerprints and the likenesses that its contract names; pairs are another call.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that it was for on are as with he be at by this have from or an which you not "
    "der die und den das von mit sich des auf ist im dem nicht ein eine als auch es zu "
    "le la les de et un une du que est pour dans il au pas sur en qui "
    "el los las y por con para una su del se lo como al"
).split()
CHAIN = 2
#: Letters and digits of any script; all else separates.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = "\u0001"


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit hashes (as longs) of the chains after anchors."""
    whole = F.coalesce(text, F.lit(""))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(whole), SEPARATORS, " ")), F.lit(" "))
    words = "|".join(sorted(set(anchors), key=lambda w: (-len(w), w)))
    # each anchor becomes a mark at the end of the content word before it: ' w1^^ w2 w3^ '
    marked = F.regexp_replace(norm, rf" (?:{words})(?= )", _MARK)
    after = rf"{_MARK}(?= ({' '.join([f'[^ {_MARK}]+{_MARK}*'] * (chain - 1) + [f'[^ {_MARK}]+'])}))"
    chains = F.regexp_extract_all(marked, F.lit(after), F.lit(1))
    low = F.lit(0xFFFFFFFF).cast("long")
    hashed = F.transform(chains, lambda c: F.xxhash64(F.replace(c, F.lit(_MARK), F.lit(""))).bitwiseAND(low))
    alone = F.when(whole == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(whole).bitwiseAND(low)))
    return F.when(F.size(chains) > 0, F.sort_array(F.array_distinct(hashed))).otherwise(alone)


def as_text(sigs: Column) -> Column:
    """The fingerprint as text: eight hex digits for each signature, ascending."""
    return F.lower(F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def similar_pairs(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pairs of distinct fingerprints with Jaccard >= threshold: rep_a < rep_b, likeness (see `classes` for members).

    Sets are partitioned by length: bucket b holds lengths in [g^b, g^(b+1)) with g = 1/threshold, so partners lie in
    the same bucket or the next. Within, sets meet through their rarest |S| - ceil(t|S|) + 1 signatures; a hot one among
    them is rare by construction (order: document frequency, then hash). Pairs are pruned by length and by the part of
    each set after the shared signature before the intersection is counted.
    """
    reps = classes(docs, text, key).groupBy("fingerprint").agg(F.min("rep").alias("rep"), F.first("sigs").alias("sigs"))
    reps = written(reps.where(F.size("sigs") > 0).select("rep", "sigs", F.size("sigs").alias("n")), "spotsigs-sets")
    each = reps.select("rep", "n", F.explode("sigs").alias("sig"))
    df = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("rep").orderBy("df", "sig")
    ranked = each.join(df, "sig").withColumn("at", F.row_number().over(w) - 1)
    keep = F.col("n") - F.ceil(F.round(F.lit(threshold) * F.col("n"), 9)) + 1
    prefix = ranked.where((F.col("at") < keep) & (F.col("df") > 1))
    bucket = F.floor(F.log("n") / F.lit(-math.log(threshold)) + 1e-9)
    left = prefix.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), "sig", bucket.alias("bucket"))
    right = prefix.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), "sig", F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    need = F.ceil(F.round(threshold / (1 + threshold) * (F.col("na") + F.col("nb")), 9))
    met = left.join(right, ["sig", "bucket"]).where(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("na") >= threshold * F.col("nb") - 1e-9)
        & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb") >= need))
    pairs = met.select("a", "b").distinct()
    sa, sb = reps.select(F.col("rep").alias("a"), F.col("sigs").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("sigs").alias("sb"))
    checked = pairs.join(sa, "a").join(sb, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).where(F.col("likeness") >= threshold)
    return checked.select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b"), "likeness")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fingerprint, sigs, rep: documents with equal fingerprints share the smallest id as their representative."""
    d = docs.select(F.col(key).alias("_key"), signatures(F.col(text)).alias("sigs")).withColumn("fingerprint", as_text(F.col("sigs")))
    reps = d.groupBy(F.sha2("fingerprint", 256).alias("h")).agg(F.min("_key").alias("rep"))
    return d.withColumn("h", F.sha2("fingerprint", 256)).join(reps, "h").select(F.col("_key").alias(key), "fingerprint", "sigs", "rep")


#: Neighbouring ids are kept together in runs of 2**RUN; runs, and runs of runs, in groups of 2**RUNS, until few are left.
RUN, RUNS = 9, 12
_NO_ID = 1 << (63 - RUN)


def _run(key: Column) -> Column:
    return F.coalesce(F.shiftright(key.cast("long"), RUN), F.lit(_NO_ID))


def with_previous(runs: DataFrame, bits: int) -> DataFrame:
    """run, before: the run that comes before each (before the first: the last). bits: how many a run's number has.

    A run's forerunner is in its group, or the last one of the group before it, which is found in the same way; so no
    window holds more than a group, however sparse the ids are.
    """
    if bits <= RUNS:
        order = Window.orderBy("run")
        last = F.max("run").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return runs.select("run", F.coalesce(F.lag("run").over(order), last).alias("before"))
    grouped = runs.withColumn("group", F.shiftright("run", RUNS))
    ends = grouped.groupBy("group").agg(F.max("run").alias("end"))
    above = with_previous(ends.select(F.col("group").alias("run")), bits - RUNS)
    enders = above.join(ends.select(F.col("group").alias("before"), "end"), "before").select(F.col("run").alias("group"), "end")
    inside = grouped.withColumn("inside", F.lag("run").over(Window.partitionBy("group").orderBy("run")))
    return inside.join(enders, "group").select("run", F.coalesce("inside", "end").alias("before"))


def run_heads(docs: DataFrame) -> DataFrame:
    """run, head (its smallest id), prev (the run before it; before the first: the last). One row per run of ids."""
    heads = written(docs.groupBy(_run(F.col("doc_id")).alias("run")).agg(F.min("doc_id").alias("head")), "spotsigs-runs")
    return heads.join(with_previous(heads.select("run"), 64 - RUN).withColumnRenamed("before", "prev"), "run")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by ascending id (ties: by text; null ids last; after the last row: the first).
    Ids are cut into runs, the first row of each run visits the run before it, and a window over a run gives each row
    its next one; so the text is shuffled once and no task sees more than a few runs. The edited text is the text with
    its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next text.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("run", _run(F.col("doc_id")))
    here = F.struct(F.col("run").alias("run"), F.lit(False).alias("visits"))
    there = F.struct(F.col("prev").alias("run"), F.lit(True).alias("visits"))
    placed = d.join(run_heads(docs), "run").select("doc_id", "text", F.explode(
        F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(here, there)).otherwise(F.array(here))).alias("at"))
    placed = placed.select("doc_id", "text", "at.run", "at.visits").repartition("run")
    w = Window.partitionBy("run").orderBy("visits", F.col("doc_id").asc_nulls_last(), "text")
    rows = placed.withColumn("sigs", signatures(F.col("text"))).select(
        "doc_id", "text", "visits", "sigs", F.lead("text").over(w).alias("next_text"), F.lead("sigs").over(w).alias("next_sigs")).where(~F.col("visits"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sigs", signatures(F.col("edited")).alias("edited_sigs"), "next_sigs")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
