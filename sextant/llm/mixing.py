"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is its source's target repetition rate. The count comes
from inverting the Poisson distribution at a uniform number hashed from seed and document, so a rerun after a lost
executor gives the same rows. The output is shuffled globally by a hashed key.

Only DataFrame functions. Shuffles: one small count by source, and the final range partitioning of the mixed rows.
A hot source needs no special care: replication is row by row, and the rows are dealt out by the hashed key.

Edge cases: a null source is a source of its own (weight under None, else the default); null ids and texts are mixed as
any other; repeated rows of the same id get the same count; an empty table gives an empty result; other columns pass
through. Counts and draws never depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Hex digits of a hash that make a uniform number.
DIGITS = 12


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the md5 of a string."""
    return (F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))


def poisson_terms(rate: float, tail: float = 1e-15) -> list[float]:
    """P(X <= 0), P(X <= 1), ... until the rest is below `tail`; summed in that order."""
    import math

    term, total, out = math.exp(-rate), math.exp(-rate), []
    k = 0
    while True:
        out.append(total)
        if 1 - total <= tail or (k > rate and term < tail / 10):
            return out
        k += 1
        term = term * rate / k
        total = total + term


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, default: float = 1.0, size: float = 1.0) -> DataFrame:
    """One row per source: mix_source, n, rate. rate = size * N * (weight share) / n.

    The shares are the weights of the sources present over their sum; `size` is the output size as a multiple of N.
    """
    counts = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(default))
    for name, w in (weights or {}).items():
        if w < 0:
            raise ValueError("weights must not be negative")
        same = F.col("mix_source").isNull() if name is None else F.col("mix_source") == F.lit(name)
        weight = F.when(same, F.lit(float(w))).otherwise(weight)
    weighted = counts.withColumn("w", weight)
    totals = weighted.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0)
    return weighted.join(F.broadcast(totals)).select("mix_source", "n", (F.lit(float(size)) * F.col("all_n") * share / F.col("n")).alias("rate"))


def poisson_count(rate: Column, u: Column, most: int) -> Column:
    """Smallest k with P(X <= k) >= u, by adding terms until they pass u; `most` bounds the terms added."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"), F.lit(0).alias("k"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * rate / j
        more = F.struct(term.alias("term"), (s["total"] + term).alias("total"), j.alias("k"))
        return F.when(s["total"] >= u, s).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["k"])


#: Up to so many sources their rates are broadcast; beyond, Spark joins by source (and splits skewed ones).
MOST_SOURCES = 50_000
#: A Poisson of a larger mean is the sum of independent ones of at most this mean, each from its own hash.
PIECE = 8.0
#: P(X > 60) at mean 8 is below 1e-30, and u is below 1 - 1e-15: the sum always passes u before.
TERMS = 60


def replicate(docs: DataFrame, by_source: DataFrame, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Each row of `docs` repeated by its Poisson count; adds mix_copy (0, 1, ...) and mix_key (its place in the global order)."""
    rate = F.coalesce(F.col("rate"), F.lit(0.0))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    pieces = F.greatest(F.lit(1), F.ceil(rate / PIECE).cast("int"))
    single = poisson_count(rate, uniform(F.concat_ws(":", name, F.lit("0"))), TERMS)
    several = F.aggregate(
        F.sequence(F.lit(0), pieces - 1), F.lit(0),
        lambda total, i: total + poisson_count(rate / pieces, uniform(F.concat_ws(":", name, i.cast("string"))), TERMS),
    )
    copies = F.when(pieces == 1, single).otherwise(several)
    table = by_source.select("mix_source", "rate")
    if table.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        table = F.broadcast(table)
    joined = docs.join(table, docs["source"].eqNullSafe(F.col("mix_source")), "left")
    counted = joined.withColumn("mix_n", copies).where("mix_n > 0")
    copied = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)))
    return copied.withColumn("mix_key", F.md5(F.concat_ws(":", name, F.lit("place"), F.col("mix_copy").cast("string")))).drop("mix_source", "rate", "mix_n")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, default: float = 1.0, size: float = 1.0, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """`docs` mixed to the weights and shuffled globally: range partitions of mix_key, sorted within.

    The table of rates has one row per source, is written once and broadcast if it is small (MOST_SOURCES). Columns of
    docs named mix_copy, mix_key, mix_source, mix_n or rate are replaced.
    """
    clean = docs.drop("mix_copy", "mix_key", "mix_source", "mix_n", "rate")
    mixed = replicate(clean, written(rates(docs, weights, default, size), "mix-rates"), seed, key)
    return mixed.repartitionByRange("mix_key").sortWithinPartitions("mix_key", key, "mix_copy")
