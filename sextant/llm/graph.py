"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node on a link (a, b): root is the smallest node reachable.

    Each round joins every node's larger neighbours to its smallest one, then its smaller ones; edges only ever point
    to smaller nodes, and the rounds end when nothing changes (about the logarithm of the longest chain). Every round
    is written to the shared folder. A node's smallest neighbour is a sum by key that meets its edges in a join, so the edges of a
    hub are spread over tasks; nothing is collected but two numbers.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(u > v).distinct()
    e = written(e, "links")
    state = None
    while True:
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u > v).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", "m")
        down = small.select(v.alias("u"), F.col("m").alias("v")).where(u > v)
        before, e = e, written(down.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = e.select(u.alias("node"), v.alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
