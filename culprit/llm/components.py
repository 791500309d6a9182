"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culprit.functions.storage import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its neighbours (large: the larger ones; small: the smaller ones and itself)
    to the smallest node it sees. Minima are combined before the shuffle, so a node with many links is no
    single group."""
    if large:
        near = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.filter("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionAll(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node of its component) for every node of ``links(a, b)``, two bigints.
    Nodes without links do not appear. The number of rounds grows with the logarithm of the longest chain."""
    links = stored(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = lambda d: d.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
    now = sign(links)
    while now["n"]:
        links = stored(_star(_star(links, True), False))
        before, now = now, sign(links)
        if now == before:
            break
    # every link now leads from a node to the smallest one
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
