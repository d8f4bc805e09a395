"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.llm.common import LIGHT, remove, spread_join, table


def _shape(pairs: DataFrame) -> tuple[bool, int]:
    """Whether every ``u`` has one ``v`` only and no ``v`` is a ``u`` (then each ``v`` is the least node of its component), and
    the pairs of the node that has most."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.count("*").alias("n"))
    bad = F.count_if((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("n") > F.col("ups"))))
    r = nodes.agg(bad.alias("bad"), F.max("n").alias("most")).first()
    return r["bad"] == 0, r["most"] or 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b) of longs to (node, component): the smallest node reachable.

    Nodes without an edge to another node aren't returned; an empty table gives none. Every round writes
    its pairs to the shared folder and removes those of the round before; the number of rounds grows with the
    logarithm of the longest path. Minima are aggregated in part before they are shuffled, and they go back to the pairs by
    :func:`spread_join`, so the pairs of a hub are never gathered; nothing but one number a round comes to
    the driver.
    """
    pairs = table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    while True:
        done, most = _shape(pairs)
        if done:
            break
        # Without a hub a plain join does the same; with one, what is joined is stored, as it's read more than once.
        hubs = most > LIGHT
        join = spread_join if hubs else DataFrame.join
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large.distinct(), name) if hubs else large
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            join(large, lower, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        old, pairs = [pairs, *[large] * hubs], table(small, name)
        for t in old:
            drop(t)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select("v", "v").distinct()
    )


def drop(done: DataFrame) -> None:
    """Remove a stored table whose rows live on in a later one."""
    files = done.inputFiles()
    if files:
        remove(done.sparkSession, files[0].rsplit("/", 1)[0])
