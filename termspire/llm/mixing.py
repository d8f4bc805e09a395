"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.llm.common import in_order, spread_join, table

#: Words are runs of characters other than ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: A level of the nested histogram has 2**BITS buckets; LEVELS levels use BITS * LEVELS bits of the hash.
BITS, LEVELS = 10, 3
#: Equal rows that one row of a group becomes at first, and again.
COPIES = 1024


def _before(rows: DataFrame, keys: list, **sums: Column) -> DataFrame:
    """Rows of :func:`in_order` with, for each name, the sum of a column over all rows before each; one row a range is broadcast."""
    parts = rows.groupBy("_part").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(parts), "_part")
    return out.withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).drop(*(f"_{k}" for k in sums))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, get the weights in turn; targets
    share 100% of all sizes by weight and stop at ``most`` times the source's
    size, the excess reshared by weight until none is above. With a common level
    L, a target is min(most * size, L * weight): sources fill up in the order of
    most * size / weight, so running sums over that order give L. Places and sums are taken
    range by range, so there may be as many sources as hosts.
    """
    by_name = [F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8")]
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("i") % n + 1).cast("int"))
    named = _before(in_order(sizes, "sources", *by_name), by_name, i=F.lit(1)).drop("_part")
    named = named.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filling = [F.col("cap") / F.col("w"), F.col("i")]
    full = _before(in_order(named, "filling", *filling), filling, filled=F.col("cap"), closed_w=F.col("w"))
    every = named.agg(F.sum("source_size").cast("double").alias("total"), F.sum("w").alias("all_w"))
    full = full.crossJoin(F.broadcast(every))  # one row
    level = (F.col("total") - F.col("filled")) / (F.col("all_w") - F.col("closed_w"))
    full = table(full.withColumn("level", level), "levels")
    # The first source in that order that the level doesn't fill sets it.
    first = full.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct(F.col("cap") / F.col("w"), "i", "level")).alias("m"))
    out = full.drop("level").crossJoin(F.broadcast(first.select(F.col("m.level").alias("l"))))  # one row
    return out.select("source", "source_size", F.coalesce(F.least("cap", F.col("l") * F.col("w")), F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", weights=(1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """Rows of (id, source, size, source_size, target, taken, times, text_hash).

    ``size`` is the number of words of the whole text; ``times`` is how often it is
    taken, which ``taken`` can't tell of a text without words. A source whose target is
    q * source_size + r takes every document q times and, of a hash of the id, the text and, where
    rows repeat both, a number of the repeat, those below a threshold once more. The threshold comes from a histogram of
    sizes by source and the hash's first bits; only the bucket that holds the
    budget's boundary is refined with the next bits, level by level, and of the
    last bucket (2**-30 of the hash space) a document is taken if the words
    before it leave room for half of it or more. Nothing is sorted but the
    documents of that last bucket.

    Null text has size 0; null sources form one source; rows of a null or repeated id are documents of their own, so
    a source of them meets its target too; an empty table gives no rows. A very long text may miss the target by half its
    size. Columns of other names are ignored.
    """
    one = docs.select(
        F.col(id_col).alias("id"), F.col("source"), F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )
    # Equal rows are counted and numbered; a large group is spread over many tasks before it is written out.
    groups = one.groupBy("id", "source", "text_hash", "size").agg(F.count("*").alias("n"))
    chunks = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    large = chunks.where(F.col("n") > COPIES).repartition("id", "text_hash", "chunk")
    chunks = chunks.where(F.col("n") <= COPIES).unionByName(large)
    last = F.least(F.col("n") - F.col("chunk") * COPIES, F.lit(COPIES)) - 1
    copies = chunks.withColumn("copy", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i + F.col("chunk") * COPIES)))
    rows = table(
        copies.select("id", "source", "text_hash", "size", F.xxhash64("id", "text_hash", "copy", F.lit(seed)).alias("h"))
        .withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))),
        "mix",
    )
    bucket = lambda level: F.shiftrightunsigned("h", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("room", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = table(plan.withColumn("prefix", F.lit(0).cast("long")), "mixplan")
    for level in range(LEVELS):
        # Only the rows in the boundary bucket of the level above are counted.
        inside = rows if level == 0 else rows.withColumn("prefix", F.shiftrightunsigned("h", 64 - BITS * level))
        on = F.col("r.source").eqNullSafe(F.col("p.source"))
        if level:
            on = on & (F.col("r.prefix") == F.col("p.prefix"))
        counts = (
            inside.alias("r").join(plan.alias("p"), on, "left_semi")
            if level
            else inside
        ).withColumn("b", bucket(level)).groupBy("source", "b").agg(F.sum("size").alias("n"))
        running = Window.partitionBy("source").orderBy("b")
        edges = (
            counts.withColumn("upto", F.sum("n").over(running))
            .alias("c")
            .join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")))
            .where("c.upto > p.room")
            .groupBy(F.col("p.source").alias("source"))
            .agg(F.min(F.struct("c.b", (F.col("p.room") - (F.col("c.upto") - F.col("c.n"))).alias("room"))).alias("m"))
        )
        plan = table(
            plan.alias("p")
            .join(edges.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
            .select(
                "p.source", "p.source_size", "p.target", "p.passes",
                F.coalesce("e.m.room", F.lit(0.0)).alias("room"),
                # No bucket goes beyond the room: all that is left is taken.
                (F.col("p.prefix") * (1 << BITS) + F.coalesce("e.m.b", F.lit((1 << BITS) - 1).cast("long"))).alias("prefix"),
            ),
            "mixplan",
        )
    prefix = F.shiftrightunsigned("h", 64 - BITS * LEVELS)
    plan = plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"), "source_size", "target", "passes", "room", "prefix")
    joined = spread_join(rows, plan, "s").withColumn("mine", prefix)
    edge = joined.where("mine = prefix")
    before = Window.partitionBy("s").orderBy("h", "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    edge = edge.withColumn("more", (F.col("before") + F.col("size") / 2 <= F.col("room")).cast("long")).drop("before")
    rest = joined.where("mine <> prefix").withColumn("more", (F.col("mine") < F.col("prefix")).cast("long"))
    # A source that takes everything `most` times has no room, so nothing goes beyond it; one without words goes once.
    room = (F.col("source_size") == 0) | (F.col("target") > F.col("passes") * F.col("source_size"))
    times = F.col("passes") + F.when(room, F.col("more")).otherwise(0)
    return edge.unionByName(rest).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("size") * times).cast("long").alias("taken"), times.cast("int").alias("times"), "text_hash",
    )
