"""Joins of large tables with sides that some keys of theirs are very common in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.sources.store import stored

#: Keys of which :func:`spread_join` broadcasts the other side, at most.
MOST_HEAVY = 10_000
#: Rows of one key that are no matter.
LIGHT = 1_000
#: Rows that :func:`meet` broadcasts, at most.
SMALL = 200_000


def spread_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has a row a key, without gathering the rows of a common key.

    Keys with more than 1 / MOST_HEAVY of all rows are MOST_HEAVY at most, whatever the size of the table:
    their part of ``side`` is broadcast and their rows stay where they are. All others are shuffled; none of them has
    more than that share of the rows. ``how`` is inner, left or left_semi. Give stored tables: both are read more than once.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.greatest(F.lit(LIGHT), F.count("*") / MOST_HEAVY).alias("_least"))
    heavy = counts.crossJoin(F.broadcast(total)).where("_n > _least").select(key)  # one row
    own = side.join(F.broadcast(heavy), key, "left_semi")
    hot = rows.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(own), key, how)
    return hot.unionByName(rows.join(F.broadcast(heavy), key, "left_anti").join(side, key, how))


def meet(rows: DataFrame, queries: DataFrame, keys: list[str], small: int | None = None) -> DataFrame:
    """``rows`` of the index joined with what queries ask for (``keys`` and more columns, several rows a key).

    Queries of up to ``small`` rows are broadcast: rows of the index stay in their buckets. More than that become a row a key with
    a list, which :func:`spread_join` brings to the rows, so that a word that every document has is not gathered either. Give stored queries.
    """
    if queries.count() <= (SMALL if small is None else small):
        return rows.join(F.broadcast(queries), keys)
    rest = [c for c in queries.columns if c not in keys]
    key = F.struct(*keys)
    lists = stored(queries.groupBy(key.alias("_key")).agg(F.collect_list(F.struct(*rest)).alias("_own")), "queries-by-key")
    met = spread_join(stored(rows.withColumn("_key", key), "asked-rows"), lists, "_key")
    return met.select(*rows.columns, F.explode("_own").alias("_one")).select(*rows.columns, *(F.col(f"_one.{c}").alias(c) for c in rest))
