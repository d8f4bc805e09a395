"""Exact top-k inner-product search by MaxScore over shards of the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.llm.common import SPACE, share_bound, table, trimmed

#: Numbers that the vectors of a shard hold, about: what a task keeps in memory is a small multiple.
SHARD_VALUES = 1 << 19
#: Vectors with bounds of their own, and terms that are added up between two tests of what can still compete.
BLOCK, STEP = 2048, 8
#: Vectors that give each query its first threshold, about, and numbers in them; and queries for which a task scores these.
PILOT, PILOT_VALUES, PART = 2048, 1 << 19, 4096
#: Whole numbers that a double holds exactly.
EXACT = 1 << 53
_LONG = (-(1 << 63), (1 << 63) - 1)


class Block:
    """Some vectors as postings: a term is a component, its postings are the vectors in which it isn't 0, told by sign."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, rows: np.ndarray):
        self.ids, self.known, self.rows = ids, known, rows
        self.above, self.below = rows > 0, rows < 0
        self.high, self.low = rows.max(axis=0), rows.min(axis=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that each term can add to a score; what lowers a score is never counted on."""
        return np.maximum(np.maximum(q * self.high, q * self.low), 0)

    def search(self, q: np.ndarray, bounds: np.ndarray, least) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all vectors that score ``least`` or more.

        Terms go by falling bound. Those after which the bounds left over sum to less than ``least`` aren't essential: a vector that is
        in no essential posting with the query's sign can't compete. The others are probed for what the essential ones found, as
        long as it can still reach ``least``.
        """
        order = np.argsort(-bounds, kind="stable")
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
        essential = int(np.argmax(rest < least)) if rest[-1] < least else len(order)
        if essential == len(order) and rest[-1] >= least:
            at = np.arange(len(self.rows))  # a vector in no posting may do
        else:
            found = np.zeros(len(self.rows), bool)
            for j in order[:essential]:
                found |= (self.above if q[j] > 0 else self.below)[:, j]
            at = np.flatnonzero(found)
        score = np.zeros(len(at), self.rows.dtype)
        for k in range(0, len(order), STEP):
            keep = score + rest[k] >= least
            if not keep.all():
                at, score = at[keep], score[keep]
            if not len(at):
                break
            terms = order[k : k + STEP]
            score = score + self.rows[at[:, None], terms] @ q[terms]
        keep = score >= least
        return at[keep], score[keep]


class Shard:
    """Vectors that are searched together, like ones in a block, so that bounds are close."""

    def __init__(self, ids: list, vectors: list[np.ndarray]):
        self.dim = max(map(len, vectors))
        rows = np.zeros((len(vectors), self.dim))
        for i, v in enumerate(vectors):
            rows[i, : len(v)] = v
        self.most = float(np.abs(rows).max()) if rows.size else 0.0
        if self.dim:
            top = np.abs(rows).argmax(axis=1)
            order = np.lexsort((rows[np.arange(len(rows)), top] > 0, top))
        else:
            order = np.arange(len(rows))
        known = np.array([i is not None for i in ids])[order]
        number = np.array([i or 0 for i in ids], np.int64)[order]
        self.parts = [(number[a : a + BLOCK], known[a : a + BLOCK], rows[order[a : a + BLOCK]]) for a in range(0, len(rows), BLOCK)]
        self.built: dict[bool, list[Block]] = {}

    def blocks(self, wide: bool) -> list[Block]:
        """In doubles, or in Python's integers where a score might need more than a double holds exactly."""
        if wide not in self.built:
            as_wide = lambda r: np.array([[int(x) for x in row] for row in r.tolist()], object).reshape(r.shape)
            self.built[wide] = [Block(i, n, as_wide(r) if wide else r) for i, n, r in self.parts]
        return self.built[wide]

    def top(self, own: int | None, q: np.ndarray, k: int, least: int | None) -> list[tuple]:
        """(id, score) of the ``k`` best vectors but ``own`` among those that score ``least`` or more, ties to smaller ids, null last."""
        q = np.append(q, np.zeros(max(0, self.dim - len(q))))[: self.dim]
        wide = self.dim > 0 and float(np.abs(q).max(initial=0)) * self.most * self.dim >= EXACT
        q = np.array([int(x) for x in q], object) if wide else q
        ids, unknown, scores = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, object if wide else float)
        floor = float("-inf") if least is None else least
        if not self.dim:
            q, blocks = np.zeros(1), [Block(i, n, np.zeros((len(i), 1))) for i, n, _ in self.parts]
        else:
            blocks = self.blocks(wide)
        bounds = [b.bounds(q) for b in blocks]
        sums = [x.sum() for x in bounds]
        for b in sorted(range(len(blocks)), key=lambda b: -sums[b]):
            if sums[b] < floor:
                break
            at, score = blocks[b].search(q, bounds[b], floor)
            if own is not None:
                other = ~(blocks[b].known[at] & (blocks[b].ids[at] == own))
                at, score = at[other], score[other]
            ids, unknown = np.append(ids, blocks[b].ids[at]), np.append(unknown, ~blocks[b].known[at])
            scores = np.append(scores, score)
            best = np.lexsort((ids, unknown, -scores))[:k] if not wide else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], unknown[i], ids[i]))[:k], int)
            ids, unknown, scores = ids[best], unknown[best], scores[best]
            if len(ids) == k:
                floor = max(floor, scores[-1])
        limited = [min(max(int(s), _LONG[0]), _LONG[1]) for s in scores]
        return [(None if u else int(i), s) for i, u, s in zip(ids, unknown, limited, strict=True)]


def _numbers(column: pa.Array, scale: float) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    flat = np.floor(scale * flat)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _score(cells: DataFrame, k: int, scale: float) -> DataFrame:
    """(q_id, id, score) of each cell's queries over its vectors. ``cells``: cell, kind (0 vectors, 1 queries), id, v, least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, shard = None, [], [], None
        for batch in batches:
            kind, ids_of, least = (batch.column(n).to_pylist() for n in ("kind", "id", "least"))
            found: list[tuple] = []
            for i, (cell, v) in enumerate(zip(batch.column("cell").to_pylist(), _numbers(batch.column("v"), scale), strict=True)):
                if cell != now:
                    now, ids, vectors, shard = cell, [], [], None
                if kind[i] == 0:
                    ids.append(ids_of[i])
                    vectors.append(v)
                    continue
                if shard is None and vectors:
                    shard, ids, vectors = Shard(ids, vectors), [], []
                if shard:
                    found += [(ids_of[i], *x) for x in shard.top(ids_of[i], v, k, least[i])]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q_id", "id", "score"])

    return cells.mapInArrow(trimmed(work), "q_id long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def usable(v: str) -> Column:
    """Vectors without null or non-finite components; the empty one is usable."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` vectors of largest inner product with each query but its own, ties to the smaller id.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components take no part, neither as queries nor
    as candidates; shorter vectors count as if zeros followed, empty ones score 0. A candidate without an id comes after others of its
    score; a query without one is none. Rows that repeat an id are candidates one by one, and none of them for a query of that id; of
    queries that repeat an id the one with the smallest vector is asked. Scores are exact whatever the components' size; those that no
    long holds become the nearest one. Empty tables give no rows; columns of other names are ignored.

    Vectors are dealt to shards by a hash, of SHARD_VALUES numbers each, whatever the table's size; queries go to every shard and stream
    past its postings, so a task holds one shard and a batch of queries. Each query starts with the k-th score
    among some PILOT vectors as its threshold. Shards return what reaches it, ``k`` rows a query at most, and these are merged.
    """
    rows = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable("v"))
    asked = table(rows(queries).where("id is not null").groupBy("id").agg(F.min("v").alias("v")), "queries")
    all_rows = rows(vectors)
    n, values = all_rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()
    shards, parts = -(-values // SHARD_VALUES) or 1, -(-asked.count() // PART) or 1
    spread = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    dealt = lambda most, *by: F.pmod(F.xxhash64(*by), F.lit(most)).cast("int")

    def scored(held: DataFrame, sent: DataFrame, cells: int) -> DataFrame:
        cells_of = held.select("cell", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("long").alias("least"))
        cells_of = cells_of.unionByName(sent.select("cell", F.lit(1).alias("kind"), "id", "v", "least"))
        return _score(cells_of.repartition(cells, "cell").sortWithinPartitions("cell", "kind"), k, scale)

    share = min(1.0, PILOT / max(1, n), PILOT_VALUES / max(1, values))
    pilot = all_rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(SPACE)) < share_bound(share)).withColumn("cell", spread(parts))
    first = scored(pilot, asked.withColumns({"cell": dealt(parts, "id"), "least": F.lit(None).cast("long")}), parts)
    least = _best(first, k).where(F.col("rank") == k).select(F.col("q_id").alias("id"), F.col("score").alias("least"))
    sent = table(asked.join(least, "id", "left"), "thresholds").withColumn("cell", spread(shards))
    # Equal rows are dealt by a second hash, so that copies of one vector don't fill one shard.
    found = scored(all_rows.withColumn("cell", dealt(shards, "id", F.monotonically_increasing_id())), sent, shards)
    return _best(found, k).select(F.col("q_id").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
