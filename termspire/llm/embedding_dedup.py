"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspire.llm.common import SPACE, share_bound, spread_join, table
from termspire.llm.components import components

#: Vectors that the first splits of the trees are fitted to, about, and numbers that these hold in all; every vector is indexed.
SAMPLE, SAMPLE_VALUES = 30_000, 1 << 23
#: How often a pair at the threshold may be parted in every tree, if projections are spread as those of random unit vectors.
MISS = 1e-6
#: Widths of spill that :func:`plan` chooses from, in units of the distance of a pair at the threshold along a random direction.
WIDTHS = tuple(k / 16 for k in range(29))
#: Rows of a label that a leaf is meant to have, rows beyond which it's split again, and rows that are compared as one block.
LEAF, MOST, BLOCK = 1500, 8192, 2048
#: Neighbours up to which a vector's pairs are looked at one by one.
FEW = 64
#: Lengths of vectors that get trees from the sample; leaves of others come from the later splits alone.
FITTED = 16
#: A side that keeps more than this share of a leaf's rows ends its splits: copies of one vector can't be parted.
STUCK = 0.9
#: Node numbers fit below the tree's number.
DEEPEST = 1 << 43


@lru_cache(4096)
def _direction(dim: int, tree: int, node: int) -> np.ndarray:
    v = np.random.default_rng([dim, tree, node]).standard_normal(dim)
    return v / np.linalg.norm(v)


@dataclass(frozen=True)
class Plan:
    """Trees, and the spill times the root of the dimension: vectors nearer to a threshold go to both sides."""

    trees: int
    spill: float


def plan(depth: float, least: float = 0.98) -> Plan:
    """The cheapest trees of so many splits that part a pair of cosine ``least`` everywhere in at most MISS of all cases.

    Unit vectors of cosine ``least`` lie sqrt(2 - 2 * least) = g apart and along a random direction g / sqrt(dimension) in the mean
    square, as projections of all vectors lie 1 / sqrt(dimension). A spill of w times the former keeps a share of some 0.8 * w * g
    more at each split, and a split parts the pair with a probability that falls fast with w. Wide spill multiplies with the
    depth, narrow spill needs more trees: the copies of a vector are their product, and the plan has the least of it. For
    rows that grow fourfold it's some 1.5 times as many in trees of up to ten splits, 1.2 to 1.4 times in ones of up to twenty, and less in deeper ones.
    """
    gap, at_median = math.sqrt(max(2 - 2 * least, 0.0)), 1 / math.sqrt(2 * math.pi)
    found = []
    for w in WIDTHS:
        beyond = 2 * (math.exp(-2 * w * w) * at_median - 2 * w * math.erfc(math.sqrt(2) * w) / 2)
        parted = 1 - (1 - gap * at_median * beyond) ** depth
        trees = 1 if parted <= MISS else math.ceil(math.log(MISS) / math.log(parted))
        found.append((trees * (1 + 2 * w * gap * at_median) ** depth, trees, w * gap))
    return Plan(*min(found)[1:])


def fit(sample: np.ndarray, leaf: int, shape: Plan) -> list[dict[int, float]]:
    """For each tree, the median of the projections at each inner node; node i has the children 2i and 2i + 1.

    A node stays a leaf if it is small or if one of its sides would keep nearly
    everything, as with copies of one vector.
    """
    spill = shape.spill / sample.shape[1] ** 0.5
    forest = []
    for t in range(shape.trees):
        cuts: dict[int, float] = {}
        todo = [(1, sample)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf or node >= DEEPEST:
                continue
            p = rows @ _direction(sample.shape[1], t, node)
            cut = float(np.median(p))
            left, right = rows[p <= cut + spill], rows[p > cut - spill]
            if max(len(left), len(right)) > STUCK * len(rows):
                continue
            cuts[node] = cut
            todo += [(2 * node, left), (2 * node + 1, right)]
        forest.append(cuts)
    return forest


def assign(rows: np.ndarray, forest: list[dict[int, float]], spill: float) -> list[np.ndarray]:
    """The leaves of each vector in all trees, as tree << 44 | node, sorted."""
    spill = spill / rows.shape[1] ** 0.5
    out: list[list[int]] = [[] for _ in range(len(rows))]
    for t, cuts in enumerate(forest):
        todo = [(1, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node not in cuts:
                for i in at.tolist():
                    out[i].append(t << 44 | node)
                continue
            p = rows[at] @ _direction(rows.shape[1], t, node)
            todo += [(2 * node, at[p <= cuts[node] + spill]), (2 * node + 1, at[p > cuts[node] - spill])]
    return [np.array(sorted(x), np.int64) for x in out]


def split_again(at: DataFrame, vectors: DataFrame, spill_width: float) -> DataFrame:
    """``at`` (c, label, dim, leaf) with leaves of more than MOST rows of a label split until none is left that can be.

    A round projects the rows of all such leaves on their nodes' directions, takes the approximate median of each
    leaf as its cut, and deals rows to the two sides with spill: all of it distributed, with one row a leaf going back. A leaf
    whose side would keep nearly everything, or whose node number is at the end of its range, stays as it is: its
    rows are compared in blocks. So the work doesn't hang on how many leaves the sample could fit.
    """
    group = ["label", "dim", "leaf"]
    done = None

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.empty(len(batch))
            for (dim, leaf), part in batch.groupby(["dim", "leaf"]).indices.items():
                own = _unit(batch["v"].iloc[part])
                p[part] = own @ _direction(int(dim), int(leaf) >> 44, int(leaf) & ((1 << 44) - 1))
            yield batch[["c", *group]].assign(p=p)

    while True:
        sizes = at.groupBy(*group).agg(F.count("*").alias("n"))
        large = table(sizes.where(F.col("n") > MOST), "large-leaves")
        if large.isEmpty():
            return at if done is None else at.unionByName(done)
        key = F.concat_ws("|", "label", "dim", "leaf")
        keyed = at.withColumn("k", key)
        mine = spread_join(keyed, large.select(key.alias("k"), "n"), "k").drop("k", "n")
        rows = table(mine.join(vectors.select("c", "v"), "c").mapInPandas(project, "c string, label string, dim int, leaf long, p double"), "projected")
        spill = F.lit(spill_width) / F.sqrt("dim")
        cuts = table(rows.groupBy(*group).agg(F.percentile_approx("p", 0.5, 1000).alias("cut"), F.count("*").alias("n")).withColumn("k", key).select("k", "cut", "n"), "cuts")
        sided = spread_join(rows.withColumn("k", key), cuts, "k")
        left, right = F.col("p") <= F.col("cut") + spill, F.col("p") > F.col("cut") - spill
        sided = table(sided.select("c", *group, "k", "n", left.alias("left"), right.alias("right")), "sides")
        node = F.col("leaf").bitwiseAND(F.lit((1 << 44) - 1))
        stuck = sided.groupBy("k").agg(F.max("n").alias("n"), F.count_if("left").alias("l"), F.count_if("right").alias("r"), F.max(node).alias("node"))
        stuck = stuck.select("k", ((F.greatest("l", "r") > STUCK * F.col("n")) | (F.col("node") >= DEEPEST)).alias("stuck"))
        sided = spread_join(sided, table(stuck, "stuck"), "k")
        base = F.col("leaf") - node
        kids = F.filter(F.array(F.when(F.col("left"), base + 2 * node), F.when(F.col("right"), base + 2 * node + 1)), lambda x: x.isNotNull())
        ended = sided.where("stuck").select("c", *group)
        done = ended if done is None else done.unionByName(ended)
        rest = spread_join(keyed.withColumn("one", F.lit(1)), large.select(key.alias("k"), F.lit(True).alias("big")), "k", "left").where("big is null")
        at = table(rest.select("c", *group).unionByName(sided.where("not stuck").select("c", "label", "dim", F.explode(kids).alias("leaf"))), "leaves-again")


def _earlier(leaves, leaf: int) -> np.ndarray:
    """A row for each vector: its leaves before ``leaf``, then -1."""
    own = [x[x < leaf] for x in map(np.asarray, leaves)]
    out = np.full((len(own), max(map(len, own), default=0)), -1, np.int64)
    for row, x in zip(out, own, strict=True):
        row[: len(x)] = x
    return out


def _fresh(near: np.ndarray, some: np.ndarray, every: np.ndarray) -> np.ndarray:
    """``near`` (some x every) without pairs that share an earlier leaf, where they have been counted.

    Vectors with FEW neighbours at most are looked at pair by pair; those of dense groups, whose leaves are mostly the same, by a product
    over the leaves that they have. So memory is bounded by the leaves a vector has, not by those of all vectors here.
    """
    if not every.shape[1]:
        return near
    fresh, n = near.copy(), near.sum(axis=1)
    i, j = np.nonzero(near & (n <= FEW)[:, None])
    for a in range(0, len(i), 4096):
        p, q = i[a : a + 4096], j[a : a + 4096]
        x = some[p]
        fresh[p, q] = ~((x[:, :, None] == every[q][:, None, :]) & (x >= 0)[:, :, None]).any(axis=(1, 2))
    dense = np.flatnonzero(n > FEW)
    if len(dense):
        names = np.unique(some[dense])
        names = names[names >= 0]
        for a in range(0, len(names), 1024):
            part = names[a : a + 1024]
            one, two = (np.zeros((len(m), len(part)), np.float32) for m in (dense, every))
            for out, rows in ((one, some[dense]), (two, every)):
                at = np.searchsorted(part, rows)
                hit = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == rows)
                r, c = np.nonzero(hit)
                out[r, at[r, c]] = 1
            fresh[dense] &= one @ two.T == 0
    return fresh


def _unit(vectors) -> np.ndarray:
    rows = np.array([np.asarray(v, np.float64) for v in vectors])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _valid(v: str) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(v).isNotNull() & finite & F.exists(v, lambda x: x != 0)


def link(docs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept): vectors of equal, non-null label with cosine >= ``least``.

    Vectors that are null, empty, zero or hold null or non-finite components,
    those of null label and those of null id are linked with nothing; vectors of different
    lengths aren't compared. Equal vectors form a class that counts as often as it has rows
    (distinct ids). A component's id is the smallest id in it.

    Trees split the unit vectors at medians of random projections; what lies
    near a threshold goes to both sides, as :func:`plan` has it for the number of vectors. The first splits are fitted to a sample, leaves
    that are still large are split further on the executors. Classes of one leaf and label are compared with
    each other in blocks of bounded size, which are tasks of their own: a leaf that can't be split,
    or a label with a third of all rows, becomes many blocks. A pair that shares several leaves is
    counted in the first of them, so blocks return sums and a spanning forest,
    never pairs.

    Rows that repeat id, label and vector count once and get the same result; of an id with several vectors links add up. Columns
    of other names are ignored; an empty table gives no rows. Splits may part a linked pair in all trees: measured
    recall is in the README.
    """
    # Single floats stay such until they're compared, in double precision.
    kind = "array<float>" if dict(docs.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"), F.col(label_col).cast("string").alias("label"))
    # A class is known by 128 bits of its label and vector: ids may repeat with other ones.
    hashed = lambda i: F.lpad(F.hex(F.xxhash64(F.lit(i), "label", "v")), 16, "0")
    real = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _valid("v")).withColumn("c", F.concat(hashed(0), hashed(1)))
    classes = real.groupBy("c").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("id").alias("rep"), F.count_distinct("id").alias("m"))
    classes = table(classes, "classes")
    lengths = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(FITTED).collect()
    total = sum(r["n"] for r in lengths)
    # Only vectors of one label are compared, so leaves are as large as the largest label's part of them allows.
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    most, every = largest[0] or 1, largest[1] or 1
    shape = plan(max(0.0, math.log2(most / LEAF)), least)
    forests = {}
    for dim, n in lengths:
        share = min(1.0, SAMPLE / total, SAMPLE_VALUES / dim / n)
        own = classes.where(F.size("v") == dim)
        picked = own.where(F.pmod(F.xxhash64("c", F.lit(3)), F.lit(SPACE)) < share_bound(share)).select("v").toPandas()
        if len(picked):
            forests[dim] = fit(_unit(picked["v"]), max(8, int(LEAF * every / most * share)), shape)
    roots = np.array([t << 44 | 1 for t in range(shape.trees)])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len)
            for dim, part in batch.groupby(sizes):
                found = assign(_unit(part["v"]), forests[dim], shape.spill) if dim in forests else [roots] * len(part)
                yield pd.DataFrame({"c": part["c"], "label": part["label"], "dim": dim, "leaves": found})

    placed = classes.mapInPandas(place, "c string, label string, dim int, leaves array<long>")
    first = table(placed.select("c", "label", "dim", F.explode("leaves").alias("leaf")), "leaves")
    at = split_again(first, classes, shape.spill)
    every = at.groupBy("c").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    at = at.join(every, "c")
    sizes = at.groupBy("label", "dim", "leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    at = at.join(sizes, ["label", "dim", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at = at.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    at = at.withColumn("b", F.explode(other)).select("c", "label", "dim", "leaf", "leaves", "own", "b.i", "b.j")
    at = at.join(classes.select("c", "v", "m", "rep"), "c")

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = (int(batch[k].iloc[0]) for k in ("leaf", "i", "j"))
        v = _unit(batch["v"])
        mine, own = batch["m"].to_numpy(np.int64), batch["own"].to_numpy()
        earlier = _earlier(batch["leaves"], leaf)
        n = len(batch)
        count, root = np.zeros(n, np.int64), np.arange(n)
        step = 256
        for a in range(0, n, step):
            near = v[a : a + step] @ v.T >= least
            near[np.arange(min(step, n - a)), np.arange(a, min(a + step, n))] = False
            if i != j:
                near &= own[a : a + step, None] != own
            if not near.any():
                continue
            count[a : a + step] += _fresh(near, earlier[a : a + step], earlier) @ mine
            for x in np.flatnonzero(near.any(axis=1)):
                # Its neighbours' roots all become the least of them.
                group = np.append(np.flatnonzero(near[x]), a + x)
                roots = np.unique(root[group])
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
        k = (count > 0) | (root != np.arange(n))
        rep = batch["rep"].to_numpy()
        return pd.DataFrame({"c": batch["c"].to_numpy()[k], "n": count[k], "a": rep[k], "b": rep[root[k]]})

    parts = at.groupBy("label", "dim", "leaf", "i", "j").applyInPandas(compare, "c string, n long, a long, b long")
    parts = table(parts, "linked")
    counts = parts.groupBy("c").agg(F.sum("n").alias("n"))
    inside = spread_join(table(real.select("id", "c").distinct(), "ids"), classes.select("c", "rep", "m"), "c")
    inside = table(inside, "members")
    edges = parts.select("a", "b").unionByName(inside.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    whole = components(edges)
    n = inside.join(counts, "c", "left").groupBy("id").agg(F.sum(F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.select("id").join(n, "id", "left").join(whole, F.col("id") == F.col("node"), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
