"""Near-duplicate documents: MinHash bands, odd sketches, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.llm.common import spread_join, table, text_of, trimmed
from termspire.llm.components import components

#: 42 bands of 6 of 252 minima miss a pair of similarity 0.8 once in 300,000 times.
BANDS, ROWS = 42, 6
#: Bits of an odd sketch, in 64-bit words.
SKETCH_WORDS = 16
#: Standard deviations that a pair's sketch may lie beyond what the threshold leads to expect.
SLACK = 6.0
#: Rounds that compare the members of a bucket with one of them only.
STAR_ROUNDS = 2
#: Documents that are compared as one block, and shingles that a block holds on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Texts whose minima and bitmaps are in memory at once.
TEXTS = 512
#: Shingles that are hashed at once.
CHUNK = 4096


def words(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased; only ASCII white space parts them."""
    return text.encode().lower().split()


def shingles(text: str, n: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``n`` words; a shorter text is one run, an empty one has none."""
    w = words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(n)), strict=False))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        self[word] = value
        return value


class Sketcher:
    """Distinct shingle hashes of a text, their minima by band, and the odd sketch of the minima."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        k = BANDS * ROWS
        self.n = n
        self.mask = rng.integers(0, 1 << 64, k, np.uint64)
        self.factor = rng.integers(0, 1 << 64, k, np.uint64) | np.uint64(1)
        self.mix = rng.integers(0, 1 << 64, max(n, 2), np.uint64) | np.uint64(1)
        self.place = rng.integers(0, 1 << 64, k, np.uint64) | np.uint64(1)
        self.hashes = _WordHashes()

    def distinct(self, text: str) -> np.ndarray:
        w = words(text)
        if not w:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, w), np.uint64, len(w))
        n = self.n
        if len(w) < n:  # told apart from longer runs by its length
            rest = xxhash.xxh3_64_intdigest(b"\0".join(w), seed=len(w))
            return np.array([rest], np.uint64)
        out = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            part = h[i : len(h) - n + 1 + i]
            out = (out ^ part) * self.mix[i]
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def minima(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.mask), np.iinfo(np.uint64).max, np.uint64)
        step = max(1, CHUNK)
        for i in range(0, len(s), step):
            low = np.minimum(low, ((s[i : i + step, None] ^ self.mask) * self.factor).min(axis=0))
        return low

    def bands(self, low: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each band of each row of minima."""
        rows = low.reshape(len(low), BANDS, ROWS)
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
        for i in range(ROWS):
            out = (out ^ rows[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out.view(np.int64)

    def sketches(self, low: np.ndarray) -> np.ndarray:
        """A bit for each minimum and its place, toggled: equal minima of two texts cancel in the XOR of their bitmaps."""
        bits = SKETCH_WORDS * 64
        at = ((low ^ (low >> np.uint64(32))) * self.place >> np.uint64(40)).astype(np.int64) % bits
        rows = np.repeat(np.arange(len(low)), at.shape[1])
        parity = np.bincount(rows * bits + at.ravel(), minlength=len(low) * bits) & 1
        return np.packbits(parity.astype(np.uint8).reshape(len(low), bits), axis=1).view(">i8").astype(np.int64)


def most_bits(threshold: float) -> int:
    """Set bits of two sketches' XOR beyond which a pair at the threshold is out of reach."""
    k, bits = BANDS * ROWS, SKETCH_WORDS * 64
    differing = k * (1 - threshold) + SLACK * (k * threshold * (1 - threshold)) ** 0.5
    expected = bits * (1 - (1 - 2 / bits) ** (2 * differing)) / 2
    return int(expected + SLACK * (bits / 4 * (1 - (1 - 4 / bits) ** (2 * differing))) ** 0.5)


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """(id, text) to (id, n_shingles, digest, bands, sketch); the digest stands for the whole set."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher(n)
        for whole in batches:
            for i in range(0, len(whole), TEXTS):
                batch = whole.iloc[i : i + TEXTS]
                out = pd.DataFrame({"id": batch["id"].array})
                low = np.empty((len(batch), BANDS * ROWS), np.uint64)
                sizes, digests = [], []
                for k, t in enumerate(batch["text"]):
                    s = sketcher.distinct(t)
                    low[k] = sketcher.minima(s)
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out["n_shingles"], out["digest"] = sizes, digests
                out["bands"] = list(sketcher.bands(low))
                out["sketch"] = list(sketcher.sketches(low))
                yield out

    # Ids go through as text: pandas would make doubles of whole numbers beside nulls, which round large ones.
    out = docs.withColumn("id", F.col("id").cast("string")).mapInPandas(trimmed(work), "id string, n_shingles long, digest binary, bands array<long>, sketch array<long>")
    return out.withColumn("id", F.col("id").cast("long"))


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes are similar enough, by whole numbers."""
    if percent * max(len(p), len(q)) > 100 * min(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough.

    Members of a hub ``b`` are dealt into blocks, and the hub's text goes to each block
    once, ahead of its members' texts: a task reads one text after the other and keeps
    the hub's set only.
    """
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = spread_join(pairs, sizes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.col("a").alias("node"))
    hubs = dealt.select("b", "block", F.col("b").alias("node")).distinct()
    rows = dealt.unionByName(hubs).join(texts.withColumnRenamed("id", "node"), "node")
    rows = rows.select("b", "block", (F.col("node") != F.col("b")).alias("member"), "node", "text")
    rows = rows.repartition("b", "block").sortWithinPartitions("b", "block", "member")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher, key, hub = Sketcher(n), None, []
        for batch in batches:
            good = []
            for b, block, member, node, text in batch.itertuples(index=False, name=None):
                if (b, block) != key:
                    key, hub = (b, block), []
                own = sketcher.distinct(text)
                if not member:
                    hub.append(own)
                elif any(similar(own, h, percent) for h in hub):
                    good.append((node, b))
            yield pd.DataFrame(good, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(trimmed(work), "a long, b long")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key of a stream that is sorted by them, in frames of whole groups."""
    rest = None
    for batch in batches:
        whole = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(whole):
            continue
        k = whole[keys].to_numpy()
        starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(axis=1)))
        for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield whole.iloc[a:z]
        rest = whole.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None:
        yield rest


def _near(batch: pd.DataFrame, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a pair of blocks the later rows whose sketches are close and whose components differ."""
    sketches = np.array(batch["sketch"].tolist(), np.int64).view(np.uint64)
    cross = batch["i"].iloc[0] != batch["j"].iloc[0]
    own, comp = batch["own"].to_numpy(), batch["comp"].to_numpy()
    for x in range(len(batch) - 1):
        near = comp[x + 1 :] != comp[x]
        if cross:
            near &= own[x + 1 :] != own[x]
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(sketches[x + 1 + at] ^ sketches[x]).sum(axis=1) <= limit] if len(at) else at
        if len(at):
            yield x, at + x + 1


_PAIR = ["bucket", "i", "j"]
_KEYS = "bucket long, i int, j int, own int, node long, comp long, sketch array<long>"


def _rest(members: DataFrame, comp: DataFrame, sketches: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between components that still share a bucket.

    Each bucket that holds several components is dealt into blocks, and each pair of its blocks is a task of bounded
    size; of buckets with the same members one is enough. At first only keys and sketches
    go there: documents of different components whose sketches are close stay. Texts are then fetched for
    those alone, and full sets compared where sketches are close and nothing links the two yet. A pair of blocks returns a
    spanning forest of its links, never pairs.
    """
    now = table(members.join(comp, "node"), "members-now")
    marks = now.groupBy("bucket").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("y"),
    ).where("lo <> hi")
    marks = marks.groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "size")).alias("m"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m.size") / BLOCK_SHINGLES)).cast("int")
    marks = marks.select("m.bucket", blocks.alias("blocks"))
    rows = table(spread_join(now, marks, "bucket").join(sketches, "node"), "mixed")
    if rows.isEmpty():
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    rows = rows.withColumn("b", F.explode(others)).select("bucket", "b.i", "b.j", "own", "node", "comp", "sketch")
    limit = most_bits(percent / 100)

    def live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for batch in _groups(batches, _PAIR):
            keep = np.zeros(len(batch), bool)
            for x, ys in _near(batch, limit):
                keep[x] = keep[ys] = True
            out.append(batch[keep])
            if sum(map(len, out)) >= 4 * BLOCK:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    dealt = lambda r: r.repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    rows = table(dealt(rows).mapInPandas(trimmed(live), _KEYS), "live")
    if rows.isEmpty():
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
    rows = rows.join(texts.withColumnRenamed("id", "node"), "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher(n)
        for batch in _groups(batches, _PAIR):
            texts_, sets, out = batch["text"].tolist(), {}, []
            _, root = np.unique(batch["comp"].to_numpy(), return_inverse=True)
            nodes = batch["node"].to_numpy()

            def full(k: int, texts_=texts_, sets=sets) -> np.ndarray:
                if k not in sets:
                    sets[k] = sketcher.distinct(texts_[k])
                return sets[k]

            for x, ys in _near(batch, limit):
                for y in ys.tolist():
                    if root[x] != root[y] and similar(full(x), full(y), percent):
                        out.append((nodes[x], nodes[y]))
                        root[root == root[y]] = root[x]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return table(dealt(rows).mapInPandas(trimmed(compare), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept): classes of documents that similarity of shingle sets links.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their
    sets of ``n``-word shingles; a component's id is its smallest document.
    Documents with equal sets form one class that its smallest id stands for.
    Classes that share a bucket of a band are compared with the bucket's hub, by
    odd sketch first and then on their full sets of 64-bit shingle hashes. A bucket whose members all reach one
    component needs nothing more; in others, another hub is tried, and then members
    that are still in different components are compared in blocks, so that no link
    between two components goes unseen. Pairs of texts are made in proportion to the
    members of a bucket only; blocks compare sketches of all members of a bucket that stays mixed.

    An empty table gives no rows; a very long text is one set, held whole by the task that reads it.
    Null or empty texts have empty sets and are linked with nothing. Null ids keep
    their row, with a null component and kept true; they link nothing. Rows that repeat an id
    and text get the same result; rows of one id with different texts count as one
    document that has the links of each. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of().alias("text"))
    marks = table(sketch(rows, n), "sketches")
    real = marks.where("id is not null and n_shingles > 0")
    # Equal digests mean equal sets, bands and sketches, so any row's stand for the class.
    classes = table(real.groupBy("digest").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    sketches = classes.select("node", "sketch")
    # A bucket's hash tells its band; sketches stay behind until pairs are known.
    members = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    members = table(members.join(shared.select("bucket"), "bucket"), "members")

    # Only texts of documents that share a bucket are ever compared.
    nodes = table(members.select("node").distinct(), "nodes")
    texts = table(rows.where("id is not null").join(nodes, F.col("id") == F.col("node"), "left_semi"), "texts")
    limit = most_bits(percent / 100)
    xor = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # Ids with several classes link these.
    links = real.select("id", "digest").join(classes.select("digest", "node"), "digest").where("id <> node")
    links = table(links.select(F.col("id").alias("a"), F.col("node").alias("b")).distinct(), "links")
    found, tried = None, None
    comp = nodes.withColumn("comp", F.col("node"))
    for r in range(STAR_ROUNDS):
        now = members.join(comp, "node") if r else members.withColumn("comp", F.col("node"))
        key = F.struct(F.xxhash64("node", F.lit(r)) if r else F.lit(0).cast("long"), "node", "comp")
        hubs = now.groupBy("bucket").agg(F.min(key).alias("hub"))
        pairs = now.join(hubs, "bucket").where("comp <> hub.comp")
        pairs = pairs.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, (F.least(pairs.a, pairs.b) == tried.lo) & (F.greatest(pairs.a, pairs.b) == tried.hi), "left_anti")
        # The hubs' sketches come first, to keys alone: a common hub's stay where its pairs are.
        pairs = spread_join(table(pairs, "hub-pairs"), sketches.toDF("b", "sb"), "b").join(sketches.toDF("a", "sa"), "a")
        pairs = pairs.where(xor(F.col("sa"), F.col("sb")) <= limit).select("a", "b")
        pairs = table(pairs, "pairs")
        if pairs.isEmpty():
            continue
        touched = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        good = table(_verified(pairs, texts.join(touched, "id", "left_semi"), n, percent), "links")
        found = good if found is None else found.unionByName(good)
        done = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        tried = done if tried is None else tried.unionByName(done)
        whole = components(found)
        comp = nodes.join(whole, "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
        comp = table(comp, "comp")
    edges = links if found is None else links.unionByName(found)
    edges = edges.unionByName(_rest(members, comp, sketches, texts, n, percent))
    whole = table(components(edges), "components")
    out = marks.join(whole, marks.id == whole.node, "left").select("id", "n_shingles", F.when(F.col("n_shingles") >= 0, F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
