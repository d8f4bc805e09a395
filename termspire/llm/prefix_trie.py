"""Prefix trie of conversations: radix partitioning by turn ids, then multikey quicksort in each bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.llm.common import in_order, spread_join, table, trimmed
from termspire.llm.components import drop

#: Turns that the conversations of a bucket may have before the bucket is dealt out by further turns.
LOCAL = 20_000
#: Ids of members that are joined to one text before it is hashed.
CHUNK = 500
_NODE = (
    "key binary, up binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "end_id long, whole boolean, joins boolean, own_tokens long"
)


def sequences(turns: DataFrame, conv_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(conversations, dictionary): (conv_id, turns: array of (id, size)) and (key, id, size), for each distinct (role, text).

    ``size`` is the UTF-8 bytes of the text. Turns are ordered by ``turn``, null first, ties by role and text. Null role and text are
    empty; rows without a conversation's id are left out. Texts are told by 128 bits, so
    that they are shuffled only where a conversation has several of one turn number.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    hashed = lambda i: F.lpad(F.hex(F.xxhash64(F.lit(i), "role", "text")), 16, "0")
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col("turn").cast("long").alias("t"), empty("role").alias("role"), empty("text").alias("text"))
    rows = rows.withColumns({"key": F.concat(hashed(0), hashed(1)), "size": F.octet_length("text").cast("long")})
    narrow = table(rows.select("c", "t", "key", "size"), "turns")
    words = narrow.groupBy("key").agg(F.first("size").alias("size"))
    words = table(words.withColumn("id", F.monotonically_increasing_id()), "turn-dictionary")
    tied = narrow.groupBy("c", "t").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("c", F.col("t").alias("tied"))
    tied = table(tied, "tied-turns")
    same = (F.col("c") == F.col("d")) & F.col("t").eqNullSafe(F.col("tied"))
    d = tied.withColumnRenamed("c", "d")
    placed = narrow.select("c", "t", "key", F.lit(1).alias("rank"))
    if not tied.isEmpty():
        rank = F.dense_rank().over(Window.partitionBy("c", "t").orderBy("role", "text"))
        ranked = rows.join(d, same, "left_semi").select("c", "t", "key", rank.alias("rank"))
        placed = table(narrow.join(d, same, "left_anti").select("c", "t", "key", F.lit(1).alias("rank")).unionByName(ranked), "placed-turns")
    placed = spread_join(placed, words, "key")
    order = F.sort_array(F.collect_list(F.struct("t", "rank", "id", "size")))
    return placed.groupBy("c").agg(order.alias("s")).select(F.col("c").alias("conv_id"), F.transform("s", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("turns")), words


def share_prefixes(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """``conversations`` rebuilt: the first h turns are those of conversation c - c % ``group``, h = crc32(c) % ``most``."""
    own = conversations.withColumn("h", (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int"))
    given = conversations.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("given"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(given, "base", "left")
    first = F.coalesce(F.slice("given", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.select("conv_id", F.concat(first, rest).alias("turns"))


def _prefix(ids: list[int], depth: int) -> bytes:
    return hashlib.blake2b(b"".join(i.to_bytes(8, "little", signed=True) for i in ids[:depth]), digest_size=16).digest()


def _radix(rows: DataFrame, local: int) -> DataFrame:
    """``rows`` (ids, ...) with ``own``, the depth of its bucket: all sequences that agree in the first ``own`` ids are in one bucket.

    A bucket of more than ``local`` turns is dealt out by further ids, twice as many each time, so there are as many rounds as the
    longest depth has bits; rows of buckets that are small enough are left alone. Different sequences part at their last id, at the latest.
    """
    bucket = F.when(F.col("own") > 0, F.xxhash64(F.col("own"), F.slice("ids", F.lit(1), F.col("own")))).otherwise(F.lit(0).cast("long"))
    keyed = lambda df: df.withColumn("bucket", bucket)
    done, rows = None, table(keyed(rows.withColumn("own", F.lit(0))), "buckets")
    while True:
        sizes = rows.where(F.size("ids") >= F.col("own")).groupBy("bucket").agg(F.sum(F.size("ids") + 1).alias("m"), F.count("*").alias("k"))
        large = table(sizes.where((F.col("m") > local) & (F.col("k") > 1)).select("bucket", F.lit(True).alias("large")), "large-buckets")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = spread_join(rows, large, "bucket", "left")
        small = table(marked.where("large is null").drop("large"), "small-buckets")
        done = small if done is None else done.unionByName(small)
        old, rows = rows, table(keyed(marked.where("large").drop("large").withColumn("own", F.greatest(F.lit(1), F.col("own") * 2))), "buckets")
        drop(old)


def _grow(group: pa.Table) -> pa.Table:
    """The nodes of a shard's sequences, parents first.

    Multikey quicksort: rows that agree in ``depth`` ids are parted by the id that follows into smaller, equal and larger
    ones; equal ones are a node's rows and go on with the next id. A node is ``whole`` if all of its sequences are here; others are
    summed up over shards, and so have their counts of what whole nodes below them hold only.
    """
    ids, sizes, n, cid, own = (group.column(c).to_pylist() for c in ("ids", "sizes", "n", "cid", "own"))
    nodes: list[list] = []  # depth, parent, rows, least id, tokens of the last turn, end, whole
    # A node's rows with its depth and parent; or rows that agree in depth ids and are to be parted by the next.
    todo: list[tuple] = [(list(range(len(ids))), 0, -1, True)] if ids else []
    while todo:
        rows, depth, parent, is_node = todo.pop()
        if is_node:
            at = len(nodes)
            ends = [r for r in rows if len(ids[r]) == depth]
            last = sizes[rows[0]][depth - 1] if depth else 0
            nodes.append([depth, parent, rows[0], sum(n[r] for r in rows), min(cid[r] for r in rows), last, cid[ends[0]] if ends else None, own[rows[0]] <= depth])
            rest = [r for r in rows if len(ids[r]) > depth]
            if rest:
                todo.append((rest, depth, at, False))
            continue
        pivot = ids[rows[len(rows) // 2]][depth]
        less, equal, more = [], [], []
        for r in rows:
            x = ids[r][depth]
            (less if x < pivot else more if x > pivot else equal).append(r)
        todo += [(part, depth, parent, False) for part in (less, more) if part]
        todo.append((equal, depth + 1, parent, True))
    kids, leaves, saved = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for at in range(len(nodes) - 1, -1, -1):
        depth, parent, _, count, _, last, _, whole = nodes[at]
        if whole:
            leaves[at] = leaves[at] or 1
            saved[at] += (count - 1) * last
            if parent >= 0:
                kids[parent] += 1  # those of top nodes are counted again once shards are merged
                leaves[parent] += leaves[at]
                saved[parent] += saved[at]
    out = []
    for at, (depth, parent, row, count, least, last, end, whole) in enumerate(nodes):
        joins = whole and parent >= 0 and not nodes[parent][7]
        key = None if whole else _prefix(ids[row], depth)
        up = _prefix(ids[row], depth - 1) if depth and (joins or not whole) else None
        above = nodes[parent][4] if parent >= 0 and not joins else None
        out.append((key, up, depth, least, above, count, kids[at], leaves[at], saved[at], end, whole, joins, last))
    schema = pa.schema([
        ("key", pa.binary()), ("up", pa.binary()), ("depth", pa.int32()), *((c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_id")),
        ("whole", pa.bool_()), ("joins", pa.bool_()), ("own_tokens", pa.int64()),
    ])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _merge(nodes: DataFrame) -> DataFrame:
    """``nodes`` with those that several shards have parts of summed up, and their subtrees' sums taken.

    Top nodes add up what is below them by doubling: after i rounds a node's sums cover 2 ** i levels below it, and it knows
    its ancestor 2 ** i levels up. All of it is joins and sums of top nodes, a row each.
    """
    top = nodes.where(~F.col("whole"))
    if top.isEmpty():
        return nodes.drop("key", "up", "joins", "own_tokens", "whole")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens")]
    top = top.groupBy("key").agg(F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("own_tokens").alias("own_tokens"), F.min("conv_id").alias("conv_id"), F.max("end_id").alias("end_id"), *sums)
    top = table(top, "top-nodes")
    links = top.select("up").unionByName(nodes.where("joins").select("up")).where("up is not null")
    kids = links.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    top = top.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    top = table(top.withColumns({"leaves": F.col("n_leaves") + leaf, "saved": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("own_tokens")}), "top-nodes")
    reach = table(top.select("key", F.col("up").alias("jump"), "leaves", "saved"), "reach")
    while not reach.where("jump is not null").isEmpty():
        below = reach.where("jump is not null").groupBy(F.col("jump").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        next_up = reach.select(F.col("key").alias("jump"), F.col("jump").alias("next"))
        on = reach.join(below, "key", "left").join(next_up, "jump", "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        old, reach = reach, table(on.select("key", F.col("next").alias("jump"), plus("leaves", "l"), plus("saved", "s")), "reach")
        drop(old)
    above = top.select(F.col("key").alias("up"), F.col("conv_id").alias("above"))
    columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_id"]
    merged = top.drop("n_leaves", "saved_tokens").join(reach.select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "key")
    merged = table(merged, "top-nodes").join(above, "up", "left").withColumn("parent_conv_id", F.col("above")).select(columns)
    hung = spread_join(nodes.where("joins"), above, "up").withColumn("parent_conv_id", F.col("above")).select(columns)
    return nodes.where("whole and not joins").select(columns).unionByName(hung).unionByName(merged)


def _member_hashes(members: DataFrame) -> DataFrame:
    """(end_id, hash) of ``members`` (end_id, conv_id): SHA-256 of the ids in order, joined by commas.

    Ids are sorted in ranges over all groups and joined a chunk at a time; only then do a group's chunks meet, streaming past one hash.
    """
    rows = in_order(members, "members", F.col("end_id"), F.col("conv_id"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("end_id", "conv_id"))
    rows = rows.withColumn("chunk", F.floor(place / CHUNK))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = rows.groupBy("end_id", "_part", "chunk").agg(text.alias("text")).repartition("end_id").sortWithinPartitions("end_id", "_part", "chunk")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("end_id", pa.int64()), ("hash", pa.string())])
        now, state = None, None
        for batch in batches:
            done = []
            for end, text in zip(batch.column("end_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if end != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = end, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_pydict({"end_id": [d[0] for d in done], "hash": [d[1] for d in done]}, shape)
        if state:
            yield pa.RecordBatch.from_pydict({"end_id": [now], "hash": [state.hexdigest()]}, shape)

    return chunks.select("end_id", "text").mapInArrow(trimmed(fold), "end_id long, hash string")


def trie(conversations: DataFrame, local: int | None = None) -> DataFrame:
    """Nodes of the prefix trie of ``conversations`` (conv_id, turns: array of (id, size)), in the columns of :func:`build`.

    Equal conversations are one sequence with a count, so copies cost nothing further on. Sequences are dealt to buckets by
    their leading turn ids, see :func:`_radix`, buckets to shards by a hash, and :func:`_grow` makes the nodes of a shard. Nodes
    above a bucket have parts in several shards, which :func:`_merge` joins.
    """
    local = local or LOCAL
    convs = table(conversations.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes")), "rebuilt")
    same = F.struct(F.size("ids").alias("l"), F.xxhash64("ids").alias("h"), F.xxhash64(F.lit(1), "ids").alias("g"))
    convs = convs.withColumn("same", same)
    unique = convs.groupBy("same").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("cid"))
    unique = table(unique, "sequences")
    several = unique.where("n > 1").select("same", F.col("cid").alias("end_id"))
    hashes = _member_hashes(spread_join(convs.select("same", "conv_id"), several, "same").select("end_id", "conv_id"))
    hashes = table(hashes.withColumnRenamed("hash", "many"), "member-hashes")
    rows = _radix(unique.select("ids", "sizes", "n", "cid"), local)
    weight = rows.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("bucket"), F.lit(-(-weight // local) or 1)).cast("int")
    nodes = table(rows.withColumn("shard", shard).groupBy("shard").applyInArrow(_grow, _NODE), "nodes")
    out = table(_merge(nodes), "trie")
    ended = out.where("end_id is not null").join(hashes, "end_id", "left")
    out = ended.unionByName(out.where("end_id is null").withColumn("many", F.lit(None).cast("string")))
    one = F.when(F.col("end_id").isNull(), F.sha2(F.lit(""), 256)).otherwise(F.sha2(F.col("end_id").cast("string"), 256))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("many", one).alias("ends_sha256"))


def build(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    conv_id is the smallest member's, parent_conv_id the parent's (null for the root), n_convs counts members; n_children, n_leaves
    and saved_tokens (bytes of turns that all but one member needn't be computed again for) take the subtree in; ends_sha256 tells the members that end here.

    Awkward rows as :func:`sequences` states; a repeated row is a turn of its own; a % b has the sign of a; columns of other names are
    ignored; an empty table has no node. A conversation's turn ids are held as one array; its texts aren't.
    """
    return trie(share_prefixes(sequences(turns, conv_col)[0]))
