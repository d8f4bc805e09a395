"""Packing documents into fixed-length training sequences by length patterns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termspire.llm.common import in_frames, table, text_of
from termspire.llm.tokenizer import default_path, encoder

#: Rows of one length that are ranked together.
RANKED = 20_000


def tokenize(
    docs: DataFrame, id_col: str = "doc_id", path: str | None = None, max_len: int = 1024, end_id: int = 2, keep_ids: bool = False
) -> DataFrame:
    """Pieces of documents: (id, piece, start, length, ids_crc32[, ids]).

    A document is the ids of its text and ``end_id``. Longer ones than
    ``max_len`` are cut into pieces of ``max_len``; the first piece may be
    shorter. Null or empty text is ``end_id`` alone.
    """
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch["id"].array, batch["text"], strict=True):
                ids = enc.ids(text) + end
                n = len(ids) // 4
                stop = n % max_len or max_len
                start = piece = 0
                while start < n:
                    own = ids[4 * start : 4 * stop]
                    row = (key, piece, start, stop - start, zlib.crc32(own))
                    rows.append((*row, np.frombuffer(own, "<u4").astype(int)) if keep_ids else row)
                    start, stop, piece = stop, stop + max_len, piece + 1
            yield pd.DataFrame(rows, columns=names)

    source = docs.select(F.col(id_col).alias("id"), text_of().alias("text"))
    kind = dict(source.dtypes)["id"]
    shape = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return in_frames(source, cut, shape).withColumnRenamed("id", id_col)


def patterns(counts: dict[int, int], max_len: int, spread: int = 8) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths that occur and fill ``max_len`` as far as they can.

    For a length the pairs hold its longest partners that fit, and the triples
    ``spread`` middle lengths with the longest third. Their number is bounded by
    ``max_len`` times a constant, whatever the data.
    """
    have = np.array(sorted(n for n, c in counts.items() if c > 0 and n < max_len))
    found: set[tuple[int, ...]] = set()

    def longest(room: int) -> int:
        k = int(np.searchsorted(have, room, side="right"))
        return int(have[k - 1]) if k else 0

    for a in map(int, have):
        if b := longest(max_len - a):
            found.add(tuple(sorted((a, b), reverse=True)))
        rooms = have[have <= (max_len - a)]
        for b in map(int, rooms[np.unique(np.linspace(0, len(rooms) - 1, spread).astype(int))] if len(rooms) else ()):
            if c := longest(max_len - a - b):
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(found)


def repeats(found: list[tuple[int, ...]], counts: dict[int, int], max_len: int, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: how often to repeat each pattern so that their lengths meet the histogram.

    Accelerated projected gradient on the normal equations; a pattern's column
    holds how often it uses a length.
    """
    if not found:
        return np.zeros(0)
    which = np.repeat(np.arange(len(found)), [len(p) for p in found])
    lengths = np.concatenate([np.array(p) for p in found])
    h = np.zeros(max_len + 1)
    for n, c in counts.items():
        h[n] = c
    use = lambda x: np.bincount(lengths, x[which], max_len + 1)
    back = lambda r: np.bincount(which, r[lengths], len(found))
    v = np.ones(len(found))
    for _ in range(30):  # the largest eigenvalue gives the step
        v = back(use(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(use(y) - h) / top)
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


def solve(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; all of ``counts`` is used.

    Fitted repeats are rounded and held to what is there. Patterns that don't fill ``max_len`` keep their part of the fit, so that the
    others aren't repeated too often, but make no sequences: best fit uses the room that they would waste. What is left over
    is packed by best fit, longest first, on counts instead of single pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan: list[tuple[tuple[int, ...], int]] = [((max_len,), left.pop(max_len))] if max_len in left else []
    found = patterns(left, max_len)
    x = repeats(found, left, max_len)
    full = np.array([sum(p) for p in found]) if found else np.zeros(0)
    for i in np.lexsort((-x, -full)):
        # Of a fit's mass on sf0.01 a third is in loose patterns; their pieces go to best fit.
        if full[i] < max_len:
            break
        need = {n: found[i].count(n) for n in found[i]}
        if (m := min(int(round(x[i])), *(left.get(n, 0) // k for n, k in need.items()))) > 0:
            plan.append((found[i], m))
            for n, k in need.items():
                left[n] -= m * k
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            room = min((r for r in bins if r >= n), default=None)
            if room is None:
                each = max_len // n
                groups = [(each, c // each), (c % each, 1)]
                for k, m in groups:
                    if k and m:
                        bins.setdefault(max_len - n * k, []).append(((n,) * k, m))
                break
            had, m = bins[room].pop()
            if not bins[room]:
                del bins[room]
            each = min(room // n, c)
            used = min(m, c // each)
            if used < m:
                bins.setdefault(room, []).append((had, m - used))
            bins.setdefault(room - n * each, []).append((had + (n,) * each, used))
            c -= used * each
    return plan + [g for groups in bins.values() for g in groups]


def pack(pieces: DataFrame, max_len: int = 1024, keys: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """``pieces`` with ``length`` (1 to ``max_len``) plus sequence_id and offset.

    The histogram of lengths has at most ``max_len`` rows; the driver fits
    patterns to it and nothing else. Pieces get ranks among those of their
    length: hash buckets of about RANKED rows are ranked each for themselves and
    moved by the counts before them, so a length that holds a third of all rows
    is no large group. A rank's place in the plan is found by binary search in
    arrays whose size depends on ``max_len`` only. An empty table gives no rows.
    """
    pieces = table(pieces, "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = solve(counts, max_len)
    at: dict[int, int] = dict.fromkeys(counts, 0)
    rows, base = [], 0
    for lengths, m in plan:
        offset = 0
        for n in lengths:
            rows.append((n, at[n], base, offset))
            at[n] += m
            offset += n
        base += m
    rows.sort()
    flat = np.array(rows, np.int64).reshape(-1, 4)
    starts = flat[:, 0] << 48 | flat[:, 1]

    buckets = max(1, -(-max(counts.values(), default=1) // RANKED))
    order = [F.col(k) for k in keys]
    split = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = split.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select(
        "length", "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    ranked = split.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select(*pieces.columns, F.col("rank").cast("long"))
    names = pieces.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("rank").to_numpy()
            k = np.searchsorted(starts, batch["length"].to_numpy() << 48 | rank, side="right") - 1
            batch["sequence_id"] = flat[k, 2] + rank - flat[k, 1]
            batch["offset"] = flat[k, 3]
            yield batch[[*names, "sequence_id", "offset"]]

    shape = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return in_frames(ranked, place, f"{shape}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", path: str | None = None, max_len: int = 1024, end_id: int = 2) -> DataFrame:
    """All documents as packed pieces; nulls, empty texts and repeated rows are documents like any other.

    A very long text is many pieces; ties of equal lengths are ranked by hash and keys; an empty table gives no rows; columns of
    other names are ignored.
    """
    cut = tokenize(docs, id_col, path, max_len, end_id)
    return pack(cut, max_len, (id_col, "piece", "start", "ids_crc32"))
