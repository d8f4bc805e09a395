"""Media columns: FLAC streams of binary payloads, and PCM blocks read back from them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.llm import flac
from termspire.llm.common import in_frames, remove, table, text_of
from termspire.sources.store import fresh_path

#: Payload bytes that a worker encodes or decodes in one go.
GROUP = 1 << 20
#: Parts of the documents that are in the shared folder as media, one after another.
SLICES = 2


def _groups(column: pd.Series) -> Iterator[slice]:
    start, size = 0, 0
    for i, value in enumerate(column):
        size += len(value)
        if size >= GROUP:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(column):
        yield slice(start, len(column))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the UTF-8 of each text, zeros up to a positive multiple of 64, as a FLAC stream.

    Streams are 8-bit mono without wasted bits; a very long text is one stream of many frames. Null text is empty: 64
    zero bytes. Rows that repeat give equal streams; other columns are ignored; an empty table gives no rows.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = batch["text"].str.encode("utf-8")
            for part in _groups(raw):
                own = raw.iloc[part]
                media = flac.encode([b + b"\0" * (-len(b) % 64 or 64 * (not b)) for b in own])
                yield pd.DataFrame({"id": batch["id"].iloc[part], "n_bytes": own.map(len), "media": media})

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return in_frames(rows, work, f"id {dict(rows.dtypes)['id']}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def blocks(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sample_offset, n_samples, pcm): the PCM blocks of each stream, each seekable by its offset.

    Every checksum is verified; a damaged stream fails the job. Null media have no blocks.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _groups(batch["media"]):
                own = batch.iloc[part]
                rows = [
                    (key, at, len(pcm), pcm)
                    for key, found in zip(own["id"].array, flac.decode([bytes(m) for m in own["media"]]), strict=True)
                    for at, pcm in found
                ]
                yield pd.DataFrame(rows, columns=["id", "sample_offset", "n_samples", "pcm"])

    rows = media.where("media is not null").select(F.col(id_col).alias("id"), "media")
    shape = f"id {dict(rows.dtypes)['id']}, sample_offset long, n_samples long, pcm binary"
    return in_frames(rows, work, shape).withColumnRenamed("id", id_col)


def feature(samples: np.ndarray) -> str:
    """Mean, mean power, zero crossings in 10,000 and the peak, as integers of signed samples."""
    x = samples.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"{int(x.sum() * 1000 // len(x))}:{int((x * x).sum() // len(x))}:{crossings * 10_000 // len(x)}:{int(np.abs(x).max())}"


def pcm(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media_bytes, media_sha256, blocks): each stream decoded and verified, with its PCM blocks as an array of
    (sample_offset, n_samples, pcm) in order; a row for each row with media."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _groups(batch["media"]):
                own = batch.iloc[part]
                raw = [bytes(m) for m in own["media"]]
                found = [[{"sample_offset": at, "n_samples": len(b), "pcm": b} for at, b in x] for x in flac.decode(raw)]
                yield pd.DataFrame({
                    "id": own["id"], "n_bytes": own["n_bytes"], "media_bytes": [len(m) for m in raw],
                    "media_sha256": [hashlib.sha256(m).hexdigest() for m in raw], "blocks": found,
                })

    rows = media.where("media is not null").select(F.col(id_col).alias("id"), "n_bytes", "media")
    shape = (
        f"id {dict(rows.dtypes)['id']}, n_bytes long, media_bytes long, media_sha256 string, "
        "blocks array<struct<sample_offset: long, n_samples: long, pcm: binary>>"
    )
    return in_frames(rows, work, shape).withColumnRenamed("id", id_col)


def _digest(blocks_: list[tuple[int, bytes]]) -> tuple[int, str, int, str]:
    """(bytes, SHA-256, CRC-32 of the last 64, feature) of a payload from its PCM blocks; the end is sought by their offsets, and a gap raises."""
    whole, at = hashlib.sha256(), 0
    for offset, b in blocks_:
        if offset != at:
            raise ValueError("a block isn't where its offset says")
        whole.update(b)
        at += len(b)
    tail = b"".join(b[max(0, at - 64 - offset) :] for offset, b in blocks_ if offset + len(b) > at - 64)
    samples = (np.frombuffer(b"".join(b for _, b in blocks_), np.uint8) ^ 0x80).view(np.int8)
    return at, whole.hexdigest(), zlib.crc32(tail), feature(samples)


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Stored media read back into PCM blocks: payload and media digests and a feature string, a row for each row with media."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _groups(batch["media"]):
                own = batch.iloc[part]
                raw = [bytes(m) for m in own["media"]]
                out = []
                for key, n, m, found in zip(own["id"].array, own["n_bytes"], raw, flac.decode(raw), strict=True):
                    *sums, text = _digest(found)
                    out.append((key, n, *sums, len(m), hashlib.sha256(m).hexdigest(), text))
                yield pd.DataFrame(out, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.where("media is not null").select(F.col(id_col).alias("id"), "n_bytes", "media")
    shape = (
        f"id {dict(rows.dtypes)['id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return in_frames(rows, work, shape).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slices: int = SLICES) -> DataFrame:
    """:func:`digests` of every row's text after it was stored as media and read back.

    The media of a slice of the documents (by a hash of id and text) leave the shared folder before the next slice
    comes, so that they take a part of the input's room. Null text, empty and very long texts, repeated rows and empty
    tables are as in :func:`store`.
    """
    spark, out = docs.sparkSession, None
    own = F.pmod(F.xxhash64(id_col, text_col), F.lit(slices))
    for i in range(slices):
        path = fresh_path(spark, "media")
        store(docs.where(own == i), id_col, text_col).write.parquet(path)
        found = table(digests(spark.read.parquet(path), id_col), "digests")
        remove(spark, path)
        out = found if out is None else out.unionByName(found)
    return out
