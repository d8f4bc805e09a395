"""WARC archive files: monolithic gzip streams rewritten as one member a record, with an offset index."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.llm import files
from termspire.llm.common import remove, spread_join, table
from termspire.sources.store import fresh_path

#: Payloads below this size are never revisits.
LEAST = 1000
#: Uncompressed bytes after which an archive is closed, and how much is inflated at once.
ARCHIVE, PIECE = 8 << 20, 1 << 18
_END = b"\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    text = uri[len("<urn:page:") : -1]
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    """A WARC/1.1 record; a revisit has headers only, the length and digest of its payload among them."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + _END + body + _END


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of an uncompressed WARC stream that comes in pieces."""
    buf = bytearray()
    more = True

    def fill() -> bool:
        nonlocal more
        piece = next(pieces, None)
        more = piece is not None
        buf.extend(piece or b"")
        return more

    while True:
        while not buf and more:
            fill()
        if not buf:
            return
        seen = 0
        while (at := buf.find(_END, max(0, seen - 3))) < 0:
            seen = len(buf)
            if not fill():
                raise ValueError("the stream ends inside a record's headers")
        lines = bytes(buf[:at]).decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        need = at + 4 + int(head["Content-Length"]) + 4
        while len(buf) < need:
            if not fill():
                raise ValueError("the stream ends inside a record")
        if buf[need - 4 : need] != _END:
            raise ValueError("a record's length is wrong")
        yield head, bytes(buf[:need])
        del buf[:need]


def inflate(data: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file that comes in pieces, in pieces of bounded size: of one member, or of several in a row."""
    z = None
    for rest in data:
        while rest or (z is not None and z.unconsumed_tail):
            z = z or zlib.decompressobj(31)
            piece = z.decompress(rest, PIECE)
            rest = z.unconsumed_tail or z.unused_data
            if piece:
                yield piece
            if z.eof:
                z = None
    if z is not None:
        while piece := z.decompress(z.unconsumed_tail, PIECE):
            yield piece
        if not z.eof:
            raise ValueError("a gzip member isn't complete")


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise(data: Iterator[bytes]) -> Iterator[tuple[bytes, tuple[str, int, int, int]]]:
    """A gzip file of records, whatever its members, as one member a record.

    The stream is inflated once, piece by piece. Yields each member of the new file with its
    line of the index: (record id, offset, length, uncompressed length).
    """
    at = 0
    for head, whole in records(inflate(data)):
        member = _gzip(whole)
        yield member, (head["WARC-Record-ID"], at, len(member), len(whole))
        at += len(member)


def index_line(entry: tuple[str, int, int, int]) -> str:
    return json.dumps(dict(zip(("record", "offset", "length", "size"), entry, strict=True))) + "\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Files ``<name>.warc.gz`` in ``folder``, each one gzip stream over a record per page; returns (archive, path, size).

    Of pages with equal payloads of at least LEAST bytes the one with the largest id is the
    response and the others revisit it; null ids are smaller than all others, and rows that share the
    largest id are responses all. Null html is the empty payload; a very long one is one record, held whole. Only
    digests and ids are aggregated: a common page's digest goes to its copies, which stay where they are and
    are never gathered with their payloads. An empty table writes no file.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    sums = rows.where(F.octet_length("payload") >= LEAST).select("page_id", "digest").groupBy("digest")
    sums = table(sums.agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1").drop("n"), "digests")
    rows = spread_join(rows, sums, "digest", "left")
    rows = rows.withColumn("kind", F.when(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))) < F.col("first"), "revisit").otherwise("response"))
    rows = rows.withColumn("first", F.when(F.col("kind") == "revisit", F.col("first")))
    # A revisit's own bytes are needed for its length only.

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda v: None if pd.isna(v) else int(v)
        z, size, parts, name = zlib.compressobj(6, zlib.DEFLATED, 31), 0, [], hashlib.sha1()

        def close() -> pd.DataFrame:
            path = f"{folder}/{name.hexdigest()}.warc.gz"
            return pd.DataFrame({"archive": [name.hexdigest()], "path": [path], "size": [files.put(path, [*parts, z.flush()])]})

        for batch in batches:
            for key, url, payload, digest, first, what in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "first", "kind")), strict=True):
                whole = record(none(key), url, bytes(payload), digest, none(first), what)
                parts.append(z.compress(whole))
                name.update(whole)
                size += len(whole)
                if size >= ARCHIVE:
                    yield close()
                    z, size, parts, name = zlib.compressobj(6, zlib.DEFLATED, 31), 0, [], hashlib.sha1()
        if size:
            yield close()

    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("first").cast("string").alias("first"), "kind")
    return rows.mapInPandas(work, "archive string, path string, size long")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Each file of ``archives`` again in ``folder`` with a member per record, and beside it ``<name>.idx``, its offset index.

    Returns (archive, path, index_path, n_records, size). Neither the old file nor the new one is ever whole in memory.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, old in zip(batch["archive"], batch["path"], strict=True):
                path, lines = f"{folder}/{name}.warc.gz", []

                def members(old=old, lines=lines) -> Iterator[bytes]:
                    for member, entry in normalise(files.pieces(old)):
                        lines.append(index_line(entry))
                        yield member

                size = files.put(path, members())
                files.put(f"{folder}/{name}.idx", (line.encode() for line in lines))
                yield pd.DataFrame({"archive": [name], "path": [path], "index_path": [f"{folder}/{name}.idx"], "n_records": [len(lines)], "size": [size]})

    return archives.mapInPandas(work, "archive string, path string, index_path string, n_records long, size long")


def read_index(index_path: str) -> list[dict]:
    return [json.loads(line) for line in b"".join(files.pieces(index_path)).splitlines()]


def read_record(file: files.Reader, entry: dict) -> tuple[dict[str, str], bytes]:
    """(headers, whole record) of an index entry: one seek, one member."""
    ((head, whole),) = records(inflate(iter([file.at(entry["offset"], entry["length"])])))
    if head["WARC-Record-ID"] != entry["record"] or len(whole) != entry["size"]:
        raise ValueError("the index doesn't match the archive")
    return head, whole


def read_archives(archives: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row per record: (id, url, record_type, payload_bytes, payload_digest, refers_to, payload).

    Records are sought in the files by the sidecar index, each inflated by itself; digests of responses
    are computed from what is read, and a wrong one fails the job. A
    revisit's payload is null. Rows leave an archive some PIECE bytes of payload at a time.
    """

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = dict(zip(("id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"), map(list, zip(*rows, strict=True)), strict=True))
        # Beside nulls pandas would make doubles of ids, which round large ones.
        return pd.DataFrame(out | {c: pd.array(out[c], "Int64") for c in ("id", "refers_to")})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, index_path in zip(batch["path"], batch["index_path"], strict=True):
                rows, size = [], 0
                with files.Reader(path) as file:
                    for entry in read_index(index_path):
                        head, whole = read_record(file, entry)
                        digest, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
                        if head["WARC-Type"] == "response":
                            n = int(head["Content-Length"])
                            payload = whole[len(whole) - 4 - n : len(whole) - 4]
                            if hashlib.sha1(payload).hexdigest() != digest or n != int(head["X-Payload-Length"]):
                                raise ValueError("a payload doesn't match its digest")
                        refers = _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                        rows.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], int(head["X-Payload-Length"]), digest, refers, payload))
                        size += len(payload or b"")
                        if size >= PIECE:
                            yield frame(rows)
                            rows, size = [], 0
                if rows:
                    yield frame(rows)

    shape = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return archives.mapInPandas(work, shape).withColumnRenamed("id", id_col)


def round_trip(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Pages written as monolithic archives, normalised to archives with sidecar indexes, and read back from these.

    All of them are files in the shared folder; the monolithic ones go once they're normalised.
    """
    spark = pages.sparkSession
    first, second = fresh_path(spark, "warc"), fresh_path(spark, "warc-members")
    whole = table(write_archives(pages, first, id_col), "warc-list")
    members = table(normalise_archives(whole, second), "warc-members-list")
    remove(spark, first)
    # An archive is a task's work, however few bytes its row of the list has.
    return read_archives(members.repartition(max(1, members.count())), id_col)
