"""Postings of documents that keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from termspire.sources.corpus import postings


def stream_postings(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's postings under ``batch=N``; a repeated batch overwrites its own folder, so each counts once."""

    def put(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
