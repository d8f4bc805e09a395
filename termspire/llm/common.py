"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from termspire.operators.joins import LIGHT, spread_join
from termspire.sources.store import remove, shared_dir, stored

__all__ = ["LIGHT", "in_frames", "in_order", "read", "remove", "share_bound", "shared_dir", "spread_join", "table", "text_of", "trimmed"]

#: Hash values that :func:`share_bound` divides.
SPACE = 1 << 62


def table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: :func:`termspire.sources.store.stored`."""
    return stored(df, name, compression)


def in_order(rows: DataFrame, name: str, *keys: Column) -> DataFrame:
    """``rows`` written in ranges of ``keys``, with ``_part``: the number of the range, which rises with the keys.

    Running sums over all rows can then be taken range by range: those inside a range by a window over
    (_part, keys), those before it by one row a range.
    """
    return table(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)


def share_bound(share: float) -> int:
    """The bound below which a share of the values of a hash in SPACE lies; never 0 for a positive share above 2e-19."""
    return min(SPACE, int(share * SPACE))


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function that, when its task ends, gives freed memory back to the system: workers live on to the next stage."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def in_frames(rows: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], shape: str) -> DataFrame:
    """``rows.mapInPandas(work, shape)`` in which whole numbers beside nulls stay whole: they come and go as pandas' Int64.

    Pandas would make them doubles, which round what lies beyond 2 ** 53.
    """
    schema = to_arrow_schema(StructType.fromDDL(shape))

    def frame(batch: pa.RecordBatch) -> pd.DataFrame:
        out = batch.to_pandas()
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if column.null_count and pa.types.is_integer(column.type):
                out[name] = pd.Series(pd.Int64Dtype().__from_arrow__(column.cast(pa.int64())), index=out.index)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(map(frame, batches)):
            yield from pa.Table.from_pandas(out, schema=schema, preserve_index=False).to_batches()

    return rows.mapInArrow(trimmed(run), shape)


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
