"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and set, so that later
    calls find the same one; that is right on a single machine only, so a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="termspire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: what is read back survives the loss of any executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return at(df, path)


def at(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` with the schema of ``df``."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files below ``path``: another text after any change."""
    p, fs = _path(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(found))


def names(spark: SparkSession, path: str) -> list[str]:
    """The files and folders in a folder; none if it isn't there."""
    p, fs = _path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file as a whole, unless there is one already."""
    p, fs = _path(spark, path)
    if fs.exists(p):
        return False
    draft = p.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    # A rename never replaces a file on stores that follow Hadoop's rules.
    done = not fs.exists(p) and fs.rename(draft, p)
    if not done:
        fs.delete(draft, False)
    return done


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    p, fs = _path(spark, path)
    size = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    try:
        return bytes(b & 0xFF for b in spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size))).decode()
    finally:
        stream.close()
