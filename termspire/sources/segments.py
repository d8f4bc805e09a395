"""The index: tables dealt by document or term into buckets, in segments that are written once and merged later.

Postings, lengths and models are bucketed by document, statistics by term, so whatever is counted or joined by a document or a
term reads its side of the index without a shuffle. Added documents are a new segment; ones that they replace, or that
are deleted, stay in the old files and are left out by a tombstone until segments are merged. A commit names the
segments and tombstones that count: one small file, made only if nobody else has made the same one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, replace
from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termspire.functions.analysis import simple_tokens
from termspire.sources import store
from termspire.sources.corpus import FIELDS, postings

Tokens = Callable[[Column], Column]
#: Each table: the column that its buckets are by, the order inside a bucket, and its columns (``id`` is the documents' type).
TABLES = {
    "postings": ("doc_id", "term", "doc_id id, field STRING, term STRING, tf BIGINT, positions ARRAY<INT>, len BIGINT"),
    "models": ("doc_id", "term", "doc_id id, term STRING, mtf BIGINT"),
    "lengths": ("doc_id", "field", "doc_id id, field STRING, len BIGINT"),
    "field_terms": ("term", "term", "field STRING, term STRING, tf BIGINT, df BIGINT"),
}
#: Documents and bytes of text that a bucket is meant to have, at most: a task sorts and counts a bucket's postings, and adds up
#: its documents' pairs with queries, in memory.
BUCKET, BUCKET_BYTES = 5_000, 8 << 20
#: Buckets that Spark allows, unless it's told otherwise.
MOST_BUCKETS = 100_000
#: How many times its buckets an index must need for a merge to deal it anew.
OUTGROWN = 1.5


class Conflict(Exception):
    """Another writer has committed first."""


@dataclass(frozen=True)
class Commit:
    """What counts: segments in the order they came, those of them that tombstones reach into, and the tombstones."""

    version: int
    buckets: int
    id_type: str
    next_number: int = 0
    segments: tuple[str, ...] = ()
    dirty: tuple[str, ...] = ()
    deleted: tuple[str, ...] = ()


def latest(spark: SparkSession, path: str) -> Commit | None:
    """The last commit; None where there's no index."""
    names = [n for n in store.names(spark, f"{path}/commits") if n.endswith(".json")]
    if not names:
        return None
    values = json.loads(store.read_text(spark, f"{path}/commits/{max(names)}"))
    return Commit(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def _commit(spark: SparkSession, path: str, new: Commit) -> Commit:
    if not store.create_text(spark, f"{path}/commits/{new.version:08d}.json", json.dumps(asdict(new))):
        raise Conflict(f"version {new.version} of {path} was committed by another writer")
    return new


def _name(number: int) -> str:
    """A rising number, and something random, so that what a failed writer has left is never taken for a segment."""
    return f"{number:08d}-{uuid.uuid4().hex[:8]}"


def _number(seg: Column) -> Column:
    return F.substring(seg, 1, 8).cast("long")


def _table(spark: SparkSession, path: str, name: str, commit: Commit) -> str:
    """The session's name for a table of the index, which is made known to it if need be."""
    known = f"index_{md5(f'{path}|{name}|{commit.buckets}|{commit.id_type}'.encode()).hexdigest()[:24]}"
    key, order, columns = TABLES[name]
    if not spark.catalog.tableExists(known):
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {known} ({columns.replace('doc_id id', f'doc_id {commit.id_type}')}, lang STRING, seg STRING) USING parquet "
            f"PARTITIONED BY (lang, seg) CLUSTERED BY ({key}) SORTED BY ({order}) INTO {commit.buckets} BUCKETS LOCATION '{path}/{name}'"
        )
    return known


def _append(rows: DataFrame, path: str, name: str, commit: Commit) -> None:
    """Add ``rows``, which are dealt to the table's buckets already or are now, as files of their own."""
    known, (key, order, _) = _table(rows.sparkSession, path, name, commit), TABLES[name]
    out = rows.write.format("parquet").mode("append").partitionBy("lang", "seg").bucketBy(commit.buckets, key).sortBy(order)
    out.option("path", f"{path}/{name}").saveAsTable(known)


def _write(rows: DataFrame, path: str, seg: str, commit: Commit) -> None:
    """A segment of ``rows`` (lang, doc_id, field, term, tf, positions), all of a document's in one task, and what is counted from it."""
    spark = rows.sparkSession
    length = F.sum("tf").over(Window.partitionBy("lang", "doc_id", "field"))
    order = lambda name: [F.col(c.split()[0]) for c in TABLES[name][2].split(", ")] + [F.col("lang"), F.lit(seg).alias("seg")]
    _append(rows.withColumn("len", length).select(order("postings")), path, "postings", commit)
    kept = spark.table(_table(spark, path, "postings", commit)).where(F.col("seg") == seg)
    _append(kept.groupBy("lang", "doc_id", "field").agg(F.max("len").alias("len")).select(order("lengths")), path, "lengths", commit)
    _append(kept.groupBy("lang", "doc_id", "term").agg(F.count("*").alias("mtf")).select(order("models")), path, "models", commit)
    terms = kept.groupBy("lang", "field", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    _append(terms.select(order("field_terms")).repartition(commit.buckets, "term"), path, "field_terms", commit)


def _postings(docs: DataFrame, fields: Iterable[str], tokens: Tokens | Mapping[str, Tokens], by_language: Mapping[str, Tokens] | None, buckets: int) -> DataFrame:
    """Texts are dealt to the buckets once; their postings are then counted where they are."""
    dealt = docs.repartition(buckets, "doc_id")
    if not by_language:
        return postings(dealt, fields, tokens)
    return reduce(DataFrame.unionByName, [postings(dealt.where(F.col("lang") == lang), fields, t) for lang, t in by_language.items()])


def _planned(docs: int, bytes_: int) -> int:
    """Buckets that grow in number and not in size."""
    return min(MOST_BUCKETS, max(-(-docs // BUCKET), -(-bytes_ // BUCKET_BYTES)))


def _buckets(docs: DataFrame, fields: tuple[str, ...]) -> int:
    """Planned buckets, but as many as cores at least."""
    size = reduce(Column.__add__, [F.coalesce(F.octet_length(f), F.lit(0)).cast("long") for f in fields])
    docs_, bytes_ = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()  # one row
    return max(docs.sparkSession.sparkContext.defaultParallelism, _planned(docs_, bytes_))


def _grown(spark: SparkSession, path: str, commit: Commit) -> int:
    """Buckets for what counts now: as many as there are, or as planned where that is ``OUTGROWN`` times as many.

    Live tokens come from the lengths and bytes of a token from the terms as they were stored, so that no posting is read.
    """
    docs, tokens = read_index(spark, path, "lengths").agg(F.count_distinct("doc_id"), F.coalesce(F.sum("len"), F.lit(0))).first()  # one row
    known = _table(spark, path, "field_terms", commit)
    spark.catalog.refreshTable(known)
    terms = spark.table(known).where(F.col("seg").isin(*commit.segments))
    a_token = terms.agg(F.sum(F.col("tf") * (F.octet_length("term") + 1)) / F.sum("tf")).first()[0] or 0  # one row
    planned = _planned(docs, int(tokens * a_token))
    return planned if planned >= OUTGROWN * commit.buckets else commit.buckets


def write_index(
    docs: DataFrame, path: str, fields: Iterable[str] = FIELDS, tokens: Tokens | Mapping[str, Tokens] = simple_tokens,
    by_language: Mapping[str, Tokens] | None = None, buckets: int | None = None,
) -> Commit:
    """A new index of ``docs`` (doc_id, lang, and the fields) in one segment; what was at ``path`` before goes.

    Tables: postings (doc_id, field, term, tf, positions, len), field_terms (field, term, tf, df), lengths (doc_id, field, len) and
    models (doc_id, term, mtf), each with lang and seg. ``by_language`` analyses each language's documents with an analyzer (and
    stop words) of its own; documents of other languages are left out. ``buckets`` are as many as Spark has cores, or more for many
    documents or much text; they stay the same until :func:`merge_segments` finds them outgrown.
    """
    spark, fields = docs.sparkSession, tuple(fields)
    n = buckets or _buckets(docs, fields)
    new = Commit(0, n, dict(docs.dtypes)["doc_id"].upper(), 1, (_name(0),))
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_table(spark, path, name, new)}")
        store.remove(spark, f"{path}/{name}")
    for name in ("commits", "deleted"):
        store.remove(spark, f"{path}/{name}")
    _write(_postings(docs, fields, tokens, by_language, n), path, new.segments[0], new)
    return _commit(spark, path, new)


def _tombstones(spark: SparkSession, path: str, commit: Commit) -> DataFrame:
    """(doc_id, gone): documents that don't count in segments with a number below ``gone``."""
    rows = spark.read.parquet(*(f"{path}/deleted/{d}" for d in commit.deleted))
    return rows.groupBy("doc_id").agg(F.max("gone").alias("gone"))


def _bury(spark: SparkSession, path: str, ids: DataFrame, commit: Commit, before: int) -> Commit:
    """``commit`` with a tombstone for each of ``ids`` (doc_id) that a segment with a number below ``before`` has."""
    lengths = spark.table(_table(spark, path, "lengths", commit)).where(F.col("seg").isin(*commit.segments)).select("doc_id", "seg")
    hit = store.stored(lengths.join(ids.select("doc_id").distinct(), "doc_id").distinct(), "tombstones")
    dirty = tuple(sorted({*commit.dirty, *(r["seg"] for r in hit.select("seg").distinct().collect())}))  # a name a segment
    if hit.isEmpty():
        return commit
    name = _name(before)
    hit.select("doc_id", F.lit(before).cast("long").alias("gone")).distinct().write.parquet(f"{path}/deleted/{name}")
    return replace(commit, dirty=dirty, deleted=(*commit.deleted, name))


def add_documents(
    docs: DataFrame, path: str, fields: Iterable[str] = FIELDS, tokens: Tokens | Mapping[str, Tokens] = simple_tokens, by_language: Mapping[str, Tokens] | None = None
) -> Commit:
    """``docs`` as a new segment. Documents of the same ids in earlier segments are replaced; no file that is there is written again."""
    spark, old = docs.sparkSession, _known(docs.sparkSession, path)
    seg = _name(old.next_number)
    _write(_postings(docs, tuple(fields), tokens, by_language, old.buckets), path, seg, old)
    new = _bury(spark, path, docs, old, old.next_number)
    return _commit(spark, path, replace(new, version=old.version + 1, next_number=old.next_number + 1, segments=(*new.segments, seg)))


def delete_documents(ids: DataFrame, path: str) -> Commit:
    """The documents of ``ids`` (doc_id) count no more; ids that the index doesn't have are ignored."""
    spark = ids.sparkSession
    old = _known(spark, path)
    new = _bury(spark, path, ids, old, old.next_number)
    return _commit(spark, path, replace(new, version=old.version + 1, next_number=old.next_number + 1))


def merge_segments(spark: SparkSession, path: str, below: int | None = None) -> Commit:
    """Live documents of all segments, or of those with fewer than ``below`` documents, as one new segment without tombstones.

    Postings are copied, not analysed again. Old files stay for readers that are at work, until :func:`vacuum`. Additions make buckets
    larger; where all segments are merged and the buckets were outgrown, postings are dealt to more of them.
    """
    old = _known(spark, path)
    sizes = {r["seg"]: r["n_docs"] for r in segment_sizes(spark, path).collect()}  # a row a segment
    chosen = [s for s in old.segments if below is None or sizes.get(s, 0) < below]
    if len(chosen) < 2 and not (set(chosen) & set(old.dirty)):
        return old
    # Segments that came after a chosen one may hold newer versions of its documents, and tombstones say so by number.
    seg = _name(old.next_number)
    rows = read_index(spark, path).where(F.col("seg").isin(*chosen)).drop("len", "seg")
    left = tuple(s for s in old.segments if s not in chosen)
    new = old if left else replace(old, buckets=_grown(spark, path, old))
    _write(rows if new.buckets == old.buckets else rows.repartition(new.buckets, "doc_id"), path, seg, new)
    dirty = tuple(s for s in old.dirty if s in left)
    return _commit(spark, path, replace(new, version=old.version + 1, next_number=old.next_number + 1, segments=(*left, seg), dirty=dirty, deleted=old.deleted if dirty else ()))


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove what the last commit doesn't name: merged segments, and files that failed writers left. No other writer may be at work."""
    commit, gone = _known(spark, path), []
    for name in TABLES:
        for lang in store.names(spark, f"{path}/{name}"):
            for seg in store.names(spark, f"{path}/{name}/{lang}") if lang.startswith("lang=") else []:
                if seg.removeprefix("seg=") not in commit.segments:
                    store.remove(spark, f"{path}/{name}/{lang}/{seg}")
                    gone.append(f"{name}/{lang}/{seg}")
        spark.catalog.refreshTable(_table(spark, path, name, commit))
    for name in store.names(spark, f"{path}/deleted"):
        if name not in commit.deleted:
            store.remove(spark, f"{path}/deleted/{name}")
            gone.append(f"deleted/{name}")
    return gone


def _known(spark: SparkSession, path: str) -> Commit:
    commit = latest(spark, path)
    if commit is None:
        raise FileNotFoundError(f"no index at {path}")
    return commit


def read_index(spark: SparkSession, path: str, name: str = "postings") -> DataFrame:
    """What counts of a table of the index, with ``seg``; fails if there is no index at ``path``.

    Rows of documents that were deleted or replaced are left out by an anti join on the buckets' key. The statistics of segments
    that tombstones reach into are counted from their postings, all others are as they were stored.
    """
    commit = _known(spark, path)
    known = _table(spark, path, name, commit)
    spark.catalog.refreshTable(known)
    rows = spark.table(known).where(F.col("seg").isin(*commit.segments))
    if not commit.dirty:
        return rows
    if name == "field_terms":
        live = read_index(spark, path).where(F.col("seg").isin(*commit.dirty))
        counted = live.groupBy("lang", "seg", "field", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
        return rows.where(~F.col("seg").isin(*commit.dirty)).unionByName(counted.select(*rows.columns))
    gone = _tombstones(spark, path, commit).withColumnRenamed("doc_id", "_id")
    return rows.join(gone, (F.col("doc_id") == F.col("_id")) & (_number(F.col("seg")) < F.col("gone")), "left_anti")


def segment_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(seg, n_docs): live documents of each segment."""
    return read_index(spark, path, "lengths").groupBy("seg").agg(F.count_distinct("doc_id").alias("n_docs"))


def put_rows(docs: DataFrame, path: str, number: int) -> None:
    """Keep ``docs`` (doc_id, ...) beside the index as they came with commit ``number``; the same commit's are replaced."""
    docs.write.mode("overwrite").parquet(f"{path}/docs/number={number}")


def drop_rows(ids: DataFrame, path: str, number: int) -> None:
    """Note that ``ids`` (doc_id) were deleted with commit ``number``."""
    ids.select("doc_id", F.lit(True).alias("gone")).distinct().write.mode("overwrite").parquet(f"{path}/docs/number={number}")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each document that was put and not deleted since."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/docs")
    if "gone" not in rows.columns and rows.select("number").distinct().count() == 1:
        return rows.drop("number")
    rows = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(None).cast("boolean"))
    newest = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.max("number").alias("_last"))
    live = rows.join(newest, (F.col("doc_id") == F.col("_id")) & (F.col("number") == F.col("_last")), "left_semi")
    return live.where("gone is null").drop("number", "gone")
