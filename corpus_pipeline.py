"""From raw documents to packed sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``, extra ones
included; columns that an operator adds for itself never stay. Empty tables give empty tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.llm import line_dedup, minhash, mixing, packing, quality
from termspire.llm.common import read, table

#: Copies of one row that are written out in one go.
COPIES = 1024


def _hashed(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with two hashes of the text, and what tells rows apart: the id and these."""
    out = docs.withColumns({"_th": F.xxhash64("text"), "_th2": F.xxhash64(F.lit(1), "text")})
    return out, [F.col("doc_id"), F.col("_th"), F.col("_th2")]


def _marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Hashed ``docs`` with the columns of ``marks`` (doc_id, _th, _th2, _n, ...), once for each row of it.

    ``_n`` is how many rows of ``docs`` a mark is for: these agree in id and text, and one of them stands for all.
    """
    renamed = marks.withColumnsRenamed({"doc_id": "_id", "_th": "_h", "_th2": "_h2"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")) & (F.col("_th2") == F.col("_h2"))
    joined = docs.join(renamed, same).drop("_id", "_h", "_h2")
    if marks.where("_n > 1").isEmpty():
        return joined
    # Partial aggregates reduce a large group of equal rows before the shuffle.
    return joined.where("_n = 1").unionByName(joined.where("_n > 1").dropDuplicates(["doc_id", "_th", "_th2"]))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good; rejected ones go.

    Each row is judged by its own whole text, null text as the empty one, rows that repeat alike. Without any label nothing can
    be rejected and all rows stay; with labels of one class their smoothed share decides for all.
    """
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    if isinstance(model, quality.Prior) and not model.n:
        return docs
    return quality.keep_good(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay where they stand first, whether or not they fill their lines; changed texts get their new length.

    Rows always stay, with what is left of their text; null text stays null; rows that repeat id and text change alike.
    """
    out = line_dedup.dedup_passages(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8; the smallest id stays.

    Rows that repeat an id are one document, of which one row stays (by text hash, if texts differ). Rows without an id
    stay once for each text. Null and empty texts are copies of nothing: each id stays.
    """
    rows, keys = _hashed(docs)
    kept = minhash.near_duplicates(docs.select("doc_id", "text"), n=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    own = counts.join(kept, "doc_id").groupBy("doc_id").agg(F.min(F.struct("_th", "_th2", "_n")).alias("m")).select("doc_id", "m.*")
    marks = table(own.unionByName(counts.where("doc_id is null")), "kept-documents")
    return _marked(rows, marks).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, those without words as often as their source is gone through.

    Null sources are one source; rows without an id, or that repeat one, are taken one by one, and of rows that agree
    in id, source and text one stands for all that are taken.
    """
    rows, keys = _hashed(docs)
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = rows.withColumn("_th2", F.xxhash64("_th2", source))
    taken = mixing.mix(docs.select("doc_id", "source", "text")).groupBy("doc_id", F.col("text_hash").alias("_th"), source.alias("_s"))
    taken = taken.agg(F.sum("times").alias("_times"), F.count("*").alias("_n")).where("_times > 0")
    # The second hash of the text is in the rows only; it takes the source in, so that marks are told by all of these.
    own = rows.select(*keys, source.alias("_s")).distinct()
    marks = own.join(taken.withColumnsRenamed({"doc_id": "_id", "_th": "_h", "_s": "_z"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")) & (F.col("_s") == F.col("_z")))
    marked = _marked(rows, table(marks.select("doc_id", "_th", "_th2", "_n", "_times"), "taken-documents"))
    parts = marked.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / COPIES))))
    many = parts.where(F.col("_times") > COPIES).repartition("_th", "_part")
    parts = parts.where(F.col("_times") <= COPIES).unionByName(many)
    copies = F.least(F.col("_times") - F.col("_part") * COPIES, F.lit(COPIES)).cast("int")
    return parts.withColumn("_i", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024.

    Every row is a document of its own, repeated and null ids included; null and empty texts are their end token alone.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", dedup_documents),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the sketches and the tokenizer have no SQL form; brute-force tests stand in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
