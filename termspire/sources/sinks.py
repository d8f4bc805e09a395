"""Result tables with declared columns and uniqueness."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.sources import store

_CODE = "code string, section string, class int, subclass string, maingroup int, subgroup int, count long"
_SCORES = (
    "impl string, is_empty boolean, empty_reason string, q_fields string, q_ipc string, score double, {ref} string, "
    "fb_doc_count long, fb_terms_min long, fb_terms_max long, icsconf_ref string"
)


@dataclass(frozen=True)
class Table:
    columns: str
    unique: tuple[str, ...] = ()


#: Result tables with their columns and what is unique.
TABLES = {
    "terms": Table("field string, term string, lang string, docfreq_rel double, docfreq_abs long, ipc string", ("field", "term", "lang", "ipc")),
    "term_segments": Table(
        "segment int, field string, section string, lang string, docfreq_rel_min double, docfreq_rel_max double, term_count long",
        ("field", "lang", "section", "segment"),
    ),
    "scoring_terms": Table(
        "id string, term string, lang string, field string, docfreq_rel double, docfreq_abs long, bin int, ipc string",
        ("term", "field", "lang", "bin", "ipc"),
    ),
    "scoring_sentences": Table("sentence string, term_ref string", ("term_ref",)),
    "scoring_terms_results": Table(_SCORES.format(ref="term_ref"), ("impl", "term_ref", "q_fields", "q_ipc")),
    "scoring_sentence_results": Table(_SCORES.format(ref="sent_ref"), ("impl", "sent_ref", "q_fields", "q_ipc")),
    "scoring_terms_results_bm25": Table(
        "doc_id long, q_fields string, q_ipc string, score double, term_ref string", ("doc_id", "term_ref", "q_fields", "q_ipc")
    ),
    "scoring_sentence_results_bm25": Table(
        "doc_id long, q_fields string, q_ipc string, score double, sent_ref string", ("doc_id", "sent_ref", "q_fields", "q_ipc")
    ),
    "ics_conf": Table(
        "id string, timestamp timestamp, docmod_smoothing double, fb_max long, fb_term_ts_min double, fb_term_ts_max double, q_fields string, q_ipc string",
        ("docmod_smoothing", "fb_max", "fb_term_ts_min", "fb_term_ts_max", "q_fields", "q_ipc"),
    ),
    "ipc_all": Table(_CODE, ("code",)),
    "ipc_distribution": Table(_CODE, ("code",)),
    "ipc_sections": Table("sections int, count long"),
    "ipc_perdocument": Table("codes int, count long"),
    "ipc_docfieldcount": Table("section string, field string, count long", ("field", "section")),
    "idx_stats": Table("field string, ttf long, utf long, docs long"),
    "fb_docs": Table("doc_id long"),
    "fb_terms": Table("term_ref string, q_model double, c_model double"),
    "term_stats": Table("term string, df_rel double, df long, tf_rel double, tf long"),
    "_qc_meta": Table("table_name string, cmd string, timestamp timestamp"),
    "_keyval": Table("key string, value string, timestamp timestamp"),
}


def shaped(df: DataFrame, name: str) -> DataFrame:
    """``df`` cast to the table's columns; those it lacks are null."""
    have = set(df.columns)
    cols = [c.strip().split(" ") for c in TABLES[name].columns.split(",")]
    return df.select(*(F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in cols))


def exists(spark: SparkSession, root: str, name: str) -> bool:
    """Whether the table is there with a row or more."""
    return store.exists(spark, f"{root}/{name}") and not spark.read.parquet(f"{root}/{name}").isEmpty()


def rows(spark: SparkSession, root: str, name: str) -> int:
    """The number of rows; 0 without a table."""
    return spark.read.parquet(f"{root}/{name}").count() if store.exists(spark, f"{root}/{name}") else 0


def has_column(spark: SparkSession, root: str, name: str, column: str) -> bool:
    return store.exists(spark, f"{root}/{name}") and column in spark.read.parquet(f"{root}/{name}").columns


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table, empty if nothing was ever written to it."""
    if store.exists(spark, f"{root}/{name}"):
        return spark.read.parquet(f"{root}/{name}")
    return spark.createDataFrame([], TABLES[name].columns)


def insert(df: DataFrame, root: str, name: str, ignore: bool = False) -> DataFrame:
    """Append to a table. With ``ignore`` rows that repeat unique columns are left out, else they fail."""
    spark, unique = df.sparkSession, list(TABLES[name].unique)
    new = shaped(df, name)
    if unique:
        new = store.stored(new, name)
        if exists(spark, root, name):
            old = spark.read.parquet(f"{root}/{name}").select(*(F.col(c).alias(f"o_{c}") for c in unique))
            same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in unique]
            if not ignore and not new.join(old, same, "left_semi").isEmpty():
                raise ValueError(f"{name} has rows with the same {unique}")
            new = new.join(old, same, "left_anti")
        if ignore:
            new = new.dropDuplicates(unique)
        elif not new.groupBy(*unique).count().where("count > 1").isEmpty():
            raise ValueError(f"rows repeat {unique}")
    new.write.mode("append").parquet(f"{root}/{name}")
    return spark.read.parquet(f"{root}/{name}")


def contains(table: DataFrame, **values) -> bool:
    """Whether a row has all these values."""
    for k, v in values.items():
        table = table.where(F.col(k).eqNullSafe(F.lit(v)))
    return not table.isEmpty()


def log_stage(spark: SparkSession, root: str, name: str, cmd: str) -> DataFrame:
    """A row that says which command wrote a table."""
    row = spark.createDataFrame([(name, cmd)], "table_name string, cmd string").withColumn("timestamp", F.current_timestamp())
    return insert(row, root, "_qc_meta")


def put_value(spark: SparkSession, root: str, key: str, value) -> DataFrame:
    """A row of the key-value table."""
    row = spark.createDataFrame([(key, str(value))], "key string, value string").withColumn("timestamp", F.current_timestamp())
    return insert(row, root, "_keyval")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def run_id(config, fields: str, codes: str | None) -> str:
    """A result's reference to its configuration: a hash of the parameters."""
    return hashlib.md5(f"{config}|{fields}|{codes}".encode()).hexdigest()


def register_run(spark: SparkSession, root: str, config, fields: str, codes: str | None) -> str:
    """Write the configuration of an improved-clarity run once, and return the id that its results carry."""
    key = run_id(config, fields, codes)
    row = (key, config.smoothing, config.most, config.band_low, config.band_high, fields, codes)
    shape = "id string, docmod_smoothing double, fb_max long, fb_term_ts_min double, fb_term_ts_max double, q_fields string, q_ipc string"
    insert(spark.createDataFrame([row], shape).withColumn("timestamp", F.current_timestamp()), root, "ics_conf", ignore=True)
    return key
