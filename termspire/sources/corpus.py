"""Documents as the engine sees them: fields to tokenise and classification codes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.functions.analysis import simple_tokens

FIELDS = ("claims", "detd")
#: Languages that have an analyzer; documents of others are dropped.
LANGUAGES = ("de", "en", "fr")


def record_documents(records: DataFrame) -> DataFrame:
    """Source records (lang, PN, CLM, DETD, DETDL, IPC) with claims in ``lang`` or a description in it: (pat_id, lang, claims, detd, ipc).

    Arrays are joined by spaces after control characters and literal ``\\n`` become spaces; codes are distinct.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.concat_ws(" ", F.transform(c, lambda x: F.regexp_replace(x, r"\p{Cntrl}|\\n", " "))), r"\s+", " "))
    own = (F.lower("DETDL") == F.col("lang")) & F.col("DETD").isNotNull()
    rows = records.where(F.col("CLM").isNotNull() | own).select(
        F.col("PN").alias("pat_id"), "lang",
        F.when(F.col("CLM").isNotNull(), clean(F.col("CLM"))).alias("claims"),
        F.when(own, clean(F.col("DETD"))).alias("detd"),
        F.array_distinct(F.flatten(F.transform("IPC", lambda c: F.split(c, " ")))).alias("ipc"),
    )
    return rows.where("pat_id is not null and (claims is not null or detd is not null)")


def read_json_documents(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Files of source records with claims by language and a description: those that have text in ``lang``."""
    claims = f"CLM{lang.upper()}"
    schema = f"PN string, {claims} array<string>, DETD array<string>, DETDL string, IPC array<string>"
    return record_documents(spark.read.schema(schema).json(path).select(F.lit(lang).alias("lang"), "PN", F.col(claims).alias("CLM"), "DETD", "DETDL", "IPC"))


def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table in the engine's shape: (doc_id, lang, claims, detd, ipc).

    The first line is the claims field and the rest the description; codes follow
    from the id by arithmetic, so that any engine derives the same ones.
    """

    def code(i: Column) -> Column:
        letter = lambda n: F.char((F.lit(65) + n).cast("int"))
        pad = lambda n, k: F.lpad(n.cast("string"), k, "0")
        return F.concat(letter(i % 8), pad(1 + i % 99, 2), letter(i % 26), pad(1 + i % 9999, 4), F.lit("-"), pad(i % 10000, 4))

    claims = F.split_part("text", F.lit("\n"), F.lit(1))
    i = F.col("doc_id")
    codes = F.array(
        code(i), F.when(i % 3 == 0, code(i + 3)), F.when(i % 50 == 0, F.lit("A00B")).when(i % 50 == 1, F.lit("X99"))
    )
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("lang").isin(*LANGUAGES)).select(
        "doc_id", "lang", claims.alias("claims"),
        F.nullif(F.substr("text", F.length(claims) + 2), F.lit("")).alias("detd"),
        F.filter(codes, lambda c: c.isNotNull()).alias("ipc"),
    )


Tokens = Callable[[Column], Column]


def _tokens_of(docs: DataFrame, fields: Iterable[str], tokens: Tokens | Mapping[str, Tokens]) -> DataFrame:
    """(lang, doc_id, field, t): the tokens of each field that isn't null."""
    own = tokens.get if isinstance(tokens, Mapping) else lambda f: tokens
    # A field without an analyzer of its own gets the simple one.
    parts = [F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), (own(f) or simple_tokens)(F.col(f)).alias("t"))) for f in fields]
    rows = docs.select("lang", "doc_id", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))
    return rows.select("lang", "doc_id", "p.field", "p.t")


def postings(docs: DataFrame, fields: Iterable[str] = FIELDS, tokens: Tokens | Mapping[str, Tokens] = simple_tokens) -> DataFrame:
    """(lang, doc_id, field, term, tf, positions): one row per distinct term of a field.

    ``tokens`` is an analyzer for all fields or one by field. Partial aggregates group a field's tokens
    before the shuffle.
    """
    rows = _tokens_of(docs, fields, tokens).select("lang", "doc_id", "field", F.posexplode("t").alias("pos", "term")).where("term <> ''")
    return rows.groupBy("lang", "doc_id", "field", "term").agg(
        F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")
    )


def counts(docs: DataFrame, fields: Iterable[str] = FIELDS, tokens: Tokens | Mapping[str, Tokens] = simple_tokens) -> DataFrame:
    """As :func:`postings` without positions, which only an index needs."""
    rows = _tokens_of(docs, fields, tokens).select("lang", "doc_id", "field", F.explode("t").alias("term")).where("term <> ''")
    return rows.groupBy("lang", "doc_id", "field", "term").agg(F.count("*").alias("tf"))


def stopword_path(folder: str, pattern: str, lang: str) -> str:
    """The word list of a language: ``<pattern>_<lang>.txt``."""
    return f"{folder.rstrip('/')}/{pattern}_{lang.lower()}.txt"


def read_stopwords(spark: SparkSession, path: str, form: str = "plain") -> DataFrame:
    """(term) of a word list: a word a line, or ``snowball`` with comments after ``|``."""
    if form not in ("plain", "snowball"):
        raise ValueError("word lists are plain or snowball")
    lines = spark.read.text(path)
    if form == "snowball":
        lines = lines.where(~F.col("value").startswith("|"))
    return lines.select(F.lower(F.get(F.split(F.trim("value"), " "), 0)).alias("term")).where("term <> ''").distinct()
