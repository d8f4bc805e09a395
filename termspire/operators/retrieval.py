"""Queries, their matches, rankings and feedback documents, for all queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.functions.analysis import simple_tokens
from termspire.operators.joins import meet
from termspire.operators.view import View
from termspire.sources.store import stored

#: Clauses (terms times fields) that a query may have.
MAX_CLAUSES = 2048
#: Share of documents beyond which a clause is of high frequency.
HIGH = 0.01
TYPES = ("TEQ", "CTQ")


def query_terms(
    queries: DataFrame, id_col: str, text_col: str, known: DataFrame | None = None, tokens: Callable[[Column], Column] = simple_tokens
) -> DataFrame:
    """(q_id, term, qtf): the query's terms with their counts; with ``known`` only those in it.

    ``tokens`` is the analyzer of the index. The text may also be an array of strings, whose terms all count.
    """
    text = F.col(text_col)
    text = F.array_join(text, " ") if dict(queries.dtypes)[text_col].startswith("array") else text
    rows = queries.select(F.col(id_col).alias("q_id"), F.explode(tokens(text)).alias("term")).where("term <> ''")
    rows = rows.groupBy("q_id", "term").agg(F.count("*").alias("qtf"))
    return rows.join(known.select("term"), "term", "left_semi").select("q_id", "term", "qtf") if known is not None else rows


def oversized(terms: DataFrame, n_fields: int, most: int = MAX_CLAUSES) -> DataFrame:
    """(q_id): queries with more clauses than a boolean query may have."""
    return terms.groupBy("q_id").agg(F.count("*").alias("n")).where(F.col("n") * n_fields > most).select("q_id")


def teq_matches(view: View, terms: DataFrame) -> DataFrame:
    """(q_id, doc_id, n_match, n_unique): how many distinct query terms a document has in any visible field.

    The exact query wants all of them; each relaxation wants one less, down to one.
    Queries come to the documents' models, which are dealt by document, so pairs are counted where they are made.
    """
    n = terms.groupBy("q_id").agg(F.count("*").alias("n_unique"))
    pairs = meet(view.doc_model().select("term", "doc_id"), terms.select("q_id", "term"), ["term"])
    found = pairs.groupBy("q_id", "doc_id").agg(F.count("*").alias("n_match"))
    return found.join(n, "q_id").select("q_id", "doc_id", "n_match", "n_unique")


def ctq_clauses(view: View, terms: DataFrame, fields: tuple[str, ...], high: float = HIGH) -> DataFrame:
    """(q_id, field, term, is_high): a query's clauses, of high frequency in more than this share of documents or not; stored."""
    cut = view.collection().select(F.ceil(F.col("n_docs") * high).alias("cut"))
    clauses = terms.select("q_id", "term", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    clauses = clauses.join(view.field_terms().select("field", "term", "df"), ["field", "term"], "left").crossJoin(F.broadcast(cut))
    return stored(clauses.select("q_id", "field", "term", (F.coalesce("df", F.lit(0)) > F.col("cut")).alias("is_high")), "clauses")


def _by_frequency(clauses: DataFrame) -> DataFrame:
    """(q_id, n_unique, n_low, n_high): distinct terms, and clauses of each kind."""
    counts = F.count_if(~F.col("is_high")).alias("n_low"), F.count_if("is_high").alias("n_high")
    return clauses.groupBy("q_id").agg(F.count_distinct("term").alias("n_unique"), *counts)


def _fits() -> Column:
    """With a clause of low frequency at least one such must match, and the rest only score; with none, all clauses must match."""
    return F.when(F.col("n_low") > 0, F.col("low") >= 1).otherwise(F.col("high") == F.col("n_high"))


def ctq_matches(view: View, terms: DataFrame, fields: tuple[str, ...], high: float = HIGH) -> DataFrame:
    """(q_id, doc_id, low, high): how many clauses (field, term) of low and high document frequency match, of documents that :func:`_fits` keeps."""
    clauses = ctq_clauses(view, terms, fields, high)
    hits = meet(view.postings.select("field", "term", "doc_id"), clauses, ["field", "term"])
    hits = hits.groupBy("q_id", "doc_id").agg(F.count_if(~F.col("is_high")).alias("low"), F.count_if("is_high").alias("high"))
    return hits.join(_by_frequency(clauses), "q_id").where(_fits()).select("q_id", "doc_id", "low", "high")


def norm(length: Column) -> Column:
    """1 / sqrt(length) floored to three mantissa bits."""
    x = 1 / F.sqrt(length.cast("double"))
    p = F.pow(F.lit(2.0), F.floor(F.log2(x) + 1e-12))
    return p * (1 + F.floor((x / p - 1) * 8 + 1e-9) / 8)


def matched(view: View, terms: DataFrame, clauses: DataFrame | None = None) -> DataFrame:
    """(q_id, doc_id, n_match, n_unique, score): every document with a term of the query; with ``clauses`` those of :func:`ctq_matches` only.

    ``n_match`` counts distinct terms in any visible field, ``score`` sums sqrt(tf) * idf^2 * norm over clauses,
    to six places. A document's fields are added up for each query term before queries meet them, so a pair of
    query and document costs a row for each distinct term that they share, and one aggregate. All of it is where the document's
    bucket is: no pair is shuffled. How frequent a clause is depends on its field and term alone, so clauses are counted in the same pass.
    """
    n = view.collection().select("n_docs")
    wanted = terms.select("term").distinct()
    idf = (
        view.field_terms().join(wanted, "term", "left_semi").crossJoin(F.broadcast(n))
        .select("field", "term", (1 + F.ln(F.col("n_docs") / (F.col("df") + 1))).alias("idf"))
    )
    sizes = terms.groupBy("q_id").agg(F.count("*").alias("n_unique")) if clauses is None else _by_frequency(clauses)
    counts = {}
    if clauses is not None:
        idf = idf.join(clauses.select("field", "term", "is_high").distinct(), ["field", "term"], "left")
        counts = {"low": F.count_if(~F.col("is_high")), "high": F.count_if("is_high")}
    idf = stored(idf, "idf")
    hits = meet(view.with_lengths().select("field", "term", "doc_id", "tf", "len"), idf, ["field", "term"])
    part = F.sqrt(F.col("tf").cast("double")) * F.col("idf") * F.col("idf") * norm(F.col("len"))
    by_doc = hits.groupBy("doc_id", "term").agg(F.sum(part).alias("part"), *(c.alias(name) for name, c in counts.items()))
    found = meet(by_doc, terms.select("q_id", "term"), ["term"]).groupBy("q_id", "doc_id")
    found = found.agg(F.count("*").alias("n_match"), F.round(F.sum("part"), 6).alias("score"), *(F.sum(name).alias(name) for name in counts))
    found = found.join(sizes, "q_id")
    return (found.where(_fits()) if counts else found).select("q_id", "doc_id", "n_match", "n_unique", "score")


def tfidf(view: View, terms: DataFrame) -> DataFrame:
    """(q_id, doc_id, score): sum over clauses of sqrt(tf) * idf^2 * norm, to six places."""
    return matched(view, terms).select("q_id", "doc_id", "score")


def top_n(scored: DataFrame, n: int | None) -> DataFrame:
    """The best ``n`` documents of each query, ties by document; with ``rank``. None keeps all hits."""
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


@dataclass(frozen=True)
class FeedbackSpec:
    """How many feedback documents a query gets and from which kind of query.

    ``unbounded`` takes every document that a single term (of a common-terms query: the query) matches.
    ``fields`` are those that a document must have terms in to fill a fixed amount.
    """

    least: int = 1
    most: int = 500
    fixed: bool = False
    kind: str = "TEQ"
    seed: str = ""
    unbounded: bool = False
    fields: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.least < 0 or self.most < max(1, self.least) or (self.fixed and self.unbounded):
            raise ValueError("feedback needs 0 <= least <= most, most > 0, and is fixed or unbounded")
        query_type(self.kind)


def query_type(name: str) -> str:
    """The registered kind of query that a name means: TEQ wants all terms and relaxes, CTQ splits clauses by frequency."""
    if name.upper() not in TYPES:
        raise ValueError(f"no kind of query named {name}")
    return name.upper()


def feedback(view: View, terms: DataFrame, spec: FeedbackSpec, fields: tuple[str, ...] = ("claims", "detd")) -> DataFrame:
    """(q_id, doc_id, level): feedback documents.

    Level 0 holds exact matches, best first. While there are fewer than ``least``,
    the next level (a term less) adds its documents worst first, until ``most``. With
    ``fixed`` both limits are ``most``, and documents in the order of a hash of
    their id fill what is missing. A query without any hit is filled as well.
    """
    least = spec.most if spec.fixed else spec.least
    if query_type(spec.kind) == "CTQ":
        found = matched(view, terms, ctq_clauses(view, terms, fields)).withColumn("level", F.lit(0))
    else:
        found = matched(view, terms).withColumn("level", (F.col("n_unique") - F.col("n_match")).cast("int"))
    if spec.unbounded:
        return found.select("q_id", "doc_id", "level")
    query = Window.partitionBy("q_id")
    exact = F.col("level") == 0
    order = query.orderBy("level", F.when(exact, -F.col("score")).otherwise(F.col("score")), F.when(exact, F.col("doc_id")).otherwise(-F.col("doc_id")))
    # The limit comes first: Spark then drops what is beyond it before the shuffle.
    chosen = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= spec.most)
    above = F.rank().over(query.orderBy("level")) - 1
    chosen = chosen.withColumn("above", above).where(exact | (F.col("above") < least)).select("q_id", "doc_id", "level")
    if not spec.fixed:
        return chosen
    chosen = stored(chosen, "feedback")
    # Fill: a query lacks at most `most` documents, so the first 2 * most by hash hold enough that aren't chosen yet.
    order = F.md5(F.concat(F.lit(spec.seed), F.col("doc_id").cast("string")))
    pool = view.doc_ids(spec.fields).select("doc_id", order.alias("h")).orderBy("h", "doc_id").limit(2 * spec.most)
    have = terms.select("q_id").distinct().join(chosen.groupBy("q_id").agg(F.count("*").alias("n")), "q_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    short = have.where(F.col("n") < spec.most)
    fill = short.crossJoin(F.broadcast(pool)).join(chosen, ["q_id", "doc_id"], "left_anti")  # 2 * most rows a query
    fill = fill.withColumn("r", F.row_number().over(query.orderBy("h", "doc_id"))).where(F.col("r") <= spec.most - F.col("n"))
    return chosen.unionByName(fill.select("q_id", "doc_id", F.lit(-1).alias("level")))


def ics_feedback(matches: DataFrame, least: int = 10, most: int = 500) -> DataFrame:
    """(q_id, doc_id, n_match): whole groups of equal match counts, highest first, until ``least`` documents; ``most`` in all."""
    query = Window.partitionBy("q_id")
    top = matches.withColumn("r", F.row_number().over(query.orderBy(F.desc("n_match"), "doc_id"))).where(F.col("r") <= most)
    above = F.rank().over(query.orderBy(F.desc("n_match"))) - 1
    return top.withColumn("above", above).where(F.col("above") < least).select("q_id", "doc_id", "n_match")


def inspect_feedback(view: View, chosen: DataFrame) -> DataFrame:
    """(q_id, doc_id, field, n_terms, terms): the sorted terms of each feedback document's fields."""
    rows = chosen.select("q_id", "doc_id").join(view.postings.select("doc_id", "field", "term"), "doc_id")
    rows = rows.groupBy("q_id", "doc_id", "field").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return rows.select("q_id", "doc_id", "field", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def inspect_vocabulary(view: View, chosen: DataFrame) -> DataFrame:
    """(q_id, term, rel_df): the feedback documents' terms with their share of all documents."""
    return view.vocabulary(chosen).join(view.term_stats().select("term", "rel_df"), "term").select("q_id", "term", "rel_df")
