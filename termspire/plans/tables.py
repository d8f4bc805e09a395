"""Dumps, samples, code statistics, sentences and reports as plain DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.functions import ipc
from termspire.functions.analysis import sentence_list, simple_tokens
from termspire.operators.joins import SMALL, spread_join
from termspire.operators.sentences import Model, split
from termspire.operators.view import View
from termspire.sources.store import stored

#: The first documents of an order that all terms look at, as a multiple of those that each wants.
EARLY = 40


def term_dump(view: View, threshold: float, stop: Iterable[str] = ()) -> DataFrame:
    """(field, term, df, rel_df): per field, terms with a share of the view's documents above the threshold."""
    n = view.collection().select("n_docs")
    rows = view.field_terms().where(~F.lower("term").isin(*stop)) if (stop := list(stop)) else view.field_terms()
    rows = rows.crossJoin(F.broadcast(n)).select("field", "term", "df", (F.col("df") / F.col("n_docs")).alias("rel_df"))
    return rows.where(F.col("rel_df") > threshold)


def common_term_dump(view: View, threshold: float) -> DataFrame:
    """(term, rel_df) above the threshold."""
    return view.term_stats().where(F.col("rel_df") > threshold).select("term", "rel_df")


def term_sample(dump: DataFrame, bins: int = 6, size: int = 50, picks: Iterable[int] = (2, 4, 6)) -> DataFrame:
    """(term, rel_df, bin, bin_min, bin_max): for each picked bin the terms nearest to its middle.

    Bins divide the range of ``rel_df`` evenly; bin 1 is at the top.
    """
    picks = list(picks)
    if dump.isEmpty():
        raise ValueError("there are no terms to sample")
    if not picks or max(picks) > bins or min(picks) < 1:
        raise ValueError("picks are bins from 1 to the number of bins")
    span = dump.agg(F.min("rel_df").alias("lo"), F.max("rel_df").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    chosen = span.select(F.explode(F.array(*map(F.lit, picks))).alias("bin"), "lo", "hi").select(
        "bin", (F.col("hi") - F.col("bin") * width).alias("bin_min"), (F.col("hi") - (F.col("bin") - 1) * width).alias("bin_max")
    )
    away = F.abs(F.col("rel_df") - (F.col("bin_min") + F.col("bin_max")) / 2)
    rows = dump.select("term", "rel_df").crossJoin(F.broadcast(chosen))  # a row a pick
    near = Window.partitionBy("bin").orderBy(F.round(away, 12), "term")
    return rows.withColumn("r", F.row_number().over(near)).where(F.col("r") <= size).drop("r")


def ipc_all(docs: DataFrame, separator: str = "-") -> DataFrame:
    """(code, section, class, subclass, maingroup, subgroup, n): valid, non-empty codes counted over documents."""
    rows = docs.select(F.explode("ipc").alias("c")).select(ipc.parts(F.col("c"), separator).alias("r")).where("r.section is not null")
    rows = rows.select(ipc.padded(F.col("r"), separator).alias("code"), *(F.col(f"r.{p}").alias(p) for p in ipc.PARTS))
    return rows.groupBy("code", *ipc.PARTS).agg(F.count("*").alias("n"))


def ipc_distribution(docs: DataFrame, separator: str = "-") -> DataFrame:
    """(code, n): each code counts for each of its distinct prefixes. Codes are counted before they're expanded."""
    rows = ipc_all(docs, separator)
    record = F.struct(*ipc.PARTS)
    return rows.select(F.explode(ipc.prefixes(record, separator)).alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n"))


def ipc_per_document(docs: DataFrame) -> DataFrame:
    """(codes, n): documents by their number of valid codes."""
    valid = F.filter("ipc", lambda c: ipc.parts(c)["section"].isNotNull())
    return docs.select(F.size(valid).alias("codes")).groupBy("codes").agg(F.count("*").alias("n"))


def ipc_sections(docs: DataFrame) -> DataFrame:
    """(sections, n): documents by their number of distinct sections."""
    return docs.select(F.size(ipc.sections(F.col("ipc"))).alias("sections")).groupBy("sections").agg(F.count("*").alias("n"))


def ipc_field_counts(docs: DataFrame, fields: Iterable[str] = ("claims", "detd")) -> DataFrame:
    """(section, field, n): documents with tokens in a field that the section's standard restriction keeps, zeros included."""
    has = {f: F.coalesce(F.size(simple_tokens(F.col(f))) > 0, F.lit(False)) for f in fields}
    kept = [(s, f, ipc.standard_restriction(F.col("ipc"), ipc.Code(s)) & has[f]) for s in "ABCDEFGH" for f in fields]
    one = docs.agg(*(F.count_if(k).alias(f"{s}_{f}") for s, f, k in kept))
    cells = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), F.col(f"{s}_{f}").alias("n")) for s, f, _ in kept))
    return one.select(F.inline(cells))


def ipc_list(docs: DataFrame, code: ipc.Code | None = None, separator: str = "-") -> DataFrame:
    """(code, formatted, valid, matched): the distinct codes, each tested against a record's pattern."""
    rows = docs.select(F.explode("ipc").alias("code")).distinct()
    test = F.col("code").rlike(f"^(?:{code.regex(separator)})$") if code else F.lit(True)
    r = ipc.parse(F.col("code"), separator)
    return rows.select("code", F.when(r["valid"], ipc.padded(r, separator)).otherwise("INVALID").alias("formatted"), r["valid"].alias("valid"), test.alias("matched"))


def ipc_list_counts(listing: DataFrame) -> DataFrame:
    """One row: matched and excluded codes of an :func:`ipc_list`."""
    return listing.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("excluded"))


def ipc_ordered(docs: DataFrame, separator: str = "-") -> DataFrame:
    """(section, place, code, n): each section's codes in the order of their parts, unset ones first."""
    rows = ipc_all(docs, separator).withColumn("r", F.struct(*ipc.PARTS))
    place = F.row_number().over(Window.partitionBy("section").orderBy(*ipc.sort_keys("r")))
    return rows.select("section", place.alias("place"), "code", "n")


def by_key(counts: DataFrame, key: str) -> DataFrame:
    """A histogram in the numeric order of its key."""
    return counts.orderBy(F.col(key).cast("double"), key)


def _seeded(seed: str) -> Column:
    """Documents in a seeded hash order."""
    return F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))


def _containing(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, term), stored: which terms each distinct token contains.

    Tokens are cut into pieces of the lengths that terms have, and pieces meet terms by equality: a token makes no more
    pieces than characters times lengths.
    """
    lengths = terms.agg(F.sort_array(F.collect_set(F.length("term"))).alias("ls"))
    each = tokens.select("token").distinct().crossJoin(F.broadcast(lengths))  # one row
    each = each.select("token", F.explode("ls").alias("l")).where(F.length("token") >= F.col("l"))
    starts = F.sequence(F.lit(1), F.length("token") - F.col("l") + 1)
    pieces = each.select("token", F.explode(F.transform(starts, lambda i: F.substr("token", i, F.col("l")))).alias("term"))
    return stored(pieces.join(terms, "term").select("token", "term").distinct(), "tokens-with-terms")


def _hits(tokens: DataFrame, inside: DataFrame) -> DataFrame:
    """(field, term, doc_id), with repeats: documents that have a token which contains the term."""
    side = stored(inside.groupBy("token").agg(F.collect_list("term").alias("terms")), "terms-by-token")
    met = tokens.join(F.broadcast(side), "token") if side.count() <= SMALL else spread_join(tokens, side, "token")
    return met.select("field", F.explode("terms").alias("term"), "doc_id")


def _first_hits(tokens: DataFrame, inside: DataFrame, fields: tuple[str, ...], seed: str, most: int) -> DataFrame:
    """(field, term, doc_id), distinct: at least the first ``most`` documents, in the seeded order, of each term and field.

    That order is the same for all terms, so terms that are common enough find all of theirs among its first documents;
    only the others look at the rest.
    """
    n = tokens.agg(F.count_distinct("doc_id")).first()[0]  # one row
    if n <= EARLY * most:
        return _hits(tokens, inside).distinct()
    bound = f"{EARLY * most * 2**32 // n:08x}"
    early = stored(_hits(tokens.where(_seeded(seed) < bound), inside).distinct(), "early-hits")
    settled = stored(early.groupBy("field", "term").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("field", "term"), "settled")
    done = settled.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") == len(fields))
    late = _hits(tokens, inside.join(done, "term", "left_anti")).join(settled, ["field", "term"], "left_anti").distinct()
    return early.join(settled, ["field", "term"], "left_semi").select("field", "term", "doc_id").unionByName(late)


def sentences(docs: DataFrame, terms: DataFrame, fields: Iterable[str] = ("claims", "detd"), seed: str = "0", most: int = 500, model: Model | None = None) -> DataFrame:
    """(field, term, doc_id, sentence): for each term and field one sentence of one of at most ``most`` documents with it.

    Of a term's documents the first ``most`` in a seeded hash order are candidates, and another hash picks one. Of its
    sentences that contain the term in a token, a single one is taken, of up to three any, else one of the longest n / 3.5.
    Sentences are those of ``model``, if there is one, else they're cut by punctuation.
    """
    fields, terms = tuple(fields), stored(terms.select("term").distinct(), "sentence-terms")
    # Sentences end at spaces, so a field's tokens are those of its sentences, and texts needn't go along with them.
    parts = [F.struct(F.lit(f).alias("field"), F.array_distinct(simple_tokens(F.col(f))).alias("t")) for f in fields]
    tokens = stored(docs.select("doc_id", F.explode(F.array(*parts)).alias("p")).select("doc_id", "p.field", F.explode("p.t").alias("token")), "sentence-tokens")
    hits = _first_hits(tokens, _containing(tokens, terms), fields, seed, most)
    group = Window.partitionBy("field", "term")
    again = F.md5(F.concat(F.lit(seed), "term", F.col("doc_id").cast("string")))
    docs_ = hits.withColumn("r", F.row_number().over(group.orderBy(_seeded(seed), "doc_id"))).where(F.col("r") <= most)
    first = docs_.withColumn("p", F.row_number().over(group.orderBy(again, "doc_id"))).where("p = 1").select("field", "term", "doc_id")
    first = stored(first, "sentence-documents")
    # Only the picked documents are cut into sentences.
    few = docs.join(first.select("doc_id").distinct(), "doc_id", "left_semi")
    if model:
        rows = split(few, model, fields).select("doc_id", "field", "sentence")
    else:
        parts = [F.struct(F.lit(f).alias("field"), sentence_list(F.col(f)).alias("s")) for f in fields]
        rows = few.select("doc_id", F.explode(F.array(*parts)).alias("p")).select("doc_id", "p.field", F.explode("p.s").alias("sentence"))
    inside = F.exists(simple_tokens(F.col("sentence")), lambda t: F.contains(t, F.col("term")))
    own = rows.join(first, ["field", "doc_id"]).where(inside).select("field", "term", "doc_id", "sentence").distinct()
    own = own.withColumn("r", F.row_number().over(group.orderBy(F.desc(F.size(F.split("sentence", " "))), "sentence")))
    own = own.withColumn("n", F.count("*").over(group))
    own = own.where(F.col("r") <= F.when(F.col("n") <= 3, F.col("n")).otherwise(F.floor(F.col("n") / 3.5)))
    pick = group.orderBy(F.md5(F.concat(F.lit(seed), "sentence")), "sentence")
    return own.withColumn("p", F.row_number().over(pick)).where("p = 1").select("field", "term", "doc_id", "sentence")


def check_sentences(found: DataFrame, terms: DataFrame) -> None:
    """Fails unless every term has a sentence."""
    missing = terms.select("term").distinct().join(found.select("term"), "term", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} terms have no sentence")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def shares(counts: DataFrame, by: str, value: str = "n") -> DataFrame:
    """``counts`` plus ``share`` of the group's total."""
    return counts.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(by)))


def rescaled(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """``scores`` plus ``sscore``: from 0 to 1 within each group; a constant group has 0.5."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return scores.withColumn("sscore", F.when(hi > lo, (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.5))


def box_summary(scores: DataFrame, by: list[str], value: str = "sscore") -> DataFrame:
    """Quartiles and extremes by group."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return scores.groupBy(*by).agg(F.min(value).alias("lo"), p.alias("q"), F.max(value).alias("hi"), F.count("*").alias("n")).select(
        *by, "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "hi", "n"
    )


def melt(rows: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return rows.unpivot(ids, values, "variable", "value")


def score_sentences(sentences_: DataFrame, terms: DataFrame, lang: str | None = None, ipc_prefix: str | None = None) -> DataFrame:
    """Sentences with their scoring term: (term_ref, sentence, term, field, lang, bin), of a language and of codes that start so."""
    rows = scoring_terms(terms, lang, ipc_prefix)
    return sentences_.join(rows, sentences_.term_ref == rows.id).select("term_ref", "sentence", "term", "field", "lang", "bin")


def scoring_terms(terms: DataFrame, lang: str | None = None, ipc_prefix: str | None = None) -> DataFrame:
    """The scoring terms to score: of a language, and with codes that start with ``ipc_prefix`` or without codes."""
    rows = terms.where(F.col("lang") == lang) if lang else terms
    return rows.where(F.col("ipc").startswith(ipc_prefix) if ipc_prefix else F.col("ipc").isNull())


def term_report(results: DataFrame, terms: DataFrame) -> DataFrame:
    """Results with their scoring term's bin: (term_ref, term, field, bin, impl, score)."""
    return results.join(terms.withColumnRenamed("id", "term_ref").select("term_ref", "term", "field", "bin"), "term_ref").select(
        "term_ref", "term", "field", "bin", "impl", "score"
    )


def sentence_report(results: DataFrame, sentences_: DataFrame, terms: DataFrame) -> DataFrame:
    """Results with their sentence and its scoring term's bin: (sent_ref, term_ref, field, bin, impl, score)."""
    own = sentences_.select(F.col("term_ref").alias("sent_ref"), "term_ref")
    return results.join(own, "sent_ref").join(terms.withColumnRenamed("id", "term_ref").select("term_ref", "field", "bin"), "term_ref").select(
        "sent_ref", "term_ref", "field", "bin", "impl", "score"
    )


def explain(models: DataFrame, view: View) -> DataFrame:
    """Per query and term: both models' weights with the term's statistics."""
    return models.join(view.term_stats(), "term").select("q_id", "term", "q_model", "c_model", "df", "rel_df", "tf", "rel_tf")


def verdicts(view: View, test: Column) -> DataFrame:
    """(field, term, accepted): every term of a field with a filter's verdict."""
    return view.postings.select("field", "term").distinct().withColumn("accepted", test)
