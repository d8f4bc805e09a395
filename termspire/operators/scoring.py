"""Clarity scores and BM25+, each one plan over all queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.functions.analysis import simple_tokens
from termspire.operators.retrieval import FeedbackSpec, feedback, ics_feedback, oversized, query_terms, teq_matches
from termspire.operators.view import View
from termspire.sources.store import stored

#: The texts of empty results.
REASONS = {
    "terms": "No query terms", "large": "Boolean query too large.", "documents": "No feedback documents.",
    "few": "Not enough feedback documents.", "band": "No feedback terms available after reducing by threshold.",
}


@dataclass(frozen=True)
class DcsConfig:
    weight: float = 0.6
    feedback: int = 500


@dataclass(frozen=True)
class IcsConfig:
    smoothing: float = 100.0
    beta: float = 0.6
    weight: float = 1.0
    least: int = 10
    most: int = 500
    band_low: float = 0.0
    band_high: float = 0.1


@dataclass(frozen=True)
class Bm25Config:
    k: float = 2.0
    b: float = 0.75
    delta: float = 1.0


def kl(q: Column, c: Column) -> Column:
    """An aggregate: the divergence of two weightings in bits, each normalised by its sum; pairs with a zero don't count."""
    both = (q > 0) & (c > 0)
    sq, sc = F.sum(F.when(both, q)), F.sum(F.when(both, c))
    a = F.sum(F.when(both, q * F.ln(q / c)))
    return F.coalesce((a / sq - F.ln(sq / sc)) / F.ln(F.lit(2.0)), F.lit(0.0))


def check_tuples(tuples: DataFrame) -> None:
    """Fails on null or negative weights, which no model gives."""
    bad = F.coalesce((F.col("q_model") < 0) | (F.col("c_model") < 0), F.lit(True))
    if not tuples.where(bad).isEmpty():
        raise ValueError("weights must be neither null nor negative")


def kl_decimal(tuples: DataFrame, by: str = "q_id", digits: int = 7) -> DataFrame:
    """(``by``, score) of tuples (``by``, q_model, c_model): the divergence in decimal arithmetic of ``digits`` significant digits.

    Sums are exact decimals; shares, their ratio and each summand are rounded to that many significant digits,
    half up. Like the reference's default mode it differs from :func:`kl` by about the last of these digits in each step.
    """

    def cut(x: Column) -> Column:
        scale = F.floor(F.log10(F.abs(x))) + 1
        factor = F.pow(F.lit(10.0), F.lit(float(digits)) - scale)
        return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * factor, 0) / factor)

    exact = tuples.where((F.col("q_model") > 0) & (F.col("c_model") > 0))
    sums = exact.groupBy(by).agg(*(F.sum(F.col(c).cast("decimal(38,18)")).cast("double").alias(f"sum_{c[0]}") for c in ("q_model", "c_model")))
    rows = exact.join(sums, by)
    q, c = cut(F.col("q_model") / F.col("sum_q")), cut(F.col("c_model") / F.col("sum_c"))
    part = cut(q * cut(F.log2(cut(q / c))))
    return rows.groupBy(by).agg(cut(F.sum(part.cast("decimal(38,18)")).cast("double")).alias("score"))


def scs(view: View, queries: DataFrame, id_col: str = "q_id", text_col: str = "text", tokens=simple_tokens) -> DataFrame:
    """(q_id, score): the query's term shares, unknown terms counted, against the collection."""
    terms = query_terms(queries, id_col, text_col, tokens=tokens)
    total = terms.groupBy("q_id").agg(F.sum("qtf").alias("n"))
    known = terms.join(view.term_stats().select("term", "rel_tf"), "term").join(total, "q_id")
    scores = known.groupBy("q_id").agg(kl(F.col("qtf") / F.col("n"), F.col("rel_tf")).alias("score"))
    return total.select("q_id").join(scores, "q_id", "left").select("q_id", F.coalesce("score", F.lit(0.0)).alias("score"))


@dataclass(frozen=True)
class _Parts:
    """What a model reads, each stored once: feedback with lengths, the feedback documents' model, all terms' statistics."""

    fb: DataFrame
    model: DataFrame
    stats: DataFrame


def _parts(view: View, fb: DataFrame) -> _Parts:
    """Models of other documents than feedback ones are never joined."""
    docs = stored(fb.select("doc_id").distinct(), "feedback-docs")
    model = stored(view.doc_model().join(docs, "doc_id", "left_semi"), "feedback-models")
    lengths = model.groupBy("doc_id").agg(F.sum("mtf").alias("dl"), F.count("*").alias("n_terms"))
    fb = stored(fb.select("q_id", "doc_id").join(lengths, "doc_id"), "feedback-lengths")
    return _Parts(fb, model, stored(view.term_stats(), "term-stats"))


def _weights(parts: _Parts, terms: DataFrame, p: Column, *keep: str) -> DataFrame:
    """(q_id, doc_id, w, ...): the product of P(query term | document), scaled by the query's largest; stored.

    ``p`` is over mtf (0 if absent), the document's columns and rel_tf.
    """
    own = parts.model.join(terms.select("term").distinct(), "term", "left_semi")
    pairs = parts.fb.join(terms.join(parts.stats.select("term", "rel_tf"), "term"), "q_id").join(own, ["doc_id", "term"], "left")
    lw = pairs.withColumn("mtf", F.coalesce("mtf", F.lit(0))).groupBy("q_id", "doc_id", *keep).agg(F.sum(F.col("qtf") * F.ln(p)).alias("lw"))
    top = F.max("lw").over(Window.partitionBy("q_id"))
    return stored(lw.select("q_id", "doc_id", *keep, F.exp(F.col("lw") - top).alias("w")), "weights")


def dcs_models(view: View, terms: DataFrame, fb: DataFrame, config: DcsConfig = DcsConfig()) -> DataFrame:
    """(q_id, term, q_model, c_model). Only postings of feedback documents are joined: the collection's part factors out."""
    parts, lam = _parts(view, fb), config.weight
    w = _weights(parts, terms, lam * F.col("mtf") / F.col("dl") + (1 - lam) * F.col("rel_tf"), "dl")
    total = w.groupBy("q_id").agg(F.sum("w").alias("total"))
    sums = w.join(parts.model, "doc_id").groupBy("q_id", "term").agg(F.sum(F.col("w") * F.col("mtf") / F.col("dl")).alias("s"))
    sums = sums.join(total, "q_id").join(parts.stats.select("term", "rel_tf"), "term")
    return sums.select("q_id", "term", (lam * F.col("s") + (1 - lam) * F.col("rel_tf") * F.col("total")).alias("q_model"), F.col("rel_tf").alias("c_model"))


def ics_models(view: View, terms: DataFrame, fb: DataFrame, config: IcsConfig = IcsConfig()) -> DataFrame:
    """As :func:`dcs_models`, smoothed by document and with vocabulary terms of the band only."""
    parts = _parts(view, fb)
    mu, beta, lam = config.smoothing, config.beta, config.weight
    parts = replace(parts, fb=parts.fb.select("q_id", "doc_id", (F.col("dl") + mu * F.col("n_terms")).alias("sd")))
    c = F.col("rel_tf")
    smooth = F.when(F.col("sd") > 0, (F.col("mtf") + mu * c) / F.col("sd")).otherwise(0.0)
    w = _weights(parts, terms, lam * (beta * smooth + (1 - beta) * c) + (1 - lam) * c, "sd")
    total = w.groupBy("q_id").agg(F.sum(F.col("w") * (lam * beta * mu / F.col("sd") + lam * (1 - beta) + 1 - lam)).alias("total"))
    band = parts.stats.where(F.col("rel_df").between(config.band_low, config.band_high)).select("term", "rel_tf")
    # The band goes into the model before weights spread over its rows.
    sums = w.join(parts.model.join(band, "term"), "doc_id").groupBy("q_id", "term", "rel_tf").agg(F.sum(F.col("w") * F.col("mtf") / F.col("sd")).alias("s"))
    sums = sums.join(total, "q_id")
    return sums.select("q_id", "term", (lam * beta * F.col("s") + c * F.col("total")).alias("q_model"), c.alias("c_model"))


def _result(all_q: DataFrame, terms: DataFrame, fb: DataFrame, models: DataFrame, n_fields: int, impl: str, least: int = 1) -> DataFrame:
    scores = models.groupBy("q_id").agg(kl(F.col("q_model"), F.col("c_model")).alias("score"))
    n = fb.groupBy("q_id").agg(F.count("*").alias("fb_doc_count"))
    known = terms.select("q_id").distinct().withColumn("known", F.lit(True))
    big = oversized(terms, n_fields).withColumn("big", F.lit(True))
    rows = all_q.join(known, "q_id", "left").join(big, "q_id", "left").join(n, "q_id", "left").join(scores, "q_id", "left")
    count = F.coalesce("fb_doc_count", F.lit(0))
    why = (
        F.when(F.col("known").isNull(), REASONS["terms"]).when(F.col("big").isNotNull(), REASONS["large"])
        .when(count == 0, REASONS["documents"]).when(count < least, REASONS["few"]).when(F.col("score").isNull(), REASONS["band"])
    )
    return rows.select(
        "q_id", F.lit(impl).alias("impl"), F.when(why.isNull(), F.col("score")).otherwise(0.0).alias("score"),
        why.isNotNull().alias("is_empty"), why.alias("empty_reason"), count.alias("fb_doc_count"),
    )


def dcs(
    view: View, queries: DataFrame, id_col: str = "q_id", text_col: str = "text", config: DcsConfig = DcsConfig(), fields=("claims", "detd"),
    tokens=simple_tokens, spec: FeedbackSpec | None = None,
) -> DataFrame:
    """(q_id, impl, score, is_empty, empty_reason, fb_doc_count): divergence of the feedback's relevance model."""
    terms = stored(query_terms(queries, id_col, text_col, view.by_term(), tokens), "query-terms")
    fb = stored(feedback(view, terms, spec or FeedbackSpec(most=config.feedback, fixed=True), fields), "feedback")
    return _result(queries.select(F.col(id_col).alias("q_id")), terms, fb, dcs_models(view, terms, fb, config), len(fields), "DCS")


def ics(
    view: View, queries: DataFrame, id_col: str = "q_id", text_col: str = "text", config: IcsConfig = IcsConfig(), fields=("claims", "detd"),
    tokens=simple_tokens,
) -> DataFrame:
    """As :func:`dcs` with matching-based feedback, plus the range of match counts used. Fails if the view has fewer documents than feedback needs."""
    if config.least > (n := view.doc_ids().count()):
        raise ValueError(f"{config.least} feedback documents are wanted of {n}")
    terms = stored(query_terms(queries, id_col, text_col, view.by_term(), tokens), "query-terms")
    fb = stored(ics_feedback(teq_matches(view, terms), config.least, config.most), "feedback")
    rows = _result(queries.select(F.col(id_col).alias("q_id")), terms, fb, ics_models(view, terms, fb, config), len(fields), "ICS", config.least)
    span = fb.groupBy("q_id").agg(F.min("n_match").alias("fb_terms_min"), F.max("n_match").alias("fb_terms_max"))
    return rows.join(span, "q_id", "left")


def bm25plus(view: View, terms: DataFrame, docs: DataFrame, config: Bm25Config = Bm25Config()) -> DataFrame:
    """(q_id, doc_id, score) of the pairs in ``docs``: every query term counts, delta for absent ones too."""
    total = view.collection().select("n_docs", (F.col("ttf") / F.col("n_docs")).alias("avgdl"))
    docs = stored(docs.select("q_id", "doc_id"), "ranked")
    model = stored(view.doc_model().join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "ranked-models")
    lengths = model.groupBy("doc_id").agg(F.sum("mtf").alias("dl"))
    stats = terms.join(view.by_term().select("term", "df"), "term")
    pairs = docs.join(stats, "q_id").join(lengths, "doc_id").join(model, ["doc_id", "term"], "left")
    pairs = pairs.crossJoin(F.broadcast(total)).withColumn("mtf", F.coalesce("mtf", F.lit(0)))  # one row
    k, b = config.k, config.b
    part = F.log10((F.col("n_docs") + 1) / F.col("df")) * F.col("mtf") * (k + 1) / (F.col("mtf") + k * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return pairs.groupBy("q_id", "doc_id").agg(F.sum(F.col("qtf") * (part + config.delta)).alias("score"))


def bm25_sentinel(queries: DataFrame, terms: DataFrame, id_col: str = "q_id") -> DataFrame:
    """(q_id, -1, -1) for queries without terms."""
    none = queries.select(F.col(id_col).alias("q_id")).join(terms.select("q_id"), "q_id", "left_anti")
    return none.select("q_id", F.lit(-1).cast("long").alias("doc_id"), F.lit(-1.0).alias("score"))


#: Scorers by name, with the configuration that each takes.
SCORERS = {"SCS": (scs, None), "DCS": (dcs, DcsConfig), "ICS": (ics, IcsConfig)}


def scorer(name: str, view: View | None = None, config=None, fields: tuple[str, ...] = ("claims", "detd"), tokens=simple_tokens):
    """The scorer with what it needs checked: a function of queries (q_id, text).

    Fails on an unknown name, a missing view, another scorer's configuration, or fields that the view doesn't have.
    """
    if name.upper() not in SCORERS:
        raise ValueError(f"no scorer named {name}")
    run, kind = SCORERS[name.upper()]
    if view is None:
        raise ValueError("a scorer needs a view")
    if config is not None and (kind is None or not isinstance(config, kind)):
        raise ValueError(f"{name} takes {kind.__name__ if kind else 'no configuration'}")
    view.check_fields(fields)
    if kind is None:
        return lambda queries: run(view, queries, tokens=tokens)
    return lambda queries: run(view, queries, config=config or kind(), fields=fields, tokens=tokens)
