"""The scoring pipeline over result tables: dump, sample, sentences, scores, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.functions.analysis import simple_tokens
from termspire.operators import retrieval as R
from termspire.operators import scoring as S
from termspire.operators import sentences as sent
from termspire.operators.view import View
from termspire.plans import tables as P
from termspire.sources import sinks


def dump_terms(spark: SparkSession, root: str, view: View, lang: str, threshold: float = 0.0, stop=(), ipc: str | None = None) -> DataFrame:
    """Terms of each field above the threshold, into ``terms``."""
    rows = P.term_dump(view, threshold, stop).select(
        "field", "term", F.lit(lang).alias("lang"), F.col("rel_df").alias("docfreq_rel"), F.col("df").alias("docfreq_abs"), F.lit(ipc).cast("string").alias("ipc")
    )
    return sinks.insert(rows, root, "terms", ignore=True)


def sample_terms(
    spark: SparkSession, root: str, field: str, lang: str, bins: int = 6, size: int = 50, picks=(2, 4, 6), ipc: str | None = None, least: float = 0.0
) -> DataFrame:
    """Scoring terms of a field from the picked bins, into ``scoring_terms``, and the bins into ``term_segments``.

    Terms need a relative document frequency of ``least``; without any the run fails.
    """
    rows = sinks.read(spark, root, "terms").where((F.col("field") == field) & (F.col("lang") == lang) & (F.col("docfreq_rel") >= least))
    rows = rows.where(F.col("ipc").startswith(ipc) if ipc else F.col("ipc").isNull())
    sample = P.term_sample(rows.select("term", F.col("docfreq_rel").alias("rel_df")), bins, size, picks)
    section = F.lit(ipc).cast("string")
    segments = sample.groupBy(F.col("bin").alias("segment")).agg(
        F.min("bin_min").alias("docfreq_rel_min"), F.max("bin_max").alias("docfreq_rel_max"), F.count("*").alias("term_count")
    )
    sinks.insert(segments.withColumns({"field": F.lit(field), "lang": F.lit(lang), "section": section}), root, "term_segments", ignore=True)
    own = sample.join(rows.select("term", "docfreq_abs"), "term").select(
        term_id(field, lang, ipc).alias("id"), "term", F.lit(lang).alias("lang"), F.lit(field).alias("field"),
        F.col("rel_df").alias("docfreq_rel"), "docfreq_abs", "bin", section.alias("ipc"),
    )
    return sinks.insert(own, root, "scoring_terms", ignore=True)


def term_id(field: str, lang: str, ipc: str | None = None):
    return F.md5(F.concat_ws("|", F.lit(field), F.lit(lang), F.lit(ipc or ""), "term", F.col("bin").cast("string")))


def extract_sentences(spark: SparkSession, root: str, docs: DataFrame, field: str, lang: str, seed: str = "0", learned: bool = False) -> DataFrame:
    """A sentence for each scoring term of the field, into ``scoring_sentences``; fails if a term has none.

    ``learned`` sentences are those of a model of the field's texts.
    """
    terms = P.scoring_terms(sinks.read(spark, root, "scoring_terms"), lang).where(F.col("field") == field)
    found = P.sentences(docs, terms, (field,), seed, model=sent.learn(docs, (field,)) if learned else None)
    P.check_sentences(found, terms)
    rows = found.select("term", "sentence").join(terms.select("term", "id"), "term")
    return sinks.insert(rows.select("sentence", F.col("id").alias("term_ref")), root, "scoring_sentences", ignore=True)


def _items(spark: SparkSession, root: str, what: str, lang: str, ipc: str | None) -> DataFrame:
    """(q_id, text): scoring terms or sentences."""
    terms = sinks.read(spark, root, "scoring_terms")
    if what == "terms":
        rows = P.scoring_terms(terms, lang, ipc).select(F.col("id").alias("q_id"), F.col("term").alias("text"))
    elif what == "sentences":
        own = P.score_sentences(sinks.read(spark, root, "scoring_sentences"), terms, lang, ipc)
        rows = own.select(F.col("term_ref").alias("q_id"), F.col("sentence").alias("text"))
    else:
        raise ValueError("terms or sentences are scored")
    return rows


def score(
    spark: SparkSession, root: str, view: View, impl: str, what: str, lang: str, fields: tuple[str, ...], config=None, ipc: str | None = None, tokens=simple_tokens
) -> DataFrame:
    """Score all scoring terms or sentences at once and write the results; returns the result table."""
    named = ",".join(fields)
    run = S.scorer(impl, view.fields(fields) if set(fields) != {"claims", "detd"} else view, config, fields, tokens)
    rows = run(_items(spark, root, what, lang, ipc)).withColumns({"q_fields": F.lit(named), "q_ipc": F.lit(ipc).cast("string"), "impl": F.lit(impl.upper())})
    if impl.upper() == "ICS":
        rows = rows.withColumn("icsconf_ref", F.lit(sinks.register_run(spark, root, config or S.IcsConfig(), named, ipc)))
    ref, table = ("term_ref", "scoring_terms_results") if what == "terms" else ("sent_ref", "scoring_sentence_results")
    if "is_empty" not in rows.columns:
        rows = rows.withColumn("is_empty", F.lit(False))
    return sinks.insert(rows.withColumnRenamed("q_id", ref), root, table, ignore=True)


def score_bm25(spark: SparkSession, root: str, view: View, what: str, lang: str, fields: tuple[str, ...], amount: int = 10, ipc: str | None = None, tokens=simple_tokens) -> DataFrame:
    """The best documents of each scoring term or sentence with their scores; a query without terms gets document -1."""
    queries = _items(spark, root, what, lang, ipc)
    terms = R.query_terms(queries, "q_id", "text", view.by_term(), tokens)
    rows = S.bm25plus(view, terms, R.top_n(R.tfidf(view, terms), amount)).unionByName(S.bm25_sentinel(queries, terms))
    ref, table = ("term_ref", "scoring_terms_results_bm25") if what == "terms" else ("sent_ref", "scoring_sentence_results_bm25")
    rows = rows.withColumnRenamed("q_id", ref).withColumns({"q_fields": F.lit(",".join(fields)), "q_ipc": F.lit(ipc).cast("string")})
    return sinks.insert(rows, root, table, ignore=True)


def analyze_ics(spark: SparkSession, root: str, view: View, text: str, config: S.IcsConfig = S.IcsConfig()) -> DataFrame:
    """Feedback documents, feedback terms and their statistics of one query, into tables of their own; returns the explanation."""
    queries = spark.createDataFrame([(1, text)], "q_id long, text string")
    terms = R.query_terms(queries, "q_id", "text", view.by_term())
    fb = R.ics_feedback(R.teq_matches(view, terms), config.least, config.most)
    rows = P.explain(S.ics_models(view, terms, fb, config), view)
    sinks.put_value(spark, root, "query", text)
    sinks.insert(fb.select("doc_id"), root, "fb_docs")
    sinks.insert(rows.select(F.col("term").alias("term_ref"), "q_model", "c_model"), root, "fb_terms")
    stats = rows.select("term", F.col("rel_df").alias("df_rel"), "df", F.col("rel_tf").alias("tf_rel"), "tf")
    sinks.insert(stats, root, "term_stats")
    best = rows.groupBy().agg(S.kl(F.col("q_model"), F.col("c_model")).alias("score")).first()["score"]
    sinks.put_value(spark, root, "score", best)
    return rows
