"""The stages as commands: python -m termspire.cli STAGE --index PATH --db PATH ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.functions import ipc
from termspire.functions import termfilters as tf
from termspire.functions.analysis import STEMMERS, bare_tokens, language, language_tokens, simple_tokens
from termspire.operators import retrieval as R
from termspire.operators import scoring as S
from termspire.operators.view import View
from termspire.plans import runs
from termspire.plans import tables as P
from termspire.sources import corpus, paged, segments, sinks, store


def _stop(spark: SparkSession, a: argparse.Namespace, lang: str) -> list[str]:
    if not a.stop_dir:
        return []
    return [r.term for r in corpus.read_stopwords(spark, corpus.stopword_path(a.stop_dir, a.stop_pattern, lang), a.stop_form).collect()]


def _tokens(spark: SparkSession, a: argparse.Namespace, lang: str):
    if a.analyzer == "simple":
        return simple_tokens
    return (language_tokens if a.analyzer == "language" else bare_tokens)(lang, _stop(spark, a, lang))


def _code(a: argparse.Namespace) -> ipc.Code | None:
    return ipc.Code(*(None if v == "" else int(v) if v.isdigit() else v for v in a.ipc.split(","))) if a.ipc else None


def _docs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs = segments.read_rows(spark, a.index).where(F.col("lang") == a.lang)
    return docs.where(ipc.standard_restriction(F.col("ipc"), _code(a), a.separator)) if a.ipc else docs


def _view(spark: SparkSession, a: argparse.Namespace) -> View:
    view = View.open(spark, a.index, a.lang)
    view = view.documents(_docs(spark, a)) if a.ipc else view
    return view.fields(a.fields) if set(a.fields) != set(corpus.FIELDS) else view


def _source(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    """The documents of a folder, of files of records or of a service, and the languages that are analysed."""
    if a.source.startswith(("http://", "https://")):
        url, _, name = a.source.rstrip("/").rpartition("/")
        return paged.read_paged_documents(spark, url, name, a.lang, slices=a.slices, pause=a.pause).withColumnRenamed("pat_id", "doc_id"), [a.lang]
    if a.json:
        return corpus.read_json_documents(spark, a.source, a.lang).withColumnRenamed("pat_id", "doc_id"), [a.lang]
    return corpus.read_corpus(spark, a.source), list(STEMMERS)


def build_index(spark, a):
    """Documents of each language, analysed, into a new index."""
    docs, langs = _source(spark, a)
    store.remove(spark, f"{a.index}/docs")
    segments.put_rows(docs, a.index, 0)
    segments.write_index(segments.read_rows(spark, a.index), a.index, by_language={lang: _tokens(spark, a, lang) for lang in langs})
    return View.open(spark, a.index, a.lang).by_field()


def add_documents(spark, a):
    """More documents, or new versions of some, as a segment of the index."""
    docs, langs = _source(spark, a)
    number = segments.latest(spark, a.index).next_number
    segments.put_rows(docs, a.index, number)
    own = spark.read.parquet(f"{a.index}/docs/number={number}")
    segments.add_documents(own, a.index, by_language={lang: _tokens(spark, a, lang) for lang in langs})
    return View.open(spark, a.index, a.lang).by_field()


def delete_documents(spark, a):
    """Documents go whose ids a file has, one a line."""
    commit = segments.latest(spark, a.index)
    ids = spark.read.text(a.source).select(F.nullif(F.trim("value"), F.lit("")).try_cast(commit.id_type).alias("doc_id")).where("doc_id is not null")
    segments.delete_documents(ids, a.index)
    segments.drop_rows(ids, a.index, commit.next_number)
    return View.open(spark, a.index, a.lang).by_field()


def merge(spark, a):
    """Small segments become one; what no reader needs any more goes with --vacuum."""
    segments.merge_segments(spark, a.index, a.below)
    if a.vacuum:
        segments.vacuum(spark, a.index)
    return segments.segment_sizes(spark, a.index).orderBy("seg")


def dump_terms(spark, a):
    return runs.dump_terms(spark, a.db, _view(spark, a), a.lang, a.threshold, _stop(spark, a, a.lang), a.ipc)


def sample_terms(spark, a):
    return runs.sample_terms(spark, a.db, a.fields[0], a.lang, a.bins, a.size, a.picks, a.ipc, a.threshold)


def sentences(spark, a):
    return runs.extract_sentences(spark, a.db, _docs(spark, a), a.fields[0], a.lang, learned=a.learned)


def score(spark, a):
    view, tokens = _view(spark, a), _tokens(spark, a, a.lang)
    names = sorted(S.SCORERS) if a.impl == "ALL" else [a.impl]
    return [runs.score(spark, a.db, view, name, a.what, a.lang, tuple(a.fields), None, a.ipc, tokens) for name in names][-1]


def score_ics(spark, a):
    config = S.IcsConfig(least=a.least, most=a.most, band_high=a.band_high)
    return runs.score(spark, a.db, _view(spark, a), "ICS", a.what, a.lang, tuple(a.fields), config, a.ipc, _tokens(spark, a, a.lang))


def score_bm25(spark, a):
    return runs.score_bm25(spark, a.db, _view(spark, a), a.what, a.lang, tuple(a.fields), a.amount, a.ipc, _tokens(spark, a, a.lang))


def analyze_ics(spark, a):
    return runs.analyze_ics(spark, a.db, _view(spark, a), a.query, S.IcsConfig(least=a.least, most=a.most, band_high=a.band_high))


def ipc_stats(spark, a):
    docs = _docs(spark, a)
    own = {"ipc_all": P.ipc_all(docs, a.separator), "ipc_distribution": P.ipc_distribution(docs, a.separator), "ipc_sections": P.ipc_sections(docs),
           "ipc_perdocument": P.ipc_per_document(docs), "ipc_docfieldcount": P.ipc_field_counts(docs, a.fields)}
    for name, rows in own.items():
        sinks.insert(rows.withColumnRenamed("n", "count"), a.db, name, ignore=True)
    return P.by_key(sinks.read(spark, a.db, "ipc_perdocument"), "codes")


def ipcs(spark, a):
    return P.ipc_list(_docs(spark, a), _code(a), a.separator).orderBy("code")


def idx_stats(spark, a):
    return sinks.insert(_view(spark, a).by_field(), a.db, "idx_stats")


def common_terms(spark, a):
    rows = P.common_term_dump(_view(spark, a), a.threshold)
    sinks.write_csv(rows.select("term", F.col("rel_df").alias("relDF")), f"{a.db}/common_terms.csv")
    return rows.orderBy(F.desc("rel_df"), "term")


def term_filter(spark, a):
    return P.verdicts(_view(spark, a), tf.simple_filter(F.col("term"))).orderBy("field", "term")


def check_feedback(spark, a):
    view = _view(spark, a)
    queries = spark.createDataFrame([(1, a.query)], "q_id long, text string")
    terms = R.query_terms(queries, "q_id", "text", view.by_term(), _tokens(spark, a, a.lang))
    return R.inspect_feedback(view, R.feedback(view, terms, R.FeedbackSpec(1, a.most, kind="CTQ"), tuple(a.fields))).orderBy("doc_id", "field")


#: Each command with the table that it writes, whose metadata row says so.
STAGES = {
    "index": (build_index, None), "add": (add_documents, None), "delete": (delete_documents, None), "merge": (merge, None), "dump-terms": (dump_terms, "terms"), "sample": (sample_terms, "scoring_terms"), "sentences": (sentences, "scoring_sentences"),
    "score": (score, "scoring_results"), "score-ics": (score_ics, "scoring_results"), "score-bm25": (score_bm25, "scoring_results_bm25"),
    "analyze-ics": (analyze_ics, "fb_docs"), "ipc-stats": (ipc_stats, "ipc_all"), "ipcs": (ipcs, None), "idx-stats": (idx_stats, "idx_stats"),
    "common-terms": (common_terms, "common_terms"), "term-filter": (term_filter, None), "feedback": (check_feedback, None),
}


def parse(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="termspire")
    p.add_argument("stage", choices=sorted(STAGES))
    p.add_argument("--index", required=True)
    p.add_argument("--db", default=None, help="folder of the result tables")
    p.add_argument("--source", help="what the index is built from: a folder, files of records, or http://service/index")
    p.add_argument("--json", action="store_true", help="the source holds JSON records")
    p.add_argument("--below", type=int, help="documents of segments that are merged, at most; all of them without it")
    p.add_argument("--vacuum", action="store_true")
    p.add_argument("--learned", action="store_true", help="sentences by a model of the texts' abbreviations and sentence starts")
    p.add_argument("--slices", type=int, default=8, help="tasks that read a service")
    p.add_argument("--pause", type=float, default=0.1, help="unit of the pauses between requests, in seconds")
    p.add_argument("--lang", default="en")
    p.add_argument("--fields", nargs="+", default=list(corpus.FIELDS))
    p.add_argument("--ipc", help="section,class,subclass,maingroup,subgroup; later parts may lack")
    p.add_argument("--separator", default="-")
    p.add_argument("--analyzer", choices=("simple", "bare", "language"), default="simple")
    p.add_argument("--stop-dir")
    p.add_argument("--stop-pattern", default="stop")
    p.add_argument("--stop-form", default="snowball", choices=("plain", "snowball"))
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--bins", type=int, default=6)
    p.add_argument("--size", type=int, default=50)
    p.add_argument("--picks", type=int, nargs="+", default=[2, 4, 6])
    p.add_argument("--what", choices=("terms", "sentences"), default="terms")
    p.add_argument("--impl", default="SCS", type=str.upper, choices=["ALL", *sorted(S.SCORERS)])
    p.add_argument("--least", type=int, default=10)
    p.add_argument("--most", type=int, default=500)
    p.add_argument("--band-high", type=float, default=0.1)
    p.add_argument("--amount", type=int, default=10)
    p.add_argument("--query")
    a = p.parse_args(args)
    if language(a.lang) is None:
        p.error(f"no analyzer for {a.lang}")
    a.lang = language(a.lang)
    for need, stages in (("db", [k for k, (_, t) in STAGES.items() if t]), ("query", ["analyze-ics", "feedback"]), ("source", ["index", "add", "delete"])):
        if a.stage in stages and not getattr(a, need):
            p.error(f"{a.stage} needs --{need}")
    return a


def run(spark: SparkSession, args: list[str]) -> DataFrame:
    a = parse(args)
    stage, table = STAGES[a.stage]
    out = stage(spark, a)
    if table:
        sinks.log_stage(spark, a.db, table, " ".join(args))
    return out


if __name__ == "__main__":
    run(SparkSession.builder.appName("termspire").getOrCreate(), sys.argv[1:]).show(1000, truncate=False)
