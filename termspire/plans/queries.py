"""The registered queries of the engine and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.functions import ipc, scalar
from termspire.functions import termfilters as tf
from termspire.functions.analysis import STEMMERS, analyze, bare_tokens, language_tokens, simple_tokens, word_count
from termspire.operators import retrieval as R
from termspire.operators import scoring as S
from termspire.operators import sentences as sent
from termspire.operators.view import View
from termspire.plans import tables as P
from termspire.sources import segments, store
from termspire.sources.corpus import FIELDS, counts, read_corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str | None = None):
    """Register a query with its SQL, which continues the shared part or ``base``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "WITH RECURSIVE " + (base or _BASE) + sql
        return f

    return add


# The shared part of the SQL: the corpus, its postings in English, and their statistics.

_CODE = (
    "chr(cast(65 + {i} % 8 AS int)) || lpad(cast(1 + {i} % 99 AS varchar), 2, '0') || chr(cast(65 + {i} % 26 AS int)) || "
    "lpad(cast(1 + {i} % 9999 AS varchar), 4, '0') || '-' || lpad(cast({i} % 10000 AS varchar), 4, '0')"
)
_INDEX = rf"""corpus AS (
  SELECT doc_id, lang, split_part(text, chr(10), 1) AS claims,
         nullif(substr(text, length(split_part(text, chr(10), 1)) + 2), '') AS detd,
         list_filter([{_CODE.format(i="doc_id")}, CASE WHEN doc_id % 3 = 0 THEN {_CODE.format(i="(doc_id + 3)")} END,
           CASE doc_id % 50 WHEN 0 THEN 'A00B' WHEN 1 THEN 'X99' END], lambda c: c IS NOT NULL) AS ipc
  FROM documents WHERE lang IN ('de', 'en', 'fr')),
tok AS (
  SELECT doc_id, field, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS term
  FROM (SELECT doc_id, unnest(['claims', 'detd']) AS field, unnest([claims, detd]) AS t FROM corpus WHERE lang = 'en')),
post AS (SELECT doc_id, field, term, count(*) AS tf FROM tok GROUP BY ALL),
coll AS (SELECT sum(tf) AS ttf, count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_uniq FROM post),
ft AS (SELECT field, term, sum(tf) AS tf, count(*) AS df FROM post GROUP BY ALL),
ts AS (
  SELECT term, sum(tf) AS tf, max(df) AS df, sum(tf) / max(ttf)::double AS rel_tf, max(df) / max(n_docs)::double AS rel_df
  FROM ft, coll GROUP BY term),
dm AS (SELECT doc_id, term, count(*) AS mtf FROM post GROUP BY ALL),
dl AS (SELECT doc_id, sum(mtf) AS dl, count(*) AS n_terms FROM dm GROUP BY doc_id),
"""
_QUERIES = r"""qt0 AS (
  SELECT item_id AS q_id, term, count(*) AS qtf
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM <items>) GROUP BY ALL),
qt AS (SELECT * FROM qt0 WHERE term IN (SELECT term FROM ts)),
teq AS (
  SELECT q_id, doc_id, count(DISTINCT term) AS n_match, any_value(n_unique) AS n_unique
  FROM post JOIN qt USING (term) JOIN (SELECT q_id, count(*) AS n_unique FROM qt GROUP BY q_id) USING (q_id) GROUP BY q_id, doc_id),
len AS (SELECT doc_id, field, 1 / sqrt(sum(tf)::double) AS x, pow(2.0, floor(log2(1 / sqrt(sum(tf)::double)) + 1e-12)) AS p FROM post GROUP BY doc_id, field),
idf AS (SELECT field, term, 1 + ln(n_docs / (df + 1)::double) AS idf FROM ft, coll),
tfidf AS (
  SELECT q_id, doc_id, round(sum(sqrt(tf::double) * idf * idf * p * (1 + floor((x / p - 1) * 8 + 1e-9) / 8)), 6) AS score
  FROM post JOIN idf USING (field, term) JOIN qt USING (term) JOIN len USING (doc_id, field) GROUP BY q_id, doc_id),
lev AS (SELECT q_id, doc_id, n_unique - n_match AS level, score FROM teq JOIN tfidf USING (q_id, doc_id)),
lsz AS (SELECT q_id, level, coalesce(sum(count(*)) OVER (PARTITION BY q_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
        FROM lev GROUP BY q_id, level)
"""
_BASE = _INDEX + _QUERIES.replace("<items>", "benchmark")


def fb_sql(name: str, least: int, most: int) -> str:
    return f""", {name} AS (
  SELECT q_id, doc_id, level FROM (
    SELECT q_id, doc_id, level, row_number() OVER (PARTITION BY q_id ORDER BY level,
      CASE WHEN level = 0 THEN -score ELSE score END, CASE WHEN level = 0 THEN doc_id ELSE -doc_id END) AS r
    FROM lev JOIN lsz USING (q_id, level) WHERE level = 0 OR above < {least}) WHERE r <= {most})"""


_FIXED = (
    fb_sql("fb1", 500, 500)
    + """, fill AS (
  SELECT q_id, doc_id FROM (
    SELECT q_id, doc_id, n, row_number() OVER (PARTITION BY q_id ORDER BY md5(cast(doc_id AS varchar)), doc_id) AS r
    FROM (SELECT q.q_id, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT q_id FROM qt) q LEFT JOIN (SELECT q_id, count(*) AS n FROM fb1 GROUP BY q_id) c USING (q_id)),
         (SELECT DISTINCT doc_id FROM post) d WHERE (q_id, doc_id) NOT IN (SELECT (q_id, doc_id) FROM fb1)) WHERE r <= 500 - n),
fb AS (SELECT q_id, doc_id, level FROM fb1 UNION ALL SELECT q_id, doc_id, -1 FROM fill)"""
)
_KL = "(sum(q * ln(q / c)) / sum(q) - ln(sum(q) / sum(c))) / ln(2.0)"
_DCS = _FIXED + """, lw AS (
  SELECT q_id, doc_id, sum(qtf * ln(0.6 * coalesce(mtf, 0) / dl + 0.4 * rel_tf)) AS lw
  FROM fb JOIN qt USING (q_id) JOIN ts USING (term) JOIN dl USING (doc_id) LEFT JOIN dm USING (doc_id, term) GROUP BY q_id, doc_id),
w AS (SELECT q_id, doc_id, exp(lw - max(lw) OVER (PARTITION BY q_id)) AS w FROM lw),
models AS (
  SELECT q_id, term, 0.6 * s + 0.4 * rel_tf * total AS q, rel_tf AS c
  FROM (SELECT q_id, term, sum(w * mtf / dl) AS s FROM w JOIN dl USING (doc_id) JOIN dm USING (doc_id) GROUP BY q_id, term)
  JOIN (SELECT q_id, sum(w) AS total FROM w GROUP BY q_id) USING (q_id) JOIN ts USING (term))
"""
_ICS = """, top AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n_match DESC, doc_id) AS r FROM teq),
grp AS (
  SELECT q_id, n_match, coalesce(sum(count(*)) OVER (PARTITION BY q_id ORDER BY n_match DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
  FROM top WHERE r <= 500 GROUP BY q_id, n_match),
fb AS (SELECT q_id, doc_id, n_match FROM top JOIN grp USING (q_id, n_match) WHERE r <= 500 AND above < 10),
lw AS (
  SELECT q_id, doc_id, sum(qtf * ln(0.6 * (coalesce(mtf, 0) + 100 * rel_tf) / (dl + 100 * n_terms) + 0.4 * rel_tf)) AS lw
  FROM fb JOIN qt USING (q_id) JOIN ts USING (term) JOIN dl USING (doc_id) LEFT JOIN dm USING (doc_id, term) GROUP BY q_id, doc_id),
w AS (SELECT q_id, doc_id, exp(lw - max(lw) OVER (PARTITION BY q_id)) AS w, dl + 100 * n_terms AS sd FROM lw JOIN dl USING (doc_id)),
models AS (
  SELECT q_id, term, 0.6 * s + rel_tf * total AS q, rel_tf AS c, df, rel_df, tf, rel_tf
  FROM (SELECT q_id, term, sum(w * mtf / sd) AS s FROM w JOIN dm USING (doc_id) GROUP BY q_id, term)
  JOIN (SELECT q_id, sum(w * (60 / sd + 0.4)) AS total FROM w GROUP BY q_id) USING (q_id) JOIN ts USING (term) WHERE rel_df <= 0.1)
"""


_BUILT: dict[tuple[str, str], tuple[str, str]] = {}


def index_of(spark: SparkSession, sf_dir: str) -> str:
    """The index of a folder's documents, which a session builds once: again if the documents changed or the index is gone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    state = store.state(spark, f"{sf_dir}/documents.parquet")
    path, built = _BUILT.get(key, ("", ""))
    if built != state or not store.exists(spark, f"{path}/commits"):
        path = store.fresh_path(spark, "index")
        segments.write_index(read_corpus(spark, sf_dir), path)
        _BUILT[key] = (path, state)
    return path


def view(spark: SparkSession, sf_dir: str, lang: str = "en") -> View:
    """A language's view of the folder's index."""
    return View.open(spark, index_of(spark, sf_dir), lang)


def segmented(spark: SparkSession, sf_dir: str, merged: bool = False) -> View:
    """The English documents in an index that grew: three in four first, then the rest and new versions of some, with the fields
    changed over; then some were deleted."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}|{merged}")
    state = store.state(spark, f"{sf_dir}/documents.parquet")
    path, built = _BUILT.get(key, ("", ""))
    if built != state or not store.exists(spark, f"{path}/commits"):
        path, docs = store.fresh_path(spark, "segments"), read_corpus(spark, sf_dir).where("lang = 'en'").drop("ipc")
        segments.write_index(docs.where("doc_id % 4 <> 3"), path)
        changed = docs.where("doc_id % 20 = 0").select("doc_id", "lang", F.col("detd").alias("claims"), F.col("claims").alias("detd"))
        segments.add_documents(docs.where("doc_id % 4 = 3").unionByName(changed), path)
        segments.delete_documents(docs.where("doc_id % 31 = 7"), path)
        if merged:
            segments.merge_segments(spark, path)
        _BUILT[key] = (path, state)
    return View.open(spark, path, "en")


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("q_id"), "text")


def _q(spark: SparkSession, sf_dir: str) -> tuple[View, DataFrame, DataFrame]:
    v, q = view(spark, sf_dir), bench(spark, sf_dir)
    return v, q, store.stored(R.query_terms(q, "q_id", "text", v.by_term()), "query-terms")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query(f"""SELECT q_id, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT q_id FROM qt0)
LEFT JOIN (SELECT q_id, {_KL} AS score FROM (SELECT q_id, qtf / n::double AS q, rel_tf AS c FROM qt JOIN (
  SELECT q_id, sum(qtf) AS n FROM qt0 GROUP BY q_id) USING (q_id) JOIN ts USING (term)) GROUP BY q_id) USING (q_id)""")
def scs_benchmark(spark, sf_dir):
    return S.scs(view(spark, sf_dir), bench(spark, sf_dir)).select("q_id", *r6("score"))


@query("""SELECT field, CAST(sum(tf) AS BIGINT) AS ttf, count(DISTINCT term) AS utf, count(DISTINCT doc_id) AS docs
FROM post GROUP BY GROUPING SETS ((field), ())""")
def idx_stats(spark, sf_dir):
    return view(spark, sf_dir).by_field()


_GROWN = """, seg AS (
  SELECT doc_id, term, tf, CASE WHEN doc_id % 20 <> 0 THEN field WHEN field = 'claims' THEN 'detd' ELSE 'claims' END AS field,
         CASE WHEN doc_id % 4 = 3 OR doc_id % 20 = 0 THEN 2 ELSE 1 END AS s
  FROM post WHERE doc_id % 31 <> 7)
SELECT term, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(df) AS BIGINT) AS df, round(sum(df) / (SELECT count(DISTINCT doc_id) FROM seg)::double, 9) AS rel_df FROM (
  SELECT s, term, sum(tf) AS tf, max(df) AS df FROM (SELECT <s> AS s, term, field, sum(tf) AS tf, count(*) AS df FROM seg GROUP BY ALL) GROUP BY ALL)
GROUP BY term"""


@query(_GROWN.replace("<s>", "s"))
def segment_stats(spark, sf_dir):
    """Of each segment the largest field counts, and segments add up."""
    return segmented(spark, sf_dir).term_stats().select("term", "tf", "df", F.round("rel_df", 9).alias("rel_df"))


@query(_GROWN.replace("<s>", "1"))
def segment_merge(spark, sf_dir):
    """After a merge all documents are in one segment."""
    return segmented(spark, sf_dir, merged=True).term_stats().select("term", "tf", "df", F.round("rel_df", 9).alias("rel_df"))


@query("SELECT term, CAST(tf AS BIGINT) AS tf, df, round(rel_tf, 9) AS rel_tf, round(rel_df, 9) AS rel_df FROM ts")
def term_stats(spark, sf_dir):
    return view(spark, sf_dir).term_stats().select("term", "tf", "df", F.round("rel_tf", 9).alias("rel_tf"), F.round("rel_df", 9).alias("rel_df"))


@query("SELECT doc_id, term, mtf, round(mtf / dl::double, 9) AS rel_mtf FROM dm JOIN dl USING (doc_id)")
def doc_model(spark, sf_dir):
    v = view(spark, sf_dir)
    return v.doc_model().join(v.doc_lengths(), "doc_id").select("doc_id", "term", "mtf", F.round(F.col("mtf") / F.col("dl"), 9).alias("rel_mtf"))


@query("SELECT DISTINCT doc_id, field, term FROM post")
def doc_terms(spark, sf_dir):
    return view(spark, sf_dir).doc_terms(FIELDS)


@query("""SELECT DISTINCT q_id, term FROM post JOIN (
  SELECT q_id, doc_id FROM tfidf QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) <= 5) USING (doc_id)""")
def fb_vocabulary(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return v.vocabulary(R.top_n(R.tfidf(v, terms), 5))


@query("""SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM post WHERE field = 'claims' GROUP BY term""")
def view_field(spark, sf_dir):
    return view(spark, sf_dir).fields(["claims"]).field_terms().select("term", "tf", "df")


@query("""SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(DISTINCT doc_id) AS df FROM post
WHERE doc_id IN (SELECT doc_id FROM corpus WHERE len(list_filter(ipc, lambda c: regexp_matches(c, '^[Aa]'))) > 0) GROUP BY term""")
def view_doc_filter(spark, sf_dir):
    keep = read_corpus(spark, sf_dir).where(ipc.class_match(F.col("ipc"), ipc.Code("A")))
    return view(spark, sf_dir).documents(keep).postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count_distinct("doc_id").alias("df"))


@query("""SELECT CAST(sum(tf) AS BIGINT) AS ttf, count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_uniq FROM post
WHERE NOT regexp_matches(term, '^[0-9]') AND length(term) > 3""")
def view_term_filter(spark, sf_dir):
    return view(spark, sf_dir).terms(lambda t: tf.not_starting(t, "DIGIT") & (F.length(t) > 3)).collection()


@query("SELECT DISTINCT doc_id FROM post WHERE field = 'claims' AND doc_id NOT IN (SELECT doc_id FROM post WHERE field = 'detd')")
def has_field_filter(spark, sf_dir):
    return view(spark, sf_dir).having_field("detd", negate=True).doc_ids()


@query("""SELECT term, round(n / n_docs::double, 9) AS rel FROM (SELECT term, count(DISTINCT doc_id) AS n FROM post GROUP BY term), coll
WHERE n / n_docs::double <= 0.34""")
def common_terms_filter(spark, sf_dir):
    return tf.common_terms(view(spark, sf_dir).postings, 0.34).select("term", F.round("rel", 9).alias("rel"))


STOP = ["the", "of", "and", "in", "a", "to"]


@query(f"SELECT term, CAST(tf AS BIGINT) AS tf FROM ts WHERE term NOT IN ({', '.join(map(repr, STOP))})")
def stopword_filter(spark, sf_dir):
    return view(spark, sf_dir).terms(lambda t: tf.not_in(t, STOP)).term_stats().select("term", "tf")


_COUNT = "length(regexp_replace(term, '[^{}]', '', 'g'))"
_ALPHA, _DIGIT, _ASCII = _COUNT.format("A-Za-z"), _COUNT.format("0-9"), r"length(regexp_replace(term, '[^\x00-\x7F]', '', 'g'))"
_GREEK = r"length(regexp_replace(term, '[^\x{0370}-\x{03FF}]', '', 'g'))"
_WORDS = "(SELECT DISTINCT term FROM (SELECT term FROM post UNION ALL SELECT unnest(string_split(lower(props), '\"')) FROM events))"
_REPEAT = " OR ".join(f"contains(term, '{c * 3}')" for c in "abcdefghijklmnopqrstuvwxyz0123456789_")
_UNIT = tf.UNIT.replace("'", "''")
_TESTS = {
    "filter_starts_digit": ("NOT regexp_matches(term, '^[0-9]')", lambda t: tf.not_starting(t, "DIGIT")),
    "filter_starts_punct": ("NOT regexp_matches(term, '^[[:punct:]]')", lambda t: tf.not_starting(t, "PUNCT")),
    "filter_starts_alpha": ("NOT regexp_matches(term, '^[A-Za-z]')", lambda t: tf.not_starting(t, "ALPHA")),
    "filter_starts_alphanum": ("NOT regexp_matches(term, '^[A-Za-z0-9]')", lambda t: tf.not_starting(t, "ALPHANUM")),
    "filter_repetition": (f"NOT ({_REPEAT})", lambda t: tf.not_repeating(t, 3)),
    "filter_alpha_count": (f"{_ALPHA} >= 3", lambda t: tf.alpha_at_least(t, 3)),
    "filter_number_with_unit": (
        f"NOT (regexp_matches(term, '^(?:{_UNIT})') AND CASE WHEN {_ALPHA} > 0 THEN {_DIGIT} / {_ALPHA}::double >= 0.2 ELSE {_DIGIT} > 0 END)",
        lambda t: tf.not_number_with_unit(t, 0.2, True),
    ),
    "filter_greek": (f"{_GREEK} = 0", tf.no_greek),
    "filter_non_ascii": (f"length(term) > 0 AND (length(term) - {_ASCII}) / length(term)::double <= 0.3", lambda t: tf.non_ascii_at_most(t, 0.3)),
    "filter_digits": (f"length(term) > 0 AND {_DIGIT} / length(term)::double <= 0.5", lambda t: tf.digits_at_most(t, 0.5)),
    "filter_digits_alpha": (f"CASE WHEN {_ALPHA} > 0 THEN {_DIGIT} / {_ALPHA}::double <= 0.5 ELSE false END", lambda t: tf.digits_at_most(t, 0.5, True)),
}
_TESTS["simple_term_filter"] = (
    " AND ".join(f"({_TESTS[k][0]})" for k in ("filter_starts_digit", "filter_starts_punct", "filter_alpha_count", "filter_repetition", "filter_digits_alpha", "filter_greek", "filter_non_ascii", "filter_number_with_unit")),
    tf.simple_filter,
)


def _words(spark, sf_dir):
    """Terms of the view, and the pieces between quotes of the events' properties: these have signs."""
    pieces = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(F.split(F.lower("props"), '"')).alias("term"))
    return view(spark, sf_dir).postings.select("term").unionByName(pieces).distinct()


def _add_tests():
    for name, (sql, test) in _TESTS.items():

        def run(spark, sf_dir, test=test):
            return _words(spark, sf_dir).select("term", test(F.col("term")).alias("accepted"))

        run.__name__ = name
        query(f"SELECT term, coalesce({sql}, false) AS accepted FROM {_WORDS}")(run)


_add_tests()


@query(rf"""SELECT term, CAST({_ALPHA} AS INT) AS alpha, CAST({_COUNT.format("A-Za-z0-9")} AS INT) AS alphanum, CAST({_ASCII} AS INT) AS ascii,
CAST({_DIGIT} AS INT) AS digit, CAST({_GREEK} AS INT) AS greek, CAST(length(regexp_replace(term, '[^[:punct:]]', '', 'g')) AS INT) AS punct FROM {_WORDS}""")
def char_class_counts(spark, sf_dir):
    return _words(spark, sf_dir).select("term", *(tf.class_count(F.col("term"), k).alias(k.lower()) for k in tf.CLASSES))


@query(f"SELECT field, term, {_TESTS['simple_term_filter'][0]} AS accepted FROM ft")
def term_filter_verdicts(spark, sf_dir):
    return P.verdicts(view(spark, sf_dir), tf.simple_filter(F.col("term")))


@query(f"""SELECT field, term, df, round(df / n_docs::double, 9) AS rel_df FROM ft, coll
WHERE df / n_docs::double > 0.01 AND term NOT IN ({', '.join(map(repr, STOP))})""")
def term_dump(spark, sf_dir):
    return P.term_dump(view(spark, sf_dir), 0.01, STOP).withColumn("rel_df", F.round("rel_df", 9))


@query("SELECT term, round(rel_df, 9) AS rel_df FROM ts WHERE rel_df > 0.05")
def common_term_dump(spark, sf_dir):
    return P.common_term_dump(view(spark, sf_dir), 0.05).withColumn("rel_df", F.round("rel_df", 9))


_DUMP = "dump AS (SELECT term, df / n_docs::double AS rel_df FROM ft, coll WHERE field = 'claims' AND df / n_docs::double > 0.005)"
_SAMPLE = f""", {_DUMP}, lim AS (SELECT min(rel_df) AS lo, max(rel_df) AS hi FROM dump),
bins AS (SELECT unnest([2, 4, 6]) AS bin, lo, hi FROM lim),
rng AS (SELECT bin, hi - bin * ((hi - lo) / 6) AS bin_min, hi - (bin - 1) * ((hi - lo) / 6) AS bin_max FROM bins),
sample AS (SELECT term, rel_df, bin, bin_min, bin_max FROM dump, rng
  QUALIFY row_number() OVER (PARTITION BY bin ORDER BY round(abs(rel_df - (bin_min + bin_max) / 2), 12), term) <= 50)"""


def _sample(spark, sf_dir):
    return P.term_sample(_claims_dump(spark, sf_dir))


def _claims_dump(spark, sf_dir):
    v = view(spark, sf_dir)
    return P.term_dump(v, 0.005).where("field = 'claims'").select("term", "rel_df")


@query(_SAMPLE + "SELECT term, round(rel_df, 9) AS rel_df, bin, round(bin_min, 9) AS bin_min, round(bin_max, 9) AS bin_max FROM sample")
def term_sample(spark, sf_dir):
    """Scoring terms of the field claims: a sample is of one field."""
    return _sample(spark, sf_dir).select("term", "bin", *(F.round(c, 9).alias(c) for c in ("rel_df", "bin_min", "bin_max")))


@query(_SAMPLE + """SELECT bin AS segment, round(any_value(bin_min), 9) AS docfreq_rel_min, round(any_value(bin_max), 9) AS docfreq_rel_max,
count(*) AS term_count FROM sample GROUP BY bin""")
def term_segments(spark, sf_dir):
    rows = _sample(spark, sf_dir).groupBy(F.col("bin").alias("segment"))
    return rows.agg(F.round(F.min("bin_min"), 9).alias("docfreq_rel_min"), F.round(F.max("bin_max"), 9).alias("docfreq_rel_max"), F.count("*").alias("term_count"))


@query("SELECT q_id, term, qtf FROM qt")
def query_tokens(spark, sf_dir):
    return _q(spark, sf_dir)[2]


@query("SELECT q_id, doc_id, n_match, n_unique FROM teq")
def teq_match(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return R.teq_matches(v, terms)


@query(""", cl AS (SELECT q_id, term, field, coalesce(df, 0) > ceil(n_docs * 0.01) AS hi
  FROM (SELECT q_id, term, unnest(['claims', 'detd']) AS field FROM qt) LEFT JOIN ft USING (field, term), coll),
sz AS (SELECT q_id, count(*) FILTER (NOT hi) AS n_low, count(*) FILTER (hi) AS n_high FROM cl GROUP BY q_id)
SELECT q_id, doc_id, low, high FROM (SELECT q_id, doc_id, count(*) FILTER (NOT hi) AS low, count(*) FILTER (hi) AS high
  FROM post JOIN cl USING (field, term) GROUP BY q_id, doc_id) JOIN sz USING (q_id)
WHERE CASE WHEN n_low > 0 THEN low >= 1 ELSE high = n_high END""")
def ctq_match(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return R.ctq_matches(v, terms, FIELDS)


@query("""SELECT q_id, doc_id, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM tfidf
QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) <= 10""")
def tfidf_topn(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return R.top_n(R.tfidf(v, terms), 10)


@query(fb_sql("fb", 10, 50) + " SELECT q_id, doc_id, CAST(level AS INT) AS level FROM fb")
def feedback_minmax(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return R.feedback(v, terms, R.FeedbackSpec(10, 50))


@query(_FIXED + " SELECT q_id, doc_id, CAST(level AS INT) AS level FROM fb")
def feedback_fixed(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return R.feedback(v, terms, R.FeedbackSpec(most=500, fixed=True))


@query(_DCS + f"""SELECT i.item_id AS q_id, round(coalesce(score, 0), 6) AS score, coalesce(n, 0) AS fb_doc_count
FROM benchmark i LEFT JOIN (SELECT q_id, {_KL} AS score FROM models GROUP BY q_id) s ON s.q_id = i.item_id
LEFT JOIN (SELECT q_id, count(*) AS n FROM fb GROUP BY q_id) f ON f.q_id = i.item_id""")
def dcs_score(spark, sf_dir):
    return S.dcs(view(spark, sf_dir), bench(spark, sf_dir)).select("q_id", *r6("score"), "fb_doc_count")


@query(_ICS + f"""SELECT i.item_id AS q_id, round(CASE WHEN coalesce(n, 0) < 10 THEN 0 ELSE coalesce(score, 0) END, 6) AS score, coalesce(n, 0) AS fb_doc_count,
lo AS fb_terms_min, hi AS fb_terms_max
FROM benchmark i LEFT JOIN (SELECT q_id, {_KL} AS score FROM models GROUP BY q_id) s ON s.q_id = i.item_id
LEFT JOIN (SELECT q_id, count(*) AS n, min(n_match) AS lo, max(n_match) AS hi FROM fb GROUP BY q_id) f ON f.q_id = i.item_id""")
def ics_score(spark, sf_dir):
    return S.ics(view(spark, sf_dir), bench(spark, sf_dir)).select("q_id", *r6("score"), "fb_doc_count", "fb_terms_min", "fb_terms_max")


@query(_ICS + """SELECT q_id, term, round(q, 9) AS q_model, round(c, 9) AS c_model, df, round(rel_df, 9) AS rel_df, CAST(tf AS BIGINT) AS tf, round(rel_tf, 9) AS rel_tf
FROM models""")
def ics_explain(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    fb = R.ics_feedback(R.teq_matches(v, terms))
    rows = P.explain(S.ics_models(v, terms, fb), v)
    return rows.select("q_id", "term", "df", "tf", *(F.round(c, 9).alias(c) for c in ("q_model", "c_model", "rel_df", "rel_tf")))


@query("""SELECT q_id, doc_id, round(sum(qtf * (log10((n_docs + 1) / df::double) * coalesce(mtf, 0) * 3 /
  (coalesce(mtf, 0) + 2 * (0.25 + 0.75 * dl / (ttf / n_docs::double))) + 1)), 6) AS score
FROM (SELECT q_id, doc_id FROM tfidf QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) <= 10)
JOIN qt USING (q_id) JOIN ts USING (term) JOIN dl USING (doc_id) LEFT JOIN dm USING (doc_id, term), coll GROUP BY q_id, doc_id""")
def bm25plus(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return S.bm25plus(v, terms, R.top_n(R.tfidf(v, terms), 10)).select("q_id", "doc_id", *r6("score"))


_PARSE = r""", codes AS (SELECT doc_id, unnest(ipc) AS code FROM corpus),
rx AS (SELECT DISTINCT code, regexp_extract(code, '^([A-H])(?:([0-9]{2})(?:([A-Z])(?:([0-9]{1,4})?(?:-([0-9]{1,4}))?)?)?)?', ['s', 'c', 'u', 'm', 'g']) AS r FROM codes),
parsed AS (SELECT code, nullif(r.s, '') AS section, try_cast(nullif(r.c, '') AS INT) AS class, nullif(r.u, '') AS subclass,
  try_cast(nullif(r.m, '') AS INT) AS maingroup, try_cast(nullif(r.g, '') AS INT) AS subgroup FROM rx),
valid AS (SELECT *, coalesce(class, 1) <> 0 AND coalesce(maingroup, 1) <> 0 AS valid FROM parsed),
fmt AS (SELECT *, coalesce(section, '') || coalesce(lpad(class::varchar, 2, '0'), '') || coalesce(subclass, '') || coalesce(lpad(maingroup::varchar, 4, '0'), '')
  || coalesce('-' || lpad(subgroup::varchar, 6, '0'), '') AS f FROM valid),
good AS (SELECT doc_id, f.* FROM codes JOIN fmt f USING (code) WHERE valid AND section IS NOT NULL)
"""


@query(_PARSE + "SELECT code, section, class, subclass, maingroup, subgroup, valid, regexp_extract(code, '[^a-zA-Z0-9]') AS separator FROM valid")
def ipc_parse(spark, sf_dir):
    codes = read_corpus(spark, sf_dir).select(F.explode("ipc").alias("code")).distinct()
    rows = codes.withColumn("r", ipc.parse(F.col("code"))).withColumn("separator", ipc.find_separator(F.col("code")))
    return rows.select("code", "r.*", "separator")


@query(_PARSE + "SELECT code, CASE WHEN valid THEN f ELSE 'INVALID' END AS formatted, valid, regexp_matches(code, '^(?:[Aa].*)$') AS matched FROM fmt")
def ipc_list(spark, sf_dir):
    return P.ipc_list(read_corpus(spark, sf_dir), ipc.Code("A"))


@query(_PARSE + "SELECT f AS code, section, class, subclass, maingroup, subgroup, count(*) AS n FROM good GROUP BY ALL")
def ipc_all(spark, sf_dir):
    return P.ipc_all(read_corpus(spark, sf_dir))


@query(_PARSE + """, ex AS (SELECT unnest(list_distinct(list_filter([section, section || lpad(class::varchar, 2, '0'), section || lpad(class::varchar, 2, '0') || subclass,
  section || lpad(class::varchar, 2, '0') || subclass || lpad(maingroup::varchar, 4, '0'), f], lambda x: x IS NOT NULL))) AS code FROM good)
SELECT code, count(*) AS n FROM ex GROUP BY code""")
def ipc_distribution(spark, sf_dir):
    return P.ipc_distribution(read_corpus(spark, sf_dir))


@query(_PARSE + """SELECT codes, count(*) AS n FROM (SELECT c.doc_id, CAST(count(g.doc_id) AS INT) AS codes FROM corpus c LEFT JOIN good g USING (doc_id) GROUP BY c.doc_id) GROUP BY codes""")
def ipc_perdocument(spark, sf_dir):
    return P.ipc_per_document(read_corpus(spark, sf_dir))


@query(_PARSE + """SELECT sections, count(*) AS n FROM (SELECT c.doc_id, CAST(count(DISTINCT g.section) AS INT) AS sections FROM corpus c LEFT JOIN good g USING (doc_id) GROUP BY c.doc_id) GROUP BY sections""")
def ipc_sections(spark, sf_dir):
    return P.ipc_sections(read_corpus(spark, sf_dir))


_SLOPPY = """, sec AS (SELECT doc_id, list(DISTINCT coalesce(section, '-')) AS s FROM codes JOIN fmt USING (code) WHERE valid GROUP BY doc_id)"""


@query(_PARSE + _SLOPPY + r""", f AS (SELECT doc_id, unnest(['claims', 'detd']) AS field, len(regexp_extract_all(unnest([lower(claims), lower(detd)]), '[\p{L}\p{N}]+')) > 0 AS has FROM corpus),
hit AS (SELECT s[1] AS section, field, count(*) AS n FROM sec JOIN f USING (doc_id) WHERE len(s) = 1 AND has GROUP BY ALL)
SELECT section, field, coalesce(n, 0) AS n FROM (SELECT s.section, f.field FROM (SELECT unnest(['A','B','C','D','E','F','G','H']) AS section) s, (SELECT unnest(['claims','detd']) AS field) f) LEFT JOIN hit USING (section, field)""")
def ipc_docfieldcount(spark, sf_dir):
    return P.ipc_field_counts(read_corpus(spark, sf_dir))


@query(_PARSE + _SLOPPY + "SELECT doc_id FROM sec WHERE s = ['B']")
def ipc_sloppy(spark, sf_dir):
    return read_corpus(spark, sf_dir).where(ipc.sloppy(F.col("ipc"), ipc.Code("B", 12))).select("doc_id")


@query("SELECT doc_id FROM corpus WHERE len(ipc) > 0 AND len(list_filter(ipc, lambda c: NOT regexp_matches(c, '^(?:[Cc].*)$'))) = 0")
def ipc_greedy(spark, sf_dir):
    return read_corpus(spark, sf_dir).where(ipc.greedy(F.col("ipc"), ipc.Code("C"))).select("doc_id")


@query("SELECT doc_id FROM corpus WHERE len(list_filter(ipc, lambda c: regexp_matches(c, '^(?:[Dd]0*4.*)$'))) > 0")
def ipc_class_query(spark, sf_dir):
    return read_corpus(spark, sf_dir).where(ipc.class_match(F.col("ipc"), ipc.Code("D", 4))).select("doc_id")


@query(_PARSE + "SELECT doc_id FROM corpus LEFT JOIN good USING (doc_id) GROUP BY doc_id HAVING count(DISTINCT section) <= 1")
def ipc_max_sections(spark, sf_dir):
    return read_corpus(spark, sf_dir).where(ipc.max_sections(F.col("ipc"), 1)).select("doc_id")


@query(_SAMPLE + f""", sent AS (SELECT item_id, lower(text) AS sentence FROM benchmark),
pair AS (SELECT DISTINCT item_id, sentence, term AS term_ref FROM sent JOIN qt0 ON qt0.q_id = item_id)
SELECT item_id, term_ref, sentence, bin FROM pair JOIN sample s ON s.term = term_ref""")
def sentence_terms_join(spark, sf_dir):
    q = bench(spark, sf_dir).select(F.col("q_id").alias("item_id"), F.lower("text").alias("sentence"))
    pairs = q.select("item_id", "sentence", F.explode(F.array_distinct(simple_tokens(F.col("sentence")))).alias("term_ref"))
    terms = _sample(spark, sf_dir).select("term", "bin")
    return pairs.join(terms, pairs.term_ref == terms.term).select("item_id", "term_ref", "sentence", "bin")


# Sentences by a model of abbreviations and sentence starts that is learned from all fields and languages.
_LEARNED = _INDEX[: _INDEX.index("tok AS (")] + r"""toks AS (
  SELECT lang, doc_id, field, string_split(s, ' ') AS a FROM (
    SELECT lang, doc_id, field, trim(regexp_replace(lower(t), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS s
    FROM (SELECT lang, doc_id, unnest(['claims', 'detd']) AS field, unnest([claims, detd]) AS t FROM corpus)) WHERE s <> ''),
raw AS (SELECT lang, doc_id, field, a, unnest(range(len(a))) AS pos, unnest(a) AS t FROM toks),
plc AS (
  SELECT lang, doc_id, field, pos, t, regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS word,
         regexp_matches(t, '\.[)\]}"''»”’]*$') AS stop, regexp_matches(t, '[!?][)\]}"''»”’]*$') AS mark,
         regexp_replace(coalesce(a[pos + 2], ''), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS next FROM raw),
cnt AS (SELECT lang, word, count(*)::double AS c, count(*) FILTER (stop)::double AS e FROM plc WHERE word <> '' GROUP BY ALL),
tot AS (SELECT lang, sum(c) AS n, sum(e) AS stops FROM cnt GROUP BY lang),
abbr AS (
  SELECT lang, word FROM (
    SELECT *, stops / n AS p, length(replace(word, '.', ''))::double AS l, length(word) AS w FROM cnt JOIN tot USING (lang))
  WHERE e > 0 AND NOT regexp_matches(word, '^(\p{L}|\p{N}+)$') AND 0.3 <= exp(-l) * (w - l + 1) * pow(l, -(c - e)) * 2 * (
    e * ln(0.99) + (c - e) * ln(0.01) - e * ln(p) - CASE WHEN c = e THEN 0 ELSE (c - e) * ln(1 - p) END)),
sure AS (
  SELECT lang, next AS word, count(*)::double AS k FROM plc
  WHERE next <> '' AND (mark OR stop AND NOT regexp_matches(word, '^(\p{L}|\p{N}+)$') AND (lang, word) NOT IN (SELECT (lang, word) FROM abbr)) GROUP BY ALL),
brk AS (SELECT lang, sum(k) AS a FROM sure GROUP BY lang),
start AS (
  SELECT lang, word FROM (SELECT *, c AS b FROM sure JOIN cnt USING (lang, word) JOIN brk USING (lang) JOIN tot USING (lang))
  WHERE n > a AND k / a > b / n AND 30 <= 2 * (
    k * ln(k / a) + CASE WHEN a = k THEN 0 ELSE (a - k) * ln(1 - k / a) END
    + CASE WHEN b = k THEN 0 ELSE (b - k) * ln((b - k) / (n - a)) END + CASE WHEN n - a = b - k THEN 0 ELSE (n - a - b + k) * ln(1 - (b - k) / (n - a)) END
    - b * ln(b / n) - (n - b) * ln(1 - b / n))),
stops AS (
  SELECT *, (mark OR stop AND NOT (regexp_matches(word, '^\p{L}$') OR ((lang, word) IN (SELECT (lang, word) FROM abbr) OR regexp_matches(word, '^\p{N}+$'))
    AND (lang, next) NOT IN (SELECT (lang, word) FROM start))) AS ends FROM plc),
numbered AS (
  SELECT *, coalesce(sum(ends::int) OVER (PARTITION BY lang, doc_id, field ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM stops)
"""


@query(base=_LEARNED, sql="SELECT lang, doc_id, field, CAST(i AS INT) AS i, string_agg(t, ' ' ORDER BY pos) AS sentence FROM numbered GROUP BY lang, doc_id, field, i")
def learned_sentences(spark, sf_dir):
    docs = read_corpus(spark, sf_dir)
    return sent.split(docs, sent.learn(docs))


@query(base=_LEARNED, sql="SELECT lang, word, 'abbreviation' AS kind FROM abbr UNION ALL SELECT lang, word, 'starter' AS kind FROM start")
def sentence_model(spark, sf_dir):
    model = sent.learn(read_corpus(spark, sf_dir))
    named = lambda df, kind: df.select("lang", "word", F.lit(kind).alias("kind"))
    return named(model.abbreviations, "abbreviation").unionByName(named(model.starters, "starter"))


# A sentence ends with a mark and a space once white space is folded.
_SENT = r""", folded AS (
  SELECT doc_id, field, unnest(string_split(regexp_replace(trim(regexp_replace(lower(t), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS sentence
  FROM (SELECT doc_id, unnest(['claims', 'detd']) AS field, unnest([claims, detd]) AS t FROM corpus WHERE lang = 'en')),
stok AS (SELECT DISTINCT doc_id, field, sentence, unnest(regexp_extract_all(sentence, '[\p{L}\p{N}]+')) AS token FROM folded WHERE sentence <> ''),
inside AS (SELECT DISTINCT token, term FROM (SELECT DISTINCT token FROM stok) JOIN (SELECT DISTINCT term FROM sample) ON contains(token, term)),
hit AS (SELECT DISTINCT field, term, doc_id, sentence FROM stok JOIN inside USING (token)),
cand AS (SELECT * FROM (SELECT DISTINCT field, term, doc_id FROM hit)
  QUALIFY row_number() OVER (PARTITION BY field, term ORDER BY md5('0' || doc_id::varchar), doc_id) <= 500),
one AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY field, term ORDER BY md5('0' || term || doc_id::varchar), doc_id) = 1),
mine AS (SELECT *, row_number() OVER (PARTITION BY field, term ORDER BY len(string_split(sentence, ' ')) DESC, sentence) AS r,
  count(*) OVER (PARTITION BY field, term) AS n FROM hit JOIN one USING (field, term, doc_id)),
picked AS (SELECT field, term, doc_id, sentence FROM mine WHERE r <= CASE WHEN n <= 3 THEN n ELSE floor(n / 3.5) END
  QUALIFY row_number() OVER (PARTITION BY field, term ORDER BY md5('0' || sentence), sentence) = 1)
"""


@query(_SAMPLE + _SENT + "SELECT field, term, doc_id, sentence FROM picked")
def sentences(spark, sf_dir):
    docs = read_corpus(spark, sf_dir).where("lang = 'en'")
    return P.sentences(docs, _sample(spark, sf_dir).select("term").distinct())


_OF_SAMPLE = _INDEX.rstrip().rstrip(",") + _SAMPLE


def _terms_table(spark, sf_dir):
    """The sample as scoring terms (id, term, field, lang, bin, ipc)."""
    rows = _sample(spark, sf_dir).select("term", "bin")
    key = F.md5(F.concat_ws("|", "term", F.col("bin").cast("string")))
    return store.stored(rows.select(key.alias("id"), "term", F.lit("claims").alias("field"), F.lit("en").alias("lang"), "bin", F.lit(None).cast("string").alias("ipc")), "scoring-terms")


@query(
    ", items AS (SELECT md5(term || '|' || bin) AS item_id, term AS text FROM sample), " + _QUERIES.replace("<items>", "items") + _ICS
    + f""", scored AS (SELECT q_id, {_KL} AS score FROM models GROUP BY q_id), cnt AS (SELECT q_id, count(*) AS n FROM fb GROUP BY q_id)
SELECT md5(term || '|' || bin) AS term_ref, term, 'claims' AS field, bin, 'ICS' AS impl, round(CASE WHEN coalesce(n, 0) < 10 THEN 0 ELSE coalesce(score, 0) END, 6) AS score
FROM sample LEFT JOIN scored ON scored.q_id = md5(term || '|' || bin) LEFT JOIN cnt ON cnt.q_id = md5(term || '|' || bin)""",
    _OF_SAMPLE,
)
def term_results(spark, sf_dir):
    """Every sampled term scored by improved clarity, and the results joined with their terms."""
    terms = _terms_table(spark, sf_dir)
    results = S.ics(view(spark, sf_dir), P.scoring_terms(terms, "en").select(F.col("id").alias("q_id"), F.col("term").alias("text")))
    return P.term_report(results.withColumnRenamed("q_id", "term_ref"), terms).withColumn("score", F.round("score", 6))


@query(
    _SENT + """, items AS (SELECT md5(term || '|' || bin) AS item_id, sentence AS text FROM picked JOIN sample USING (term) WHERE field = 'claims'), """
    + _QUERIES.replace("<items>", "items")
    + f""", scored AS (SELECT q_id, {_KL} AS score FROM (
  SELECT q_id, qtf / n::double AS q, rel_tf AS c FROM qt JOIN (SELECT q_id, sum(qtf) AS n FROM qt0 GROUP BY q_id) USING (q_id) JOIN ts USING (term)) GROUP BY q_id)
SELECT item_id AS sent_ref, item_id AS term_ref, 'claims' AS field, bin, 'SCS' AS impl, round(coalesce(score, 0), 6) AS score
FROM items JOIN sample ON item_id = md5(sample.term || '|' || bin) LEFT JOIN scored ON q_id = item_id""",
    _OF_SAMPLE,
)
def sentence_results(spark, sf_dir):
    """A sentence of every sampled term scored by simplified clarity, and the results joined with sentences and terms."""
    terms = _terms_table(spark, sf_dir)
    found = P.sentences(read_corpus(spark, sf_dir).where("lang = 'en'"), terms, ("claims",))
    own = store.stored(found.join(terms.select("id", "term"), "term").select("sentence", F.col("id").alias("term_ref")), "sentences")
    queries = P.score_sentences(own, terms, "en").select(F.col("term_ref").alias("q_id"), F.col("sentence").alias("text"))
    results = S.scs(view(spark, sf_dir), queries).select(F.col("q_id").alias("sent_ref"), F.lit("SCS").alias("impl"), F.round("score", 6).alias("score"))
    return P.sentence_report(results, own, terms)


@query(f""", scored AS (SELECT q_id, {_KL} AS score, q_id % 4 AS g FROM (
  SELECT q_id, qtf / n::double AS q, rel_tf AS c FROM qt JOIN (SELECT q_id, sum(qtf) AS n FROM qt0 GROUP BY q_id) USING (q_id) JOIN ts USING (term)) GROUP BY q_id)
SELECT q_id, g, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END, 6) AS sscore
FROM scored WINDOW w AS (PARTITION BY g)""")
def score_rescaled(spark, sf_dir):
    return _rescaled(spark, sf_dir).select("q_id", "g", *r6("sscore"))


def _rescaled(spark, sf_dir):
    v, q, terms = _q(spark, sf_dir)
    scores = S.scs(v, q).join(terms.select("q_id").distinct(), "q_id", "left_semi")
    return P.rescaled(scores.withColumn("g", F.col("q_id") % 4), ["g"])


@query(f""", scored AS (SELECT q_id, {_KL} AS score, q_id % 4 AS g FROM (
  SELECT q_id, qtf / n::double AS q, rel_tf AS c FROM qt JOIN (SELECT q_id, sum(qtf) AS n FROM qt0 GROUP BY q_id) USING (q_id) JOIN ts USING (term)) GROUP BY q_id),
re AS (SELECT g, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END AS s
FROM scored WINDOW w AS (PARTITION BY g))
SELECT g, round(min(s), 6) AS lo, round(quantile_cont(s, 0.25), 6) AS q1, round(quantile_cont(s, 0.5), 6) AS q2, round(quantile_cont(s, 0.75), 6) AS q3,
  round(max(s), 6) AS hi, count(*) AS n FROM re GROUP BY g""")
def score_box(spark, sf_dir):
    return P.box_summary(_rescaled(spark, sf_dir), ["g"]).select("g", *r6("lo", "q1", "q2", "q3", "hi"), "n")


@query(_PARSE + """SELECT lang, section, n, round(n / sum(n) OVER (PARTITION BY lang)::double, 9) AS share
FROM (SELECT lang, section, count(*) AS n FROM good JOIN corpus USING (doc_id) GROUP BY ALL)""")
def section_share(spark, sf_dir):
    rows = read_corpus(spark, sf_dir).select("lang", F.explode("ipc").alias("c")).select("lang", ipc.parts(F.col("c"))["section"].alias("section"))
    counted = rows.where("section is not null").groupBy("lang", "section").agg(F.count("*").alias("n"))
    return P.shares(counted, "lang").withColumn("share", F.round("share", 9))


@query("SELECT df, count(*) AS n FROM ts GROUP BY df")
def df_histogram(spark, sf_dir):
    return P.histogram(view(spark, sf_dir).term_stats(), "df")


@query("""SELECT field, variable, value FROM (SELECT field, CAST(sum(tf) AS BIGINT) AS ttf, count(DISTINCT doc_id) AS docs FROM post GROUP BY field)
UNPIVOT (value FOR variable IN (ttf, docs))""")
def idx_stats_long(spark, sf_dir):
    return P.melt(view(spark, sf_dir).by_field().where("field is not null"), ["field"], ["ttf", "docs"])


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(claims, '\s+'), lambda w: w <> '')) AS words, trim(claims, ' ') = '' AS blank,
claims = upper(claims) AS uppercase, regexp_matches(claims, '^[0-9.e-]*$') AS is_number, round(0.001 + ln(1 + length(claims)) * 0.998 / ln(1000), 6) AS scaled FROM corpus""")
def scalar_functions(spark, sf_dir):
    c = F.col("claims")
    return read_corpus(spark, sf_dir).select(
        "doc_id", word_count(c).cast("long").alias("words"), scalar.trimmed_empty(c).alias("blank"), scalar.all_upper(c).alias("uppercase"),
        scalar.numeric(c).alias("is_number"),
        F.round(scalar.rescale(F.ln(F.lit(1.0) + F.length(c)), F.lit(0.0), F.ln(F.lit(1000.0))), 6).alias("scaled"),
    )


def _add_stemmed():
    for lang in STEMMERS:

        def run(spark, sf_dir, lang=lang):
            docs = read_corpus(spark, sf_dir).where(F.col("lang") == lang)
            parts = [analyze(docs, f, lang).withColumn("field", F.lit(f)) for f in FIELDS]
            return parts[0].unionByName(parts[1]).groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"))

        run.__name__ = f"stemmed_{lang}"
        query()(run)


_add_stemmed()

_STD = r"[\p{L}\p{N}_]+(?:[''’.,·][\p{L}\p{N}][\p{L}\p{N}_]*)*"
_BARE = r"""bare AS (
  SELECT lang, doc_id, field, CASE lang WHEN 'en' THEN regexp_replace(t, '[''’]s$', '')
    WHEN 'fr' THEN regexp_replace(t, '^(?:c|d|j|l|m|n|qu|s|t|jusqu|quoiqu|lorsqu|puisqu)[''’]', '') ELSE t END AS term
  FROM (SELECT lang, doc_id, field, unnest(regexp_extract_all(lower(x), '<std>')) AS t
    FROM (SELECT lang, doc_id, unnest(['claims', 'detd']) AS field, unnest([claims, detd]) AS x FROM corpus)))""".replace("<std>", _STD)


@query(f", {_BARE} SELECT lang, doc_id, field, term, count(*) AS tf FROM bare WHERE term <> '' AND NOT (lang = 'en' AND term IN ({', '.join(map(repr, STOP))})) GROUP BY ALL")
def analyzer_tokens(spark, sf_dir):
    """What each language's analyzer gives before it stems."""
    docs = read_corpus(spark, sf_dir)
    parts = [counts(docs.where(F.col("lang") == lang), FIELDS, bare_tokens(lang, STOP if lang == "en" else ())) for lang in STEMMERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""{_BARE}, post AS (SELECT doc_id, field, term, count(*) AS tf FROM bare WHERE lang = 'en' AND field = 'claims' AND term <> '' AND term NOT IN ({', '.join(map(repr, STOP))}) GROUP BY ALL
UNION ALL SELECT doc_id, field, term, count(*) FROM tok WHERE field = 'detd' GROUP BY ALL),
ts AS (SELECT term, sum(tf) / max(total)::double AS rel_tf FROM post, (SELECT sum(tf) AS total FROM post) GROUP BY term),
q0 AS (SELECT item_id AS q_id, regexp_replace(t, '[''’]s$', '') AS term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_STD}')) AS t FROM benchmark)),
qn AS (SELECT q_id, term, count(*) AS qtf FROM q0 WHERE term <> '' AND term NOT IN ({', '.join(map(repr, STOP))}) GROUP BY ALL)
SELECT q_id, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT q_id FROM qn)
LEFT JOIN (SELECT q_id, {_KL} AS score FROM (SELECT q_id, qtf / n::double AS q, rel_tf AS c FROM qn JOIN (SELECT q_id, sum(qtf) AS n FROM qn GROUP BY q_id) USING (q_id) JOIN ts USING (term)) GROUP BY q_id) USING (q_id)""",
    _INDEX[: _INDEX.index("post AS")],
)
def scs_analyzed(spark, sf_dir):
    """Simplified clarity with an analyzer of its own for one field and for the queries."""
    own = bare_tokens("en", STOP)
    docs = read_corpus(spark, sf_dir).where("lang = 'en'")
    v = View(counts(docs, FIELDS, {"claims": own})).stored("analyzed")
    return S.scs(v, bench(spark, sf_dir), tokens=own).select("q_id", *r6("score"))


@query()
def scs_german(spark, sf_dir):
    """Queries and documents both through the German analyzer."""
    own = language_tokens("de")
    docs = read_corpus(spark, sf_dir).where("lang = 'de'")
    return S.scs(View(counts(docs, FIELDS, own)).stored("german"), bench(spark, sf_dir), tokens=own).select("q_id", *r6("score"))


_CTQ = """, cl AS (SELECT q_id, term, field, coalesce(df, 0) > ceil(n_docs * 0.01) AS hi
  FROM (SELECT q_id, term, unnest(['claims', 'detd']) AS field FROM qt) LEFT JOIN ft USING (field, term), coll),
sz AS (SELECT q_id, count(*) FILTER (NOT hi) AS n_low, count(*) FILTER (hi) AS n_high FROM cl GROUP BY q_id),
ctq AS (SELECT q_id, doc_id FROM (SELECT q_id, doc_id, count(*) FILTER (NOT hi) AS low, count(*) FILTER (hi) AS high
  FROM post JOIN cl USING (field, term) GROUP BY q_id, doc_id) JOIN sz USING (q_id) WHERE CASE WHEN n_low > 0 THEN low >= 1 ELSE high = n_high END),
fb AS (SELECT q_id, doc_id FROM ctq JOIN tfidf USING (q_id, doc_id) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) <= <most>)"""


@query(_CTQ.replace("<most>", "50") + "SELECT q_id, doc_id, 0 AS level FROM fb")
def feedback_common(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return R.feedback(v, terms, R.FeedbackSpec(10, 50, kind="CTQ"))


@query("SELECT q_id, doc_id, CAST(n_unique - n_match AS INT) AS level FROM teq")
def feedback_unbounded(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return R.feedback(v, terms, R.FeedbackSpec(unbounded=True))


@query(_FIXED.replace("(SELECT DISTINCT doc_id FROM post) d", "(SELECT DISTINCT doc_id FROM post WHERE field = 'detd') d") + " SELECT q_id, doc_id, CAST(level AS INT) AS level FROM fb")
def feedback_fixed_field(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return R.feedback(v, terms, R.FeedbackSpec(most=500, fixed=True, fields=("detd",)))


@query(_CTQ.replace("<most>", "10") + """SELECT q_id, doc_id, field, count(*) AS n_terms, string_agg(term, ' ' ORDER BY encode(term)) AS terms
FROM fb JOIN post USING (doc_id) GROUP BY ALL""")
def feedback_inspection(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return R.inspect_feedback(v, R.feedback(v, terms, R.FeedbackSpec(1, 10, kind="CTQ")))


@query(_CTQ.replace("<most>", "10") + "SELECT DISTINCT q_id, term, round(rel_df, 9) AS rel_df FROM fb JOIN dm USING (doc_id) JOIN ts USING (term)")
def feedback_inspection_terms(spark, sf_dir):
    v, _, terms = _q(spark, sf_dir)
    return R.inspect_vocabulary(v, R.feedback(v, terms, R.FeedbackSpec(1, 10, kind="CTQ"))).withColumn("rel_df", F.round("rel_df", 9))


@query(_PARSE + """SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY class NULLS FIRST, subclass NULLS FIRST, maingroup NULLS FIRST, subgroup NULLS FIRST) AS INT) AS place, code, n
FROM (SELECT f AS code, section, class, subclass, maingroup, subgroup, count(*) AS n FROM good GROUP BY ALL)""")
def ipc_ordered(spark, sf_dir):
    return P.ipc_ordered(read_corpus(spark, sf_dir))


@query(_PARSE + "SELECT count(*) FILTER (regexp_matches(code, '^(?:[Aa].*)$')) AS matched, count(*) FILTER (NOT regexp_matches(code, '^(?:[Aa].*)$')) AS excluded FROM fmt")
def ipc_list_counts(spark, sf_dir):
    return P.ipc_list_counts(P.ipc_list(read_corpus(spark, sf_dir), ipc.Code("A")))


@query(_PARSE + """, ok AS (SELECT doc_id FROM good GROUP BY doc_id HAVING count(DISTINCT section) <= 1)
SELECT doc_id FROM corpus WHERE len(list_filter(ipc, lambda c: regexp_matches(c, '^(?:[Dd].*)$'))) > 0 AND doc_id IN (SELECT doc_id FROM ok)""")
def ipc_predicates(spark, sf_dir):
    codes = F.col("ipc")
    return read_corpus(spark, sf_dir).where(ipc.all_of(ipc.class_match(codes, ipc.Code("D")), ipc.max_sections(codes, 1))).select("doc_id")


@query(_PARSE + """, rec AS (SELECT doc_id, list(section) AS s, list(subclass) AS u FROM codes JOIN fmt USING (code) WHERE valid GROUP BY doc_id)
SELECT doc_id FROM rec WHERE len(list_filter(s, lambda x: x = 'C')) = (SELECT count(*) FROM codes JOIN fmt USING (code) WHERE valid AND codes.doc_id = rec.doc_id)
AND len(list_filter(u, lambda x: x = 'K')) = (SELECT count(*) FROM codes JOIN fmt USING (code) WHERE valid AND codes.doc_id = rec.doc_id)""")
def ipc_match_fields(spark, sf_dir):
    return read_corpus(spark, sf_dir).where(ipc.sloppy(F.col("ipc"), ipc.Code("C", 3, "K"), fields=("section", "subclass"))).select("doc_id")


@query(f"""SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS n FROM post
WHERE term NOT IN ({', '.join(map(repr, STOP))}) AND term IN (SELECT term FROM (SELECT term, count(DISTINCT doc_id) AS d FROM post GROUP BY term), coll WHERE d / n_docs::double <= 0.2) GROUP BY term""")
def view_without_terms(spark, sf_dir):
    """A view without listed stop words, by anti-join, and without common terms."""
    stop = spark.createDataFrame([(w,) for w in STOP], "term string")
    v = view(spark, sf_dir)
    return v.without_terms(stop).only_terms(tf.common_terms(v.postings, 0.2)).postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("n"))


@query("""SELECT field, term, df, round(df / n_docs::double, 9) AS rel_df, df >= 10 AND term LIKE 'a%' AS chosen FROM ft, coll WHERE df / n_docs::double > 0.01""")
def term_selection(spark, sf_dir):
    """Predicates of a selection from the dump: a limit and a prefix."""
    rows = P.term_dump(view(spark, sf_dir), 0.01).withColumn("rel_df", F.round("rel_df", 9))
    return rows.withColumn("chosen", (F.col("df") >= 10) & F.col("term").startswith("a"))


@query(r"""SELECT doc_id, claims = upper(claims) AS uppercase, claims = lower(claims) AS lowercase, round(log2(1 + length(claims)), 6) AS log2_n, round(ln(1 + length(claims)) / ln(3.0), 6) AS log3_n,
strftime(make_timestamp(1700000000000000 + doc_id * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM corpus""")
def scalar_more(spark, sf_dir):
    c, n = F.col("claims"), F.lit(1.0) + F.length("claims")
    return read_corpus(spark, sf_dir).select(
        "doc_id", scalar.all_upper(c).alias("uppercase"), scalar.all_lower(c).alias("lowercase"), F.round(scalar.log_n(2.0, n), 6).alias("log2_n"),
        F.round(scalar.log_n(3.0, n), 6).alias("log3_n"), scalar.timestamp_text(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))).alias("at"),
    )
