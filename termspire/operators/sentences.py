"""Sentence detection that learns a corpus's abbreviations and sentence starts, language by language.

The method is the published one of Kiss and Strunk (2006), for lower-cased text: an abbreviation is a word that hardly ever stands
without its full stop, a sentence start one that follows a certain sentence end more often than chance has it. Both are
log-likelihood ratios of counts, so learning is some aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspire.operators.joins import SMALL, spread_join
from termspire.sources.store import stored

#: What may follow the mark that ends a sentence.
CLOSERS = r"[)\]}\"'»”’]*$"
ABBREVIATION, STARTER = 0.3, 30.0


@dataclass(frozen=True)
class Model:
    """``abbreviations`` (lang, word, score) and ``starters`` (lang, word, score), stored."""

    abbreviations: DataFrame
    starters: DataFrame


def _tokens(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(lang, doc_id, field, toks): the folded, lower-cased text of each field that has any, at spaces."""
    folded = lambda f: F.trim(F.regexp_replace(F.lower(f), r"[ \t\n\x0B\f\r]+", " "))
    parts = F.array(*(F.struct(F.lit(f).alias("field"), folded(f).alias("s")) for f in fields))
    return docs.select("lang", "doc_id", F.explode(parts).alias("p")).where("p.s <> ''").select("lang", "doc_id", "p.field", F.split("p.s", " ").alias("toks"))


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _places(rows: DataFrame) -> DataFrame:
    """(..., pos, word, stop, mark, next): each token bare, whether a full stop or another mark ends it, and the bare word behind it."""
    at = rows.select("lang", "doc_id", "field", F.posexplode(F.arrays_zip(F.col("toks").alias("t"), F.slice("toks", 2, F.size("toks")).alias("n"))).alias("pos", "x"))
    stop, mark = F.col("x.t").rlike(r"\." + CLOSERS), F.col("x.t").rlike("[!?]" + CLOSERS)
    return at.select("lang", "doc_id", "field", "pos", _bare(F.col("x.t")).alias("word"), stop.alias("stop"), mark.alias("mark"), _bare(F.coalesce("x.n", F.lit(""))).alias("next"))


def _log(n: Column, p: Column) -> Column:
    """n * ln(p), 0 where n is."""
    return F.when(n == 0, 0.0).otherwise(n * F.ln(p))


def _kind(word: Column) -> Column:
    """Initials and ordinals by their form."""
    return F.when(word.rlike(r"^\p{L}$"), "initial").when(word.rlike(r"^\p{N}+$"), "ordinal")


def _marked(rows: DataFrame, side: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with whether ``side`` (lang, word) has the word in ``key``."""
    own = side.select(F.struct(F.col("lang"), F.col("word")).alias("_k"), F.lit(True).alias(name))
    rows = rows.withColumn("_k", F.struct(F.col("lang"), F.col(key).alias("word")))
    joined = rows.join(F.broadcast(own), "_k", "left") if side.count() <= SMALL else spread_join(stored(rows, "places"), stored(own, "words"), "_k", "left")
    return joined.drop("_k").withColumn(name, F.coalesce(name, F.lit(False)))


def learn(docs: DataFrame, fields: tuple[str, ...] = ("claims", "detd")) -> Model:
    """The model of ``docs`` (lang, doc_id, and the fields).

    With C the tokens of a word, E those that a full stop ends, and p the share of tokens that one ends, a word's ratio is that of
    E of C with probability 0.99 to E of C with p; it counts less by e for each letter, more for each inner full stop, and
    falls by its length to the power of C - E. Words that reach ABBREVIATION are abbreviations; initials and numbers are none, they
    are told by their form. Starters are words for which it's STARTER times as likely, by the same test, that ends of sentences
    draw them. An empty table learns nothing.
    """
    at = _places(_tokens(docs, fields))
    counts = at.where("word <> ''").groupBy("lang", "word").agg(F.count("*").cast("double").alias("c"), F.count_if("stop").cast("double").alias("e"))
    counts = stored(counts, "word-counts")
    total = counts.groupBy("lang").agg(F.sum("c").alias("n"), F.sum("e").alias("stops"))
    of = counts.join(F.broadcast(total), "lang")  # a row a language
    c, e, p = F.col("c"), F.col("e"), F.col("stops") / F.col("n")
    ratio = 2 * (_log(e, F.lit(0.99)) + _log(c - e, F.lit(0.01)) - _log(e, p) - _log(c - e, 1 - p))
    letters = F.length(F.replace("word", F.lit("."))).cast("double")
    score = ratio * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters, -(c - e))
    found = of.where((e > 0) & _kind(F.col("word")).isNull()).select("lang", "word", score.alias("score")).where(F.col("score") >= ABBREVIATION)
    abbreviations = stored(found, "abbreviations")

    ends = _marked(at.where("(stop or mark) and next <> ''"), abbreviations, "word", "short")
    sure = ends.where(F.col("mark") | ~(F.col("short") | _kind(F.col("word")).isNotNull()))
    follow = sure.groupBy("lang", F.col("next").alias("word")).agg(F.count("*").cast("double").alias("k"))
    breaks = follow.groupBy("lang").agg(F.sum("k").alias("a"))
    of = follow.join(counts.select("lang", "word", "c"), ["lang", "word"]).join(F.broadcast(breaks), "lang").join(F.broadcast(total), "lang")
    k, a, b, n = F.col("k"), F.col("a"), F.col("c"), F.col("n")
    likely = lambda hit, of_, p: _log(hit, p) + _log(of_ - hit, 1 - p)
    ratio = 2 * (likely(k, a, k / a) + likely(b - k, n - a, (b - k) / (n - a)) - likely(k, a, b / n) - likely(b - k, n - a, b / n))
    draws = of.where((n > a) & (k / a > b / n)).select("lang", "word", ratio.alias("score")).where(F.col("score") >= STARTER)
    return Model(abbreviations, stored(draws, "starters"))


def split(docs: DataFrame, model: Model, fields: tuple[str, ...] = ("claims", "detd")) -> DataFrame:
    """(lang, doc_id, field, i, sentence): sentences of each field in order, from 0.

    A sentence ends behind a question or exclamation mark, and behind a full stop, unless an abbreviation or a number is
    before it and no sentence starter behind it, or an initial is before it. Only places of sentence ends are shuffled, to their texts.
    Null and empty fields have no sentence; ids are taken to be distinct.
    """
    rows = _tokens(docs, fields)
    at = _places(rows).where("stop or mark")
    at = _marked(_marked(at, model.abbreviations, "word", "short"), model.starters, "next", "starts")
    kind = _kind(F.col("word"))
    open_ = F.coalesce(kind == "initial", F.lit(False)) | ((F.col("short") | F.coalesce(kind == "ordinal", F.lit(False))) & ~F.col("starts"))
    ends = at.where(F.col("mark") | ~open_).groupBy("lang", "doc_id", "field").agg(F.sort_array(F.collect_list("pos")).alias("ends"))
    out = rows.join(ends, ["lang", "doc_id", "field"], "left")
    last = F.size("toks") - 1
    stops = F.coalesce("ends", F.array().cast("array<int>"))
    stops = F.when(F.element_at(stops, -1) == last, stops).otherwise(F.concat(stops, F.array(last)))
    out = out.withColumn("stops", F.when(F.size(F.coalesce("ends", F.array().cast("array<int>"))) == 0, F.array(last)).otherwise(stops))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("stops", i - 1) + 1)
    found = F.transform("stops", lambda e, i: F.array_join(F.slice("toks", begin(i) + 1, e - begin(i) + 1), " "))
    return out.select("lang", "doc_id", "field", F.posexplode(found).alias("i", "sentence"))
