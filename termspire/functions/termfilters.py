"""Predicates on terms, as boolean columns: true keeps the term."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = {
    "ALPHA": r"\p{Alpha}", "ALPHANUM": r"\p{Alnum}", "ASCII": r"\p{ASCII}", "DIGIT": r"\p{Digit}", "GREEK": r"\p{InGreek}", "PUNCT": r"\p{Punct}",
}
# Prefixes and names of units, and words that follow numbers.
PREFIXES = "a c d e f g h k m n p t y z µ".split()
UNITS = "a bar bq c cd f gy h hz j k kat kg l l3 lm lx m m2 m3 mol n pa rad s sr sv v w wb torr ° °c °f °k Ω".split()
WORDS = "fach molar met meter millimet millimeter inch volt zoll".split()
#: A digit, then a unit or one of the words, at the end of a term.
UNIT = f".*[0-9](?:[{''.join(PREFIXES)}]?(?:{'|'.join(UNITS)})|{'|'.join(WORDS)})$"


def class_count(term: Column, name: str) -> Column:
    return F.regexp_count(term, F.lit(CLASSES[name]))


def accept_all(term: Column) -> Column:
    return F.lit(True)


def not_in(term: Column, words: Iterable[str]) -> Column:
    words = list(words)
    return ~term.isin(*words) if words else F.lit(True)


def not_starting(term: Column, name: str) -> Column:
    return ~term.rlike("^" + CLASSES[name])


def not_repeating(term: Column, n: int) -> Column:
    """No word character ``n`` times in a row."""
    return ~term.rlike(r"(\w)" + r"\1" * (n - 1))


def alpha_at_least(term: Column, n: int) -> Column:
    return class_count(term, "ALPHA") >= n


def _ratio(digits: Column, of: Column, test) -> Column:
    return F.when(of > 0, test(digits / of))


def not_number_with_unit(term: Column, ratio: float, alpha_only: bool) -> Column:
    """Rejects what ends like a number with its unit and has that share of digits; with ``alpha_only`` of the letters.

    No letters at all make the share infinite, no digits either make it undefined.
    """
    digits, of = class_count(term, "DIGIT"), class_count(term, "ALPHA") if alpha_only else F.length(term)
    return ~(term.rlike("^" + UNIT) & F.coalesce(_ratio(digits, of, lambda r: r >= ratio), digits > 0))


def no_greek(term: Column) -> Column:
    return class_count(term, "GREEK") == 0


def non_ascii_at_most(term: Column, share: float) -> Column:
    return F.coalesce(_ratio(F.length(term) - class_count(term, "ASCII"), F.length(term), lambda r: r <= share), F.lit(False))


def digits_at_most(term: Column, share: float, alpha_only: bool = False) -> Column:
    of = class_count(term, "ALPHA") if alpha_only else F.length(term)
    return F.coalesce(_ratio(class_count(term, "DIGIT"), of, lambda r: r <= share), F.lit(False))


def simple_filter(term: Column) -> Column:
    parts = [
        not_starting(term, "DIGIT"), not_starting(term, "PUNCT"), alpha_at_least(term, 3), not_repeating(term, 3),
        digits_at_most(term, 0.5, True), no_greek(term), non_ascii_at_most(term, 0.3), not_number_with_unit(term, 0.2, True),
    ]
    return reduce(lambda a, b: a & b, parts)


def common_terms(postings: DataFrame, threshold: float) -> DataFrame:
    """(term, rel): terms that at most that share of the view's documents hold, in any field."""
    n = postings.agg(F.count_distinct("doc_id").alias("n"))
    df = postings.select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).withColumn("rel", F.col("df") / F.col("n")).where(F.col("rel") <= threshold).select("term", "rel")
