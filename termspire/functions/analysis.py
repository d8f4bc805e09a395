"""Text to terms: tokenizers, per-language analyzers, stemmers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Words with inner apostrophes, decimals and underscores kept together, as standard tokenizers do.
STANDARD = r"[\p{L}\p{N}_]+(?:['’.,·][\p{L}\p{N}][\p{L}\p{N}_]*)*"
#: French elisions.
ELISIONS = "c d j l m n qu s t jusqu quoiqu lorsqu puisqu".split()


def simple_tokens(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def keyword(text: Column) -> Column:
    """The whole value as one token."""
    return F.array(text)


def word_count(text: Column) -> Column:
    return F.size(whitespace_tokens(text))


def standard_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(STANDARD), F.lit(0))


# Porter's algorithm of 1980, as rules on the shape of the stem.

_PORTER_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_PORTER_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for c in stem:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _shape(word).endswith("cc") and word[-1] == word[-2] and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_PORTER_2, _PORTER_3):
        for end in sorted(rules, key=len, reverse=True):
            if word.endswith(end):
                if _measure(word[: -len(end)]):
                    word = word[: -len(end)] + rules[end]
                break
    for end in sorted(_PORTER_4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def english(token: str) -> str:
    return porter(re.sub(r"['’]s$", "", token))


# Light stemmers after Savoy (2006): inflections of nouns and adjectives only.


def german(token: str) -> str:
    """Umlauts and ß folded, ae oe ue to their vowel but for ue after q or a vowel, then light endings."""
    w = token.translate(str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss"}))
    w = re.sub("([ao])e", r"\1", w)
    w = re.sub("(?<![aeiouq])ue", "u", w)
    fold = str.maketrans("àáâèéêëìíîïòóôùúû", "aaaeeeeiiiiooouuu")
    w = w.translate(fold)
    for least, ends in ((6, ("ern",)), (5, ("em", "en", "er", "es")), (4, ("e",))):
        end = next((e for e in ends if w.endswith(e)), None)
        if end and len(w) >= least:
            w = w[: -len(end)]
            break
    else:
        if len(w) > 3 and w.endswith("s") and w[-2] in "bdfghklmnt":
            w = w[:-1]
    if len(w) > 5 and w.endswith(("er", "en")):
        return w[:-2]
    if len(w) > 5 and w.endswith("est"):
        return w[:-3]
    if len(w) > 4 and w.endswith("st") and w[-3] in "bdfghklmnt":
        return w[:-2]
    return w


_FRENCH = (
    ("issement", "ir", 9), ("issant", "ir", 8), ("atrice", "ateur", 8), ("ivement", "if", 9), ("ement", "e", 8), ("ivité", "if", 8), ("ivite", "if", 8),
    ("ité", "", 7), ("ite", "", 7), ("ication", "ique", 9), ("ation", "", 8), ("icatrice", "ique", 10), ("icateur", "ique", 9), ("ateur", "", 8),
    ("teur", "t", 7), ("euse", "eur", 6), ("esse", "eur", 8), ("trice", "teur", 7), ("ive", "if", 6), ("ère", "er", 5), ("ière", "ier", 6), ("onne", "on", 6),
)


def french(token: str) -> str:
    """Elision, then plurals, feminine and derived endings, accents folded, double letters reduced, last vowels off."""
    w = re.sub(rf"^(?:{'|'.join(ELISIONS)})['’]", "", token)
    # Plurals go first, so that both numbers meet the same derived endings.
    if len(w) > 5 and w.endswith("aux") and not w.endswith("eaux"):
        w = w[:-2] + "l"
    elif len(w) > 3 and w.endswith(("x", "s")):
        w = w[:-1]
    for end, new, least in sorted(_FRENCH, key=lambda r: -len(r[0])):
        if len(w) >= least and w.endswith(end):
            w = w[: -len(end)] + new
            break
    w = w.translate(str.maketrans("àáâèéêëîïôùúûç", "aaaeeeeiiouuuc"))
    w = re.sub(r"([a-z])\1", r"\1", w)
    for end in ("ie", "r", "e", "e"):
        if len(w) > 4 and w.endswith(end):
            w = w[: -len(end)]
    return w


STEMMERS = {"en": english, "de": german, "fr": french}


def language(name: str | None) -> str | None:
    """The language with an analyzer that a name means, whatever its case; None if there is none."""
    return name.lower() if name and name.lower() in STEMMERS else None


def stem(terms: DataFrame, lang: str, column: str = "term") -> DataFrame:
    """``terms`` plus ``stem``: each distinct term is stemmed once and joined back."""
    one = STEMMERS[lang]

    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(one)

    found = terms.select(column).distinct().withColumn("stem", stems(column))
    return terms.join(found, column)


def bare_tokens(lang: str, stop: Iterable[str] = ()) -> Callable[[Column], Column]:
    """An analyzer without its stemmer: standard tokens, possessives or elisions and stop words out."""
    stop = sorted(set(stop))
    bare = {"en": r"['’]s$", "fr": rf"^(?:{'|'.join(ELISIONS)})['’]"}.get(lang)

    def tokens(text: Column) -> Column:
        words = standard_tokens(text)
        words = F.transform(words, lambda t: F.regexp_replace(t, bare, "")) if bare else words
        return F.filter(words, lambda t: (t != "") & ~t.isin(*stop)) if stop else F.filter(words, lambda t: t != "")

    return tokens


def language_tokens(lang: str, stop: Iterable[str] = ()) -> Callable[[Column], Column]:
    """A language's whole analyzer for an index or a query: :func:`bare_tokens`, stemmed in Arrow batches."""
    one, before = STEMMERS[lang], bare_tokens(lang, stop)

    @F.pandas_udf("array<string>")
    def stems(texts: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def stemmed(t: str) -> str:
            if t not in known:
                known[t] = one(t)
            return known[t]

        return texts.map(lambda ts: None if ts is None else [stemmed(t) for t in ts])

    return lambda text: stems(before(text))


def analyze(docs: DataFrame, column: str, lang: str, stop: Iterable[str] = ()) -> DataFrame:
    """(doc_id, pos, term): standard tokens, stop words out, stemmed for the language."""
    rows = docs.select("doc_id", F.posexplode(bare_tokens(lang, stop)(F.col(column))).alias("pos", "token"))
    return stem(rows, lang, "token").select("doc_id", "pos", F.col("stem").alias("term"))


def sentence_list(text: Column) -> Column:
    """Sentences of white-space folded, lower-cased text: cut after a full stop, question or exclamation mark and a space."""
    folded = F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))
    return F.filter(F.split(F.regexp_replace(folded, "([.!?]) ", "$1\n"), "\n"), lambda s: s != "")


def word_frequency(docs: DataFrame, column: str) -> DataFrame:
    """(word, n): words by the locale's word boundaries, counted."""
    return docs.select(F.explode(F.flatten(F.sentences(F.lower(column)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
