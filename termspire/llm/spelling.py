"""Spelling variants: words one edit apart, found by Aho-Corasick automata over halves of words."""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspire.llm.common import table, text_of
from termspire.llm.components import drop

RUNS = r"[A-Za-zÀ-ÿ]+"
#: Patterns that may share their segments before they are cut again.
SHARED = 64
#: Rows that a shard is meant to have.
SHARD = 40_000


def typed_words(docs: DataFrame, id_col: str = "doc_id", every: int = 31) -> DataFrame:
    """(word): each run of letters of each text, A-Z lower-cased; about one in ``every`` loses a letter, as crc32("id:run") tells.

    Null text has no runs, a null id counts as the empty string in the hash. ``every`` 0 changes nothing.
    """
    runs = F.explode(F.regexp_extract_all(text_of(), F.lit(RUNS), 0))
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run")).select("id", low.alias("run"))
    if not every:
        return rows.select(F.col("run").alias("word"))
    h = F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return rows.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_len: int = 7, min_n: int = 2) -> DataFrame:
    """(word, n): words of at least ``min_len`` code points that stand ``min_n`` times or more."""
    return words.where(F.length("word") >= min_len).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``: the pattern's length and open part [a, b), and the text around it, which the edit leaves alone.

    A word of another length has the same text around it if it has these first ``a`` and these last ``size - b`` characters.
    """
    before = F.substr("word", F.lit(1), F.col("a"))
    after = F.substr("word", F.length("word") - (F.col("size") - F.col("b")) + 1)
    return rows.withColumn("key", F.concat_ws("|", "size", "a", "b", before, after))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: the edit is behind the middle of its open part, or before it."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.array(F.struct(mid.alias("a"), F.col("b")), F.struct(F.col("a"), mid.alias("b")))
    return _keyed(rows.withColumn("mid", F.explode(parts)).select("word", "n", "pattern", "size", "mid.a", "mid.b"))


def _segments(words: DataFrame, shared: int) -> DataFrame:
    """Patterns and the words that may match them, by ``key``, so that few patterns have the same one.

    Every word is cut in two halves, one of which a single edit leaves alone. Where more than ``shared`` patterns agree in a half,
    the rest of these is cut again, and so on until a rest of one character is left: such a group is no larger than
    the square of the alphabet. What a round writes is removed once the next has read it.
    """
    length = F.length("word")
    sizes = F.array(F.struct(length.alias("size"), F.lit(True).alias("pattern")), *(F.struct((length + d).alias("size"), F.lit(False).alias("pattern")) for d in (-1, 0, 1)))
    rows = words.withColumn("s", F.explode(sizes)).select("word", "n", "s.pattern", "s.size", F.lit(0).alias("a"), F.col("s.size").alias("b"))
    done, rows = None, table(_halves(rows), "segments")
    while True:
        counts = rows.where(F.col("pattern") & (F.col("b") - F.col("a") > 1)).groupBy("key").agg(F.count("*").alias("m"))
        heavy = table(counts.where(F.col("m") > shared).select("key"), "common-segments")
        if heavy.isEmpty():
            return rows if done is None else done.unionByName(rows)
        light = table(rows.join(heavy, "key", "left_anti").select(rows.columns), "rare-segments")
        done = light if done is None else done.unionByName(light)
        old, rows = rows, table(_halves(rows.join(heavy, "key", "left_semi")), "segments")
        drop(old)


def _scan(group: pa.Table) -> pa.Table:
    """The pairs (word, n, near, near_n) of a shard: its patterns' segments in one automaton, which scans its words.

    A pattern's segment is the longer of the texts around its open part. A hit counts where it stands at the word's start or end,
    as the pattern's does, if length and the other text agree; then the distance is verified. A pair that several
    cuts could find is left to the one whose open part is furthest right.
    """
    c = {n: group.column(n).to_pylist() for n in ("word", "n", "pattern", "size", "a", "b")}
    patterns: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
    shapes: dict[str, set] = defaultdict(set)
    for word, n, is_pattern, size, a, b in zip(*c.values(), strict=True):
        if is_pattern:
            segment = word[:a] if a >= size - b else word[b:]
            patterns[size, a, b, word[:a], word[b:]].append((word, n))
            shapes[segment].add((size, a, b))
    scan = ahocorasick.Automaton()
    for segment, own in shapes.items():
        scan.add_word(segment, (len(segment), own))
    out: list[tuple] = []
    if shapes:
        scan.make_automaton()
        for word, n in dict(zip(c["word"], c["n"], strict=True)).items():
            for end, (size_of, own) in scan.iter(word):
                for size, a, b in own:
                    if abs(len(word) - size) > 1:
                        continue
                    tail = size - b
                    if not (end + 1 == a == size_of if a >= tail else end + 1 == len(word) and size_of == tail):
                        continue
                    for near, m in patterns.get((size, a, b, word[:a], word[len(word) - tail :]), ()):
                        if (b == size or word[:b] != near[:b]) and one_edit(word, near):
                            out.append((word, n, near, m))
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["word", "n", "near", "near_n"])


def near_words(words: DataFrame, shared: int = SHARED, shard: int = SHARD) -> DataFrame:
    """(word, n, near, near_n): all pairs of distinct ``words`` (word, n) one edit apart, in both directions, once each.

    Words have two characters at least. The pairs are those of Aho-Corasick automata by :func:`_scan`, a shard an automaton. A shard
    holds the segments that a hash gives it, and the words that could hold one of them there: a word goes to six
    shards at most for each time that a common half is cut again, however many shards there are.
    """
    rows = _segments(words, shared)
    n = -(-rows.count() // shard) or 1
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    return dealt.select("shard", "word", "n", "pattern", "size", "a", "b").groupBy("shard").applyInArrow(_scan, "word string, n long, near string, near_n long")


def _largest(n: Column, word: Column) -> Column:
    """The word of largest ``n``, ties to the smallest in code-point order."""
    return F.min(F.struct((-n).alias("m"), word.alias("w")))


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each of ``words`` (word, n).

    ``form`` is the near word of largest n, if that is ``times`` the word's own at least; ``root`` is where forms lead to. n rises along forms by
    a factor of ``times`` > 1, so a chain has as many links as n has digits, and doubling ends after a few rounds.
    An empty table gives no rows.
    """
    words = table(words.select("word", "n"), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), _largest(F.col("near_n"), F.col("near")).alias("best"))
    best = words.join(near, "word", "left").withColumns({"n_near": F.coalesce("n_near", F.lit(0)).cast("long"), "form_n": -F.col("best.m"), "form": F.col("best.w")})
    ok = F.col("form_n") >= times * F.col("n")
    out = table(best.select("word", "n", "n_near", F.when(ok, F.col("form")).alias("form"), F.when(ok, F.col("form_n")).alias("form_n")), "forms")
    links = table(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        old, links = links, table(after, "roots")
        drop(old)
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    roots = links.select("word", "root")
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_spellings(docs: DataFrame, id_col: str = "doc_id", every: int = 31, min_len: int = 7, min_n: int = 2, times: int = 10) -> DataFrame:
    """:func:`variants` of the words of whole texts (``text``), as :func:`typed_words` and :func:`vocabulary` make them.

    Null and empty texts have no words; rows that repeat count each time; columns of other names are ignored; empty tables give no rows.
    """
    return variants(vocabulary(typed_words(docs, id_col, every), min_len, min_n), times)
