"""Dedup by winnowing: repeated runs of lines, or of words, stay only where they stand first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.llm.common import spread_join, table, text_of
from termspire.llm.mixing import WORDS

#: A run of lines counts as repeated from this number of words.
MIN_WORDS = 50
#: Places of a fingerprint up to which the runs around it are compared in one go.
COMMON = 1_000


def once(docs: DataFrame) -> DataFrame:
    """``docs`` (id, th, text) with one row of those that repeat id and text: their copies meet as hashes, before any line is made of them."""
    again = table(docs.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("rid"), F.col("th").alias("rth")), "repeated-rows")
    if again.isEmpty():
        return docs
    same = F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))
    # Partial aggregates leave a row a task of each.
    return docs.join(again, same, "left_anti").unionByName(docs.join(again, same, "left_semi").groupBy("id", "th").agg(F.first("text").alias("text")))


def lines_of(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, pos, n, from, upto, h, g, anchor, anchor_at): the lines with words, their places in words, two hashes, and fingerprints.

    Winnowing: of each shortest run of at least ``min_words`` words from a line on, the line with the least hash is its
    fingerprint. Runs that follow each other mostly choose the same line, and the chosen places never go back, so a
    fingerprint stands in one row, at the first run that chooses it, and other rows have none.
    """
    lines = (
        once(docs).select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("line", F.trim("line", F.lit(" \t\r\x0b\x0c")))
        .withColumn("n", F.regexp_count("line", F.lit(WORDS)).cast("long"))
        .where("n > 0")
        .select("id", "th", "pos", "n", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
        .repartition("id", "th")
    )
    text = Window.partitionBy("id", "th")
    lines = lines.withColumn("upto", F.sum("n").over(text.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("from", F.col("upto") - F.col("n"))
    ahead = text.orderBy("from").rangeBetween(0, min_words - 1)
    chosen = F.when(F.sum("n").over(ahead) >= min_words, F.min(F.struct("h", "pos")).over(ahead))
    lines = lines.withColumn("a", chosen).withColumn("b", F.lag("a").over(text.orderBy("from")))
    new = F.col("b").isNull() | (F.col("a.pos") != F.col("b.pos"))
    return lines.select("id", "th", "pos", "n", "from", "upto", "h", "g", F.when(new, F.col("a.h")).alias("anchor"), F.when(new, F.col("a.pos")).alias("anchor_at"))


def windows_around(lines: DataFrame, marks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, k, start, end): the shortest runs of at least ``min_words`` words, from a line on or back from one, that hold a mark (id, th, pos).

    ``k`` is a 128-bit hash of the run's lines and their words. Lines too far from a mark for such a run are left out before
    anything of a run is hashed; a run that would have to bridge them is none.
    """
    text = Window.partitionBy("id", "th")
    rows = lines.select("id", "th", "pos", "n", "from", "upto", "h", "g", F.lit(0).alias("hot"))
    rows = rows.unionByName(marks.select("id", "th", "pos", F.lit(1).alias("hot")), allowMissingColumns=True)
    # A mark meets its line as a peer in the order, so both tables take one shuffle.
    rows = rows.withColumn("hot", F.max("hot").over(text.orderBy("pos").rangeBetween(0, 0))).where("n is not null")
    near = lambda c: F.max("hot").over(text.orderBy(c).rangeBetween(1 - min_words, min_words - 1)) > 0
    rows = rows.withColumn("close", near("from") | near("upto")).where("close")
    ahead = text.orderBy("from").rangeBetween(0, min_words - 1)
    back = text.orderBy("upto").rangeBetween(1 - min_words, 0)

    def run(w):
        return F.struct(
            F.collect_list("h").over(w).alias("h"), F.collect_list("g").over(w).alias("g"), F.sum("n").over(w).alias("n"), F.sum("hot").over(w).alias("hot"),
            F.min("pos").over(w).alias("start"), F.max("pos").over(w).alias("end"), F.min("from").over(w).alias("from"), F.max("upto").over(w).alias("upto"),
        )

    both = rows.select("id", "th", F.col("n").alias("own"), run(ahead).alias("f"), run(back).alias("b"))
    whole = lambda x: (x["n"] >= min_words) & (x["hot"] > 0) & (x["upto"] - x["from"] == x["n"])
    # A backward run that wouldn't do without its last line is also a forward one.
    extra = F.col("b.n") - F.col("own") >= min_words
    kept = F.filter(F.array(F.when(whole(F.col("f")), F.col("f")), F.when(whole(F.col("b")) & extra, F.col("b"))), lambda x: x.isNotNull())
    return both.select("id", "th", F.explode(kept).alias("w")).select(
        "id", "th", F.struct(F.xxhash64("w.h").alias("w1"), F.xxhash64(F.lit(1), "w.g").alias("w2"), F.col("w.n").alias("n")).alias("k"),
        F.col("w.start").alias("start"), F.col("w.end").alias("end"),
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, start, end): runs that stand earlier in the order of id, text hash and line.

    Fingerprints that stand in one place only are dropped: a run of lines that repeats and holds ``min_words`` words chooses the
    same fingerprint, at the same line of it, wherever it stands. From the others matches are extended both ways: each
    shortest run around a fingerprint that also stands earlier is part of the match, and each of them reaches a line
    further than the one before, up to the first that stands nowhere earlier. Occurrences meet in aggregates and go back to their first
    place by :func:`spread_join`, never to each other, so a common line or run is not gathered.
    """
    lines = table(lines_of(docs, min_words), "lines")
    place = lambda at: F.struct(F.col("id").isNull().alias("z"), "id", "th", F.col(at).alias("at"))
    prints = lines.where("anchor_at is not null").select("id", "th", "anchor", "anchor_at")
    twice = prints.groupBy("anchor").agg(F.min(place("anchor_at")).alias("a"), F.max(place("anchor_at")).alias("z")).where("a <> z").select("anchor")
    marks = table(spread_join(prints, twice, "anchor", "left_semi").select("id", "th", F.col("anchor_at").alias("pos")), "fingerprints")
    runs = table(windows_around(lines, marks, min_words).withColumn("place", place("start")), "windows")
    first = runs.groupBy("k").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("k", "first")
    return spread_join(runs, first, "k").where("place > first").select("id", "th", "start", "end")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from ``text``, plus n_lines and n_removed.

    Lines are compared without the white space around them; lines without a word
    don't count. A line goes if it lies in a run of lines with at least
    ``min_words`` words that also stands earlier: in a row with a smaller id (then
    text hash; null ids come last) or further up in the same text, overlaps
    included. Blank lines inside such a run go with it. A row always stays, with an
    empty text if all its lines go; rows that repeat both id and text count as
    one and change alike; null text stays null with 0 lines. Columns of other
    names pass through; the names n_lines and n_removed are replaced.

    Lines, fingerprints and runs are linear in the input (:func:`repeated_runs`). A very long text is as many lines; its runs are
    short. An empty table gives no rows.
    """
    extra = [c for c in docs.columns if c not in (id_col, "text", "n_lines", "n_removed")]
    names = [id_col, "text", *extra]
    rows = docs.select(*names).toDF("id", "text", *(f"x{i}" for i in range(len(extra))))
    rows = rows.withColumn("th", F.xxhash64("text"))
    runs = repeated_runs(rows.select("id", "th", text_of().alias("text")).where("text <> ''"), min_words)
    gone = runs.groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    at = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"]))))
    gone = gone.select(F.col("id").alias("gid"), F.col("th").alias("gth"), at.alias("gone"))
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    out = out.withColumn("lines", lines).withColumn("fresh", text)
    return out.select(
        "id", "fresh", *(f"x{i}" for i in range(len(extra))),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    ).toDF(*names, "n_lines", "n_removed")


#: A word with the white space before it.
_PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """Texts as arrays of word hashes; the generator keeps lambdas from hashing again at each element."""
    words = F.transform(F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1)), lambda w: F.xxhash64(w))
    return docs.select("id", "th", *keep, F.explode(F.array(words)).alias("ws"))


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is worked out once however often ``body`` names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _over(values: Column, width: int, both: Callable[[Column, Column], Column]) -> Column:
    """``values`` combined over each run of ``width`` elements, in the order of their first ones; there are ``width`` at least.

    Runs of doubled length are put together from two of half the length, so an element costs the logarithm of ``width``. The rest
    of ``width`` is one more run that ends where the whole ends; it overlaps the others, so equal runs give equal results,
    which is all that is asked of ``both`` (a minimum, or a hash of what it is given).
    """

    def joined(by: int) -> Callable[[Column], Column]:
        def work(v: Column) -> Column:
            n = F.size(v) - by
            return F.zip_with(F.slice(v, 1, n), F.slice(v, by + 1, n), both)

        return work

    done = 1
    while done < width:
        step = min(done, width - done)
        values, done = _let(values, joined(step)), done + step
    return values


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, g, at): hashes of half-length word runs, the least in each run of ``min_words`` words, with their places from 1.

    Equal runs of ``min_words`` words choose equal hashes at equal offsets.
    """
    k = max(min_words // 2, 1)
    width = min_words - k + 1
    words = _hashed(docs).where(F.size("ws") >= min_words)
    runs = _over(F.col("ws"), k, lambda x, y: F.xxhash64(x, y))
    grams = words.select("id", "th", F.explode(F.array(F.transform(runs, lambda g, i: F.struct(g.alias("g"), i.alias("at"))))).alias("gs"))
    least = F.transform(_over(F.col("gs"), width, lambda x, y: F.least(x, y)), lambda m: m["at"])
    chosen = F.transform(F.array_distinct(least), lambda i: F.get("gs", i))
    out = grams.select("id", "th", F.inline(chosen))
    return out.withColumn("at", F.col("at") + 1)


def repeated_words(docs: DataFrame, copies: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, starts): the sorted places, from 1, of runs of ``min_words`` words that stand earlier.

    Rows of ``copies`` (gid, gth) are left out: all that they hold stands in an earlier row.

    Fingerprints only say where a repeated run may stand; every run around one that
    occurs twice is then compared by a 128-bit hash with all others, so
    matches grow word by word both ways, as far as they stand anywhere earlier.
    Runs around a fingerprint with more than COMMON places are first compared within shares, as many as the root of
    its places; only the first of each share meets those of the others, so the places of a common run are never gathered.
    """
    k = max(min_words // 2, 1)
    other = F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth"))
    prints = table(fingerprints(docs, min_words).join(copies, other, "left_anti"), "fingerprints")
    hot = prints.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    hot = spread_join(prints, hot, "g").withColumn("common", F.col("c") > COMMON).groupBy("id", "th").agg(
        F.collect_set(F.when(~F.col("common"), F.col("at"))).alias("rare"), F.collect_set(F.when(F.col("common"), F.col("at"))).alias("common"),
        F.ceil(F.sqrt(F.max("c"))).alias("salts"),
    ).withColumnsRenamed({"id": "hid", "th": "hth"})
    near = docs.join(hot, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")))
    near = _hashed(near, "rare", "common", "salts")
    last = F.size("ws") - (min_words - 1)
    around = lambda ats: F.flatten(F.transform(ats, lambda a: F.sequence(F.greatest(a - (min_words - k), F.lit(1)), F.least(a, last))))
    run = F.slice("ws", F.col("at"), min_words)
    place = F.struct(F.col("id").isNull().alias("z"), "id", "th", "at")

    def runs(ats: Column) -> DataFrame:
        rows = near.select("id", "th", "ws", "salts", F.explode(ats).alias("at"))
        return rows.select(place.alias("place"), F.xxhash64(run).alias("w1"), F.xxhash64(F.lit(1), run).alias("w2"), "salts")

    # Equal runs choose equal fingerprints, so all places of a common run are among these.
    dealt = runs(F.array_distinct(around("common"))).withColumn("salt", F.pmod(F.xxhash64("place"), F.col("salts")))
    dealt = dealt.withColumn("again", F.col("place") > F.min("place").over(Window.partitionBy("w1", "w2", "salt")))
    # What stands earlier in its share is settled; the first of each share meets those of the others.
    every = runs(F.array_except(around("rare"), around("common"))).select("place", "w1", "w2")
    every = every.unionByName(dealt.where(~F.col("again")).select("place", "w1", "w2"))
    every = every.withColumn("first", F.min("place").over(Window.partitionBy("w1", "w2"))).where("place > first")
    every = every.select("place").unionByName(dealt.where("again").select("place"))
    return every.groupBy("place.id", "place.th").agg(F.sort_array(F.collect_set("place.at")).alias("starts"))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages deleted from ``text`` wherever they begin and end, plus n_words and n_removed.

    A word goes if it lies in a run of ``min_words`` words that also stands earlier, in
    the order of :func:`dedup_lines`, overlaps included; line ends and other white
    space don't matter for it. What stood apart is joined by a line end if one was
    in between, else by a space. Rows are kept as in :func:`dedup_lines`.

    A text whose whole is an earlier row's goes at once; only one copy of it is searched.
    """
    extra = [c for c in docs.columns if c not in (id_col, "text", "n_words", "n_removed")]
    names = [id_col, "text", *extra]
    rows = docs.select(*names).toDF("id", "text", *(f"x{i}" for i in range(len(extra))))
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("n", F.regexp_count(text_of(), F.lit(WORDS)).cast("long"))
    # Texts go through one join, by id and hash; copies are told by hashes alone.
    long = rows.where(F.col("n") >= min_words).select("id", "th", F.struct("th", F.xxhash64(F.lit(1), "text").alias("th2")).alias("k"))
    long = table(long, "long-texts")
    order = F.struct(F.col("id").isNull().alias("z"), "id")
    first = long.groupBy("k").agg(F.min(order).alias("f"), F.max(order).alias("l")).where("f <> l").drop("l")
    copies = spread_join(long, table(first, "first-texts"), "k").where(~F.col("id").eqNullSafe(F.col("f.id")))
    copies = table(copies.select(F.col("id").alias("gid"), F.col("th").alias("gth")).distinct(), "copies")
    gone = repeated_words(rows.where(F.col("n") >= min_words).select("id", "th", "text"), copies, min_words).toDF("gid", "gth", "starts")
    gone = gone.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left").drop("gid", "gth")
    out = out.withColumn("copy", F.coalesce("copy", F.lit(False)))
    # Overlapping and adjoining runs make one; what is kept lies between.
    begins = F.filter("starts", lambda s, i: (i == 0) | (F.get("starts", i - 1) + min_words < s))
    ends = F.filter("starts", lambda s, i: (i == F.size("starts") - 1) | (F.get("starts", i + 1) > s + min_words))
    out = out.withColumn("cut", F.when(F.col("starts").isNotNull() & ~F.col("copy"), F.struct(begins.alias("b"), ends.alias("e"))))
    apart = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("cut.e", lambda e: e + (min_words - 1))),
        F.concat(F.col("cut.b"), F.array(F.col("n").cast("int") + 1)),
        lambda e, b: F.struct((e + 1).alias("a"), (b - 1).alias("z")),
    )
    kept = F.filter(F.transform(apart, lambda x, i: F.struct(
        x["a"].alias("a"), x["z"].alias("z"),
        F.when(i > 0, F.get("cut.b", i - 1)).alias("b"),
    )), lambda x: x["a"] <= x["z"])
    pieces = F.when(F.col("cut").isNotNull(), F.regexp_extract_all("text", F.lit(f"({_PIECE})"), F.lit(1)))
    out = out.withColumn("kept", kept).withColumn("m", F.explode(F.array(F.struct(pieces.alias("p"), F.col("kept").alias("k")))))
    trimmed = lambda t: F.regexp_replace(t, r"^[\x20\x09-\x0D]+", "")
    joined = lambda a, z: F.array_join(F.slice("m.p", a, z - a + 1), "")
    white = lambda i: F.regexp_extract(F.get("m.p", i - 1), r"^[\x20\x09-\x0D]*", 0)
    between = lambda x: F.when(F.concat(joined(x["b"], x["a"] - 1), white(x["a"])).contains("\n"), "\n").otherwise(" ")
    # Only the cut before a text's first kept word leaves nothing to join.
    parts = F.transform("m.k", lambda x, i: F.when(x["b"].isNull(), joined(x["a"], x["z"])).otherwise(
        F.concat(F.when(i == 0, "").otherwise(between(x)), trimmed(joined(x["a"], x["z"])))
    ))
    left = F.aggregate("m.k", F.lit(0), lambda n, x: n + x["z"] - x["a"] + 1)
    fresh = F.when(F.col("copy"), "").when(F.col("cut").isNotNull(), F.array_join(parts, "")).otherwise(F.col("text"))
    removed = F.when(F.col("copy"), F.col("n")).when(F.col("cut").isNotNull(), F.col("n") - left).otherwise(0)
    return out.select("id", fresh, *(f"x{i}" for i in range(len(extra))), "n", removed.cast("long")).toDF(*names, "n_words", "n_removed")
