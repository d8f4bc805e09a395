"""Personal data: fixed patterns, and identifiers that share their lexical contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.llm.common import spread_join, table, text_of

KINDS = ("email", "ip", "card", "phone")
#: Same leftmost matches as the plain forms, in linear time: possessive loops don't back off, and a match starts where its run
#: of characters starts or where the last match ended.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Texts without these can't match.
NEEDS = ("@", "[0-9]", "[0-9]", r"\+")
#: White-space delimited tokens with a digit or an at sign: what contexts may point at.
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
OTHER = len(KINDS)
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Scores that rise by no more than this change nothing any more.
RISE = 0.01


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    # From the right, every second digit doubles and loses 9 beyond 9.
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.expr("0") + c.try_cast("int"))
    summed = F.aggregate(
        F.transform(values, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d)), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))
    )
    return (
        F.when(kind == 1, value.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$"))
        .when(kind == 2, n.between(16, 19) & (F.when(n.between(16, 19), summed).otherwise(1) % 10 == 0))
        .when(kind == 3, n.between(8, 15))
        .otherwise(True)
    )


#: The last two words of what stands before a token, and the first two of what stands behind it, with the space around them.
_TAIL = r"(?<!\S)(?:\S++\s++)?\S*+\s*+\z"
_HEAD = r"^\s*+(?:\S++\s++)?\S*+"


def _words(*parts: Column) -> Column:
    return F.filter(F.split(F.lower(F.concat_ws(" ", *parts)), r"\s+"), lambda w: w != "")


def matches(docs: DataFrame) -> DataFrame:
    """Every leftmost non-overlapping match of each kind, and every identifier-like token.

    (id, th, kind, start, end, value, left, right, near): places in code points, end
    exclusive; ``left`` and ``right`` are the two whole words on each side of a token, whatever their length and whether they hold
    digits themselves, ``near`` whether one space parts it from the token before. Texts are cut at the
    matches by the same pattern, so a place is the running length of what
    stands before it, summed over the rows of a text.
    """
    none = F.lit(None).cast("string")

    def cut(pattern: str) -> Column:
        pieces = F.struct(F.split("text", pattern, -1).alias("p"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"))
        return F.explode(F.array(pieces)).alias("c")

    def plain(k: int) -> DataFrame:
        found = F.transform("c.m", lambda m, i: F.struct(
            F.lit(k).alias("kind"), i.alias("i"), F.length(F.get("c.p", i)).alias("skip"), m.alias("value"),
            none.alias("left"), none.alias("right"), F.lit(False).alias("near"),
        ))
        return docs.where(F.col("text").rlike(NEEDS[k])).select("id", "th", cut(PATTERNS[k])).select("id", "th", F.inline(found))

    p, m = (lambda i: F.get("c.p", i)), (lambda i: F.get("c.m", i))
    tail, head = (lambda x: F.regexp_extract(x, _TAIL, 0)), (lambda x: F.regexp_extract(x, _HEAD, 0))

    def around(value: Column, i: Column) -> Column:
        before = _words(m(i - 2), tail(p(i - 1)), m(i - 1), tail(p(i)))
        after = _words(head(p(i + 1)), m(i + 1), head(p(i + 2)), m(i + 2))
        return F.struct(
            F.lit(OTHER).alias("kind"), i.alias("i"), F.length(p(i)).alias("skip"), value.alias("value"),
            F.array_join(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), 2), " ").alias("left"),
            F.array_join(F.slice(after, 1, 2), " ").alias("right"), (p(i) == " ").alias("near"),
        )

    tokens = docs.where(F.col("text").rlike("[0-9@]")).select("id", "th", cut(TOKEN)).select("id", "th", F.inline(F.transform("c.m", around)))
    rows = reduce(DataFrame.unionByName, [*map(plain, range(OTHER)), tokens])
    rows = table(rows, "matches").dropDuplicates(["id", "th", "kind", "i"])
    upto = Window.partitionBy("id", "th", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("skip") + F.length("value")).over(upto)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("i", "skip")


def instances(spans: DataFrame) -> DataFrame:
    """(id, th, start, end, value, seed, left, right): entities and what might be some, with the words around them.

    ``spans`` are :func:`matches` without failing base ones. A base span is a seed of its kind; the words before the token that
    it starts in and behind the one that it ends in are its context. Tokens that no base span touches and that single
    spaces join are one candidate, which needs four digits or an at sign.
    """
    text = Window.partitionBy("id", "th")
    base = F.col("kind") < OTHER
    token = lambda c: F.last(F.when(~base, F.col(c)), ignorenulls=True)
    upto = lambda *order: text.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = spans.withColumn("rank", F.when(base, 1).otherwise(0)).withColumn("at", F.when(base, F.col("end") - 1).otherwise(F.col("start")))
    rows = rows.withColumn("before", token("left").over(upto("start", "rank"))).withColumn("behind", token("right").over(upto("at", "rank")))
    ahead = text.orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("covered", F.max(F.when(base, F.col("end"))).over(text.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next", F.min(F.when(base, F.col("start"))).over(ahead))
    seeds = rows.where(base).select("id", "th", "start", "end", F.lower("value").alias("value"), F.col("kind").alias("seed"), F.col("before").alias("left"), F.col("behind").alias("right"))
    free = ~(F.coalesce(F.col("covered") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    tokens = rows.where(~base).withColumn("free", free)
    order = text.orderBy("start")
    joined = F.col("free") & F.col("near") & F.coalesce(F.lag("free").over(order), F.lit(False))
    tokens = tokens.withColumn("new", F.when(joined, 0).otherwise(1))
    tokens = tokens.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("free")
    runs = tokens.groupBy("id", "th", "run").agg(
        F.min("start").alias("first"), F.min_by("left", "start").alias("left"), F.max_by("right", "start").alias("right"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), " ").alias("whole"),
    )
    lead = F.length(F.regexp_extract("whole", r"^[^\p{L}\p{N}+(]*+", 0))
    bare = F.regexp_replace(F.regexp_replace("whole", r"^[^\p{L}\p{N}+(]++", ""), r"(?<![^\p{L}\p{N})])[^\p{L}\p{N})]++\z", "")
    runs = runs.withColumn("bare", bare).withColumn("start", F.col("first") + lead)
    like = (F.regexp_count("bare", F.lit("[0-9]")) >= 4) | F.col("bare").contains("@")
    runs = runs.where(like).select(
        "id", "th", "start", (F.col("start") + F.length("bare")).alias("end"), F.lower("bare").alias("value"), F.lit(None).cast("int").alias("seed"), "left", "right"
    )
    return seeds.unionByName(runs)


def discover(
    spans: DataFrame, rounds: int | None = None, min_support: int = 3, min_confidence: float = 0.75
) -> DataFrame:
    """Further spans (id, th, kind, start, end) that contexts of entities point at.

    A lexical pattern is the two words before an instance, or the two behind it; the graph has each distinct
    pair of pattern and value. Seeds score 1. In each round a pattern's support for a kind is the number
    of its values that are trusted to be of it, whether seeds or found in a round before, and its confidence
    the sum of their scores over all of its values; with ``min_support`` and ``min_confidence`` it is trusted,
    and so are its values, which score the best confidence that a pattern of theirs has had. So
    found identifiers induce patterns of the next round, which find more. Rounds go on until no value is newly trusted and no score
    rises by more than RISE, unless ``rounds`` says how many are wanted; values and scores only rise, so there is an end. Every round
    is a few aggregates and joins over the graph; common patterns and values are joined by :func:`spread_join`. Candidates in a
    trusted pattern are the spans found.
    """
    rows = table(instances(spans), "contexts")
    sided = F.array(F.struct(F.lit("<").alias("side"), F.col("left").alias("words")), F.struct(F.lit(">").alias("side"), F.col("right").alias("words")))
    placed = rows.where("value <> ''").select("*", F.explode(sided).alias("c")).where("c.words <> ''").withColumn("pattern", F.concat("c.side", "c.words"))
    # Distinct pairs carry the graph; repeated text adds nothing to it.
    graph = table(placed.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    seeds = graph.groupBy("value").agg(F.max("seed").alias("kind")).where("kind is not null").withColumn("score", F.lit(1.0))
    # A pattern of fewer values than the support can't be trusted; its pairs stay out.
    sizes = table(graph.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= min_support), "sizes")
    graph = table(spread_join(graph, sizes, "pattern").select("pattern", "value", "size"), "graph")
    scores, trust = table(seeds, "scores"), None
    while True:
        known = spread_join(graph, scores, "value")
        mass = known.groupBy("pattern", "kind").agg(F.count("*").alias("support"), F.sum("score").alias("mass"), F.max("size").alias("size"))
        mass = mass.withColumn("confidence", F.col("mass") / F.col("size")).where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
        best = mass.groupBy("pattern").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("b"))
        trust = table(best.select("pattern", F.col("b.confidence").alias("confidence"), (-F.col("b.col2")).alias("kind")), "patterns")
        found = spread_join(graph, trust, "pattern").groupBy("value").agg(F.max(F.struct(F.col("confidence").alias("score"), -F.col("kind"))).alias("b"))
        found = found.select("value", (-F.col("b.col2")).alias("kind"), "b.score").unionByName(scores.withColumn("old", F.col("score")), allowMissingColumns=True)
        best = found.groupBy("value").agg(F.max(F.struct("score", -F.col("kind"))).alias("b"), F.max("old").alias("old"), F.max(F.struct("old", "kind")).alias("was"))
        seed = F.col("was.old") == 1.0
        kind = F.when(seed, F.col("was.kind")).otherwise(-F.col("b.col2"))
        scores = table(best.select("value", kind.alias("kind"), "b.score", (F.col("b.score") - F.coalesce("old", F.lit(0.0))).alias("rise")), "scores")
        rounds = None if rounds is None else rounds - 1
        if rounds == 0 or scores.where(F.col("rise") > RISE).isEmpty():
            break
        scores = scores.drop("rise")
    open_ = table(placed.where("seed is null").select("id", "th", "start", "end", "pattern"), "candidates")
    hits = spread_join(open_, trust, "pattern").groupBy("id", "th", "start", "end").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("b"))
    return hits.select("id", "th", (-F.col("b.col2")).alias("kind"), "start", "end")


def find_pii(docs: DataFrame, id_col: str = "doc_id", min_support: int = 3, min_confidence: float = 0.75) -> DataFrame:
    """A row for each row: id, n_email, n_ip, n_card, n_phone, base_spans, spans.

    The counts and ``base_spans`` are those of the fixed patterns after validation;
    ``spans`` adds what :func:`discover` finds. Both are arrays of (kind number,
    start, end), sorted. Null text is empty and has no spans; rows that repeat id and
    text get the same; null ids are ids like any other; other columns are ignored; an empty table gives no rows. A very long text is
    searched whole, by patterns that take linear time.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of().alias("text")).withColumn("th", F.xxhash64("text"))
    found = matches(rows.where("text rlike '[0-9@+]'"))
    found = table(found.where(_valid(F.col("kind"), F.col("value"))), "spans")
    more = discover(found, min_support=min_support, min_confidence=min_confidence)
    both = found.where(F.col("kind") < OTHER).select("id", "th", "kind", "start", "end", F.lit(True).alias("base"))
    both = both.unionByName(more.withColumn("base", F.lit(False)))
    span = F.struct("kind", "start", "end")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    by_text = both.groupBy("id", "th").agg(
        *counts,
        F.sort_array(F.collect_set(F.when(F.col("base"), span))).alias("base_spans"),
        F.sort_array(F.collect_set(span)).alias("spans"),
    )
    by_text = by_text.withColumnsRenamed({"id": "sid", "th": "sth"})
    out = rows.select("id", "th").join(by_text, F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left")
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return out.select(
        F.col("id").alias(id_col),
        *(F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.coalesce("base_spans", empty).alias("base_spans"),
        F.coalesce("spans", empty).alias("spans"),
    )


def spans_text(spans: str) -> Column:
    """``kind:start:end`` by kind and start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
