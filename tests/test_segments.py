"""An index that grows: added, replaced and deleted documents, merges, and plans that read its buckets as they are."""

import random
import re

import pytest
from pyspark.sql import functions as F

from termspire import cli
from termspire.operators import joins
from termspire.operators import retrieval as R
from termspire.operators.view import View
from termspire.sources import segments, store

SHAPE = "doc_id long, lang string, claims string, detd string"
WORDS = [f"w{i}" for i in range(25)]


def made(rng, ids):
    text = lambda: " ".join(rng.choice(WORDS[: rng.randint(2, 25)]) for _ in range(rng.randint(1, 12)))
    return {i: (text() if rng.random() < 0.9 else None, text() if rng.random() < 0.8 else None) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame([(i, "en", a, b) for i, (a, b) in docs.items()], SHAPE)


def statistics(path, spark):
    v = View.open(spark, path, "en")
    rows = lambda df: sorted(map(str, df.collect()))
    return rows(v.by_term()), rows(v.by_field()), rows(v.doc_model()), rows(v.field_lengths()), rows(v.field_terms()), rows(v.collection())


def plain(parts):
    """(term, tf, df) of several segments: df of each one's largest field, summed."""
    tf, df = {}, {}
    for docs in parts:
        own = {}
        for fields in docs.values():
            for f, text in enumerate(fields):
                for w in (text or "").split():
                    tf[w] = tf.get(w, 0) + 1
                for w in set((text or "").split()):
                    own.setdefault(w, [0, 0])[f] += 1
        for w, counts in own.items():
            df[w] = df.get(w, 0) + max(counts)
    return sorted((w, tf[w], df[w]) for w in tf)


def test_segments(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "idx")
    first = made(rng, range(60))
    segments.write_index(frame(spark, first), path, buckets=3)
    files = lambda: {line.rsplit(" ", 1)[0] for name in segments.TABLES for line in store.state(spark, f"{path}/{name}").split("\n") if ".parquet " in line}
    before = files()
    second = made(rng, [*range(60, 75), 3, 4])
    segments.add_documents(frame(spark, second), path)
    assert before < files()  # nothing that was there is written again
    gone = [5, 61, 999]
    segments.delete_documents(spark.createDataFrame([(i,) for i in gone], "doc_id long"), path)
    parts = [{i: d for i, d in first.items() if i not in (3, 4, 5)}, {i: d for i, d in second.items() if i != 61}]
    view = View.open(spark, path, "en")
    assert sorted((r.term, r.tf, r.df) for r in view.by_term().collect()) == plain(parts)
    live = {**parts[0], **parts[1]}
    assert view.collection().first().n_docs == sum(1 for a, b in live.values() if a or b)
    assert view.stored().by_term().exceptAll(view.by_term()).isEmpty()
    restricted = view.fields(["claims"]).by_term().collect()
    assert sorted((r.term, r.tf, r.df) for r in restricted) == plain([{i: (a, None) for i, (a, _) in p.items()} for p in parts])
    sizes = sorted(r.n_docs for r in segments.segment_sizes(spark, path).collect())
    assert sizes == sorted(sum(1 for a, b in p.values() if a or b) for p in parts)

    fresh = str(tmp_path / "fresh")
    segments.write_index(frame(spark, live), fresh, buckets=3)
    assert segments.merge_segments(spark, path, below=1) == segments.latest(spark, path)  # none is so small
    segments.merge_segments(spark, path)
    assert statistics(path, spark) == statistics(fresh, spark)
    assert len(segments.latest(spark, path).segments) == 1 and not segments.latest(spark, path).deleted
    assert segments.vacuum(spark, path) and not segments.vacuum(spark, path)
    assert statistics(path, spark) == statistics(fresh, spark)
    # A document that was deleted may come back.
    segments.add_documents(frame(spark, {5: ("w1 w1", None)}), path)
    assert View.open(spark, path, "en").doc_ids().where("doc_id = 5").count() == 1


def test_partial_merges_keep_the_newest_version(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "idx")
    docs = made(rng, range(40))
    segments.write_index(frame(spark, docs), path, buckets=2)
    for k in range(3):  # small segments, each with a new version of document 1
        more = made(rng, [1, 100 + k])
        docs |= more
        segments.add_documents(frame(spark, more), path)
    segments.merge_segments(spark, path, below=10)
    commit = segments.latest(spark, path)
    assert len(commit.segments) == 2 and commit.dirty and commit.deleted
    fresh = str(tmp_path / "fresh")
    segments.write_index(frame(spark, docs), fresh)
    assert statistics(path, spark)[1:4] == statistics(fresh, spark)[1:4]


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "idx")
    segments.write_index(frame(spark, {1: ("a", "b")}), path)
    old = segments.latest(spark, path)
    segments.add_documents(frame(spark, {2: ("a", None)}), path)
    monkeypatch.setattr(segments, "latest", lambda *_: old)
    with pytest.raises(segments.Conflict):
        segments.add_documents(frame(spark, {3: ("a", None)}), path)
    monkeypatch.undo()
    assert sorted(r.doc_id for r in View.open(spark, path, "en").doc_ids().collect()) == [1, 2]  # the loser's files don't count
    assert segments.vacuum(spark, path)
    with pytest.raises(FileNotFoundError):
        segments.add_documents(frame(spark, {3: ("a", None)}), str(tmp_path / "nowhere"))


def test_empty_tables_and_string_ids(spark, tmp_path):
    path = str(tmp_path / "idx")
    none = spark.createDataFrame([], "doc_id string, lang string, claims string, detd string")
    segments.write_index(none, path)
    assert View.open(spark, path, "en").by_term().count() == 0
    segments.add_documents(spark.createDataFrame([("EP1", "en", "a a", None), ("EP2", "en", None, "")], none.schema), path)
    assert [tuple(r) for r in View.open(spark, path, "en").by_term().collect()] == [("a", 2, 1)]
    segments.delete_documents(spark.createDataFrame([("EP1",)], "doc_id string"), path)
    assert View.open(spark, path, "en").by_term().count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_are_read_as_they_are(spark, tmp_path):
    path = str(tmp_path / "idx")
    segments.write_index(frame(spark, made(random.Random(4), range(50))), path, buckets=4)
    v = View.open(spark, path, "en")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(v.doc_lengths())
        assert "Exchange" not in plan(v.doc_model().join(v.field_lengths(), "doc_id"))
        assert plan(v.by_term()).count("Exchange") == 0  # statistics are bucketed by term
        terms = store.stored(R.query_terms(spark.createDataFrame([(1, "w1 w2")], "q_id long, text string"), "q_id", "text"), "terms")
        assert not re.search(r"hashpartitioning\((q_id#\d+L, doc_id|doc_id)", plan(R.matched(v, terms)))  # pairs stay where they are made
        fb = spark.createDataFrame([(1, 2)], "q_id long, doc_id long")
        shuffled = [x for x in plan(v.vocabulary(fb)).split("\n") if "Exchange hashpartitioning(doc_id" in x]
        assert len(shuffled) == 1  # the feedback's side
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_meet(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIGHT", 3)
    rows = spark.createDataFrame([("the", i) for i in range(50)] + [("rare", 7), ("none", 8)], "term string, doc_id long")
    queries = store.stored(spark.createDataFrame([(1, "the"), (2, "the"), (2, "rare"), (3, "absent")], "q_id long, term string"), "queries")
    want = sorted([("the", i, q) for i in range(50) for q in (1, 2)] + [("rare", 7, 2)])
    for small in (0, 10):
        got = joins.meet(rows, queries, ["term"], small)
        assert sorted((r.term, r.doc_id, r.q_id) for r in got.collect()) == want


def test_commands_on_segments(spark, tmp_path):
    texts = {i: f"word{i % 3} common\nrest {i}. more words" for i in range(12)}
    put = lambda name, rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / name / "documents.parquet"))
    put("one", texts)
    put("two", {3: "changed\nnow", 50: "new\none"})
    (tmp_path / "ids.txt").write_text("4\n\n77\n")
    go = lambda *args: cli.run(spark, [args[0], "--index", str(tmp_path / "idx"), *args[1:]])
    go("index", "--source", str(tmp_path / "one"))
    assert go("add", "--source", str(tmp_path / "two")).where("field is null").first().docs == 13
    assert go("delete", "--source", str(tmp_path / "ids.txt")).where("field is null").first().docs == 12
    docs = segments.read_rows(spark, str(tmp_path / "idx")).select("doc_id", "claims").collect()
    assert {r.doc_id for r in docs} == {*range(12), 50} - {4} and {r.doc_id: r.claims for r in docs}[3] == "changed"
    assert go("merge", "--vacuum").count() == 1
    assert go("idx-stats", "--db", str(tmp_path / "db")).where("field is null").first().docs == 12


def test_buckets_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    """A task holds a bucket's postings: more text is more buckets, not larger ones."""
    monkeypatch.setattr(segments, "BUCKET_BYTES", 1_000, raising=False)
    rng = random.Random(5)
    docs = {i: (" ".join(rng.choices(WORDS, k=30)), None) for i in range(60)}
    bytes_ = sum(len(a) for a, _ in docs.values())
    assert segments.write_index(frame(spark, docs), str(tmp_path / "idx")).buckets == -(-bytes_ // 1_000) > 4
    n = lambda docs: segments._buckets(docs, ("claims", "detd"))
    assert n(frame(spark, docs).limit(0)) == 4  # as many as cores
    short = spark.range(6 * segments.BUCKET).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("claims"), F.lit("").alias("detd"))
    assert n(short) == 6


def test_more_documents_are_more_buckets_and_the_same_rows(spark, tmp_path, monkeypatch):
    """F5 to F21: the largest bucket stays as it is when the table grows, and no result depends on the number of buckets."""
    monkeypatch.setattr(segments, "BUCKET_BYTES", 500, raising=False)
    rng = random.Random(7)
    docs = {i: (" ".join(rng.choices(WORDS, k=10)), " ".join(rng.choices(WORDS, k=10))) for i in range(320)}
    few, many, one = (str(tmp_path / x) for x in ("few", "many", "one"))
    most = {}
    for n, path in ((80, few), (320, many)):
        buckets = segments.write_index(frame(spark, {i: docs[i] for i in range(n)}), path).buckets
        at = F.pmod(F.hash("doc_id"), F.lit(buckets))  # as Spark deals rows to buckets
        most[n] = segments.read_index(spark, path).groupBy(at.alias("b")).count().agg(F.max("count")).first()[0]
    assert most[320] < 2 * most[80]
    segments.write_index(frame(spark, docs), one, buckets=1)
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w20 w21"), (3, "w7 none")], "q_id long, text string")

    def rows(path):
        v = View.open(spark, path, "en")
        terms = store.stored(R.query_terms(queries, "q_id", "text", v.by_term()), "query-terms")
        fixed = R.feedback(v, terms, R.FeedbackSpec(most=50, fixed=True, fields=("detd",)))
        common = R.feedback(v, terms, R.FeedbackSpec(1, 10, kind="CTQ"))
        out = [fixed, common, R.feedback(v, terms, R.FeedbackSpec(unbounded=True)), R.inspect_feedback(v, common), v.doc_terms(), R.top_n(R.tfidf(v, terms), 10)]
        return [sorted(map(str, df.collect())) for df in out]

    assert rows(many) == rows(one)
    # An index that grew and was merged keeps its buckets, and has the same statistics whatever their number.
    for path in (many, one):
        segments.add_documents(frame(spark, {i: docs[i - 300] for i in range(300, 340)}), path)
    assert statistics(many, spark) == statistics(one, spark)
    for path in (many, one):
        segments.merge_segments(spark, path)
    assert statistics(many, spark) == statistics(one, spark)


def test_common_terms_feedback_leaves_pairs_in_their_buckets(spark, tmp_path):
    """F15 to F17: clauses are counted in the pass that scores, so no pair of query and document is shuffled by document."""
    path, rng = str(tmp_path / "idx"), random.Random(9)
    rare = lambda i: f" r{i % 100}" if i % 3 else ""  # noqa: E731 (in two documents at most: of low frequency)
    segments.write_index(frame(spark, {i: (" ".join(rng.choices(WORDS, k=12)) + rare(i), " ".join(rng.choices(WORDS[:9], k=6)) if i % 4 else None) for i in range(200)}), path, buckets=4)
    v = View.open(spark, path, "en")
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w1 r7 r8"), (3, "r4 none"), (4, "w3"), (5, "none")], "q_id long, text string")
    terms = store.stored(R.query_terms(queries, "q_id", "text", v.by_term()), "query-terms")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not re.search(r"hashpartitioning\((q_id#\d+L, doc_id|doc_id)", plan(R.feedback(v, terms, R.FeedbackSpec(1, 500, kind="CTQ"))))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for fields in (("claims", "detd"), ("detd",)):
        got = R.feedback(v, terms, R.FeedbackSpec(1, 500, kind="CTQ"), fields)
        want = R.ctq_matches(v, terms, fields).select("q_id", "doc_id")
        assert sorted(map(tuple, got.select("q_id", "doc_id").collect())) == sorted(map(tuple, want.collect()))
        assert got.select("q_id").distinct().count() > 1
    top = lambda q: [r.doc_id for r in R.feedback(v, terms, R.FeedbackSpec(1, 5, kind="CTQ")).where(F.col("q_id") == q).collect()]
    ranked = R.tfidf(v, terms).join(R.ctq_matches(v, terms, ("claims", "detd")), ["q_id", "doc_id"])
    for q in (1, 2):
        assert sorted(top(q)) == sorted(r.doc_id for r in R.top_n(ranked, 5).where(F.col("q_id") == q).collect())


def test_a_merge_deals_an_outgrown_index_anew(spark, tmp_path, monkeypatch):
    """F8: an index that is only added to has its buckets bounded by a merge; readers of the old commit still find their rows."""
    monkeypatch.setattr(segments, "BUCKET_BYTES", 500)
    rng, path, fresh = random.Random(8), str(tmp_path / "idx"), str(tmp_path / "fresh")
    docs = {i: (" ".join(rng.choices(WORDS, k=10)), " ".join(rng.choices(WORDS, k=10))) for i in range(320)}
    first = segments.write_index(frame(spark, {i: docs[i] for i in range(40)}), path).buckets
    segments.add_documents(frame(spark, {i: docs[i] for i in range(40, 320)}), path)
    segments.delete_documents(spark.createDataFrame([(7,), (300,)], "doc_id long"), path)
    before = View.open(spark, path, "en").postings
    segments.merge_segments(spark, path)
    commit = segments.latest(spark, path)
    assert commit.buckets > 5 * first
    at = F.pmod(F.hash("doc_id"), F.lit(commit.buckets))  # as Spark deals rows to buckets
    assert segments.read_index(spark, path).groupBy(at.alias("b")).count().agg(F.max("count")).first()[0] < 320 * 20 / first / 2
    segments.write_index(frame(spark, {i: d for i, d in docs.items() if i not in (7, 300)}), fresh)
    assert statistics(path, spark) == statistics(fresh, spark)
    assert before.select("doc_id", "term", "field").exceptAll(View.open(spark, fresh, "en").postings.select("doc_id", "term", "field")).isEmpty()
    # It goes on as before: small additions leave the buckets as they are, a merge below a size too, and nothing old stays.
    more = {i: docs[i - 400] for i in range(400, 403)}
    segments.add_documents(frame(spark, more), path)
    segments.add_documents(frame(spark, {403: docs[3]}), path)
    segments.merge_segments(spark, path, below=100)
    assert len(segments.latest(spark, path).segments) == 2
    segments.merge_segments(spark, path)
    assert segments.latest(spark, path).buckets == commit.buckets and segments.vacuum(spark, path)
    segments.write_index(frame(spark, {**{i: d for i, d in docs.items() if i not in (7, 300)}, **more, 403: docs[3]}), fresh)
    assert statistics(path, spark) == statistics(fresh, spark)
