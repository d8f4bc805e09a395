"""The three-document corpus with hand-computed values, and the parts around it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from termspire.config import Config
from termspire.functions import analysis, ipc, scalar
from termspire.functions import termfilters as tf
from termspire.operators import retrieval as R
from termspire.operators import scoring as S
from termspire.operators.view import View
from termspire.plans import tables as P
from termspire.sources import corpus, segments, sinks


@pytest.fixture(scope="module")
def view(spark):
    rows = []
    for i in range(3):
        for f, w in (("f1", "first"), ("f2", "second"), ("f3", "third")):
            k = f[1]
            rows.append((i, f, f"{w} field value document{i + 1} field{k} document{i + 1}field{k}"))
    docs = spark.createDataFrame(rows, "doc_id long, field string, text string")
    post = docs.select("doc_id", "field", F.explode(analysis.whitespace_tokens(F.col("text"))).alias("term"))
    return View(post.groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf")).cache())


def q(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q_id long, text string")


def terms(spark, view, *texts):
    return R.query_terms(q(spark, *texts), "q_id", "text", view.postings.select("term").distinct())


def test_statistics(view):
    assert tuple(view.collection().first()) == (54, 3, 20)
    stats = {r.term: r for r in view.term_stats().collect()}
    assert (stats["value"].tf, stats["value"].df, stats["document1"].tf, stats["document1"].df) == (9, 3, 3, 1)
    model = {r.term: r.mtf for r in view.doc_model().where("doc_id = 0").collect()}
    assert model["document1"] == 3 and len(model) == 12
    assert view.doc_lengths().where("doc_id = 0").first().dl == 18
    assert view.by_field().count() == 4


def test_views(view):
    assert view.fields(["f1"]).collection().first().ttf == 18
    assert view.fields(["f1"], negate=True).collection().first().ttf == 36
    assert view.terms(lambda t: t == "value").collection().first().ttf == 9
    assert view.documents(view.doc_ids().where("doc_id > 0")).collection().first().n_docs == 2
    assert view.having_field("f9").doc_ids().count() == 0
    with pytest.raises(ValueError):
        view.check_fields(["f9"])
    with pytest.raises(ValueError):
        view.check_fields([])
    for threshold, gone in ((0.99, {"value"}), (0.34, {"value"}), (1.0, set())):
        kept = {r.term for r in tf.common_terms(view.postings, threshold).collect()}
        assert "document1" in kept and not (gone & kept)


def test_scs(spark, view):
    got = [r.score for r in S.scs(view, q(spark, "document1 value", "document1 value nope", "value value document1")).orderBy("q_id").collect()]
    assert got == pytest.approx([0.20751874963942185, 0.20751874963942185, 0.02506249879807293], abs=1e-12)


@pytest.mark.parametrize(("text", "docs", "value"), [("document1 value", [0, 1, 2], 0.05795631208482606), ("document1 value", [0], 0.07691488455247496), ("value", [0, 1, 2], 0.0)])
def test_dcs(spark, view, text, docs, value):
    fb = spark.createDataFrame([(0, d) for d in docs], "q_id long, doc_id long")
    models = S.dcs_models(view, terms(spark, view, text), fb)
    assert models.groupBy("q_id").agg(S.kl(F.col("q_model"), F.col("c_model")).alias("s")).first().s == pytest.approx(value, abs=1e-12)


@pytest.mark.parametrize(
    ("text", "docs", "high", "value"),
    [("document1 value", [0, 1, 2], 0.5, 2.024317186310616e-07), ("document1 value", [0, 1, 2], 1.0, 6.747723959708241e-08), ("document1", [0], 1.0, 0.0001297229764294647)],
)
def test_ics(spark, view, text, docs, high, value):
    fb = spark.createDataFrame([(0, d) for d in docs], "q_id long, doc_id long")
    models = S.ics_models(view, terms(spark, view, text), fb, S.IcsConfig(least=1, band_high=high))
    assert models.groupBy("q_id").agg(S.kl(F.col("q_model"), F.col("c_model")).alias("s")).first().s == pytest.approx(value, abs=1e-9)


def test_results_and_reasons(spark, view):
    rows = {r.q_id: r for r in S.ics(view, q(spark, "document1 value", "nope"), config=S.IcsConfig(least=1)).collect()}
    assert rows[0].empty_reason == S.REASONS["band"] and rows[1].empty_reason == S.REASONS["terms"]
    few = S.ics(view, q(spark, "document1"), config=S.IcsConfig(least=2)).first()
    assert few.empty_reason == S.REASONS["few"] and few.fb_doc_count == 1
    with pytest.raises(ValueError):
        S.ics(view, q(spark, "value"))  # ten feedback documents of three
    one = S.dcs(view, q(spark, "document1 value"), fields=("f1", "f2", "f3")).first()
    assert one.fb_doc_count == 3 and one.score == pytest.approx(0.05795631208482606, abs=1e-12)
    run = S.scorer("dcs", view, fields=("f1", "f2", "f3"))
    assert run(q(spark, "document1 value")).first().score == pytest.approx(0.05795631208482606, abs=1e-12)
    assert S.scorer("scs", view, fields=["f1"])(q(spark, "value value document1")).first().score == pytest.approx(0.02506249879807293, abs=1e-12)
    for bad in (("nope", view), ("dcs", None), ("dcs", view, S.IcsConfig()), ("scs", view, S.DcsConfig()), ("dcs", view, None, ("f9",))):
        with pytest.raises(ValueError):
            S.scorer(*bad)


def test_bm25(spark, view):
    docs = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "q_id long, doc_id long")
    got = [r.score for r in S.bm25plus(view, terms(spark, view, "document1 value"), docs).orderBy("doc_id").collect()]
    assert got == pytest.approx([3.308597710285272, 2.22488972589494, 2.22488972589494], abs=1e-12)
    assert S.bm25_sentinel(q(spark, "nope"), terms(spark, view, "nope")).first()[1:] == (-1, -1.0)


def test_kl(spark):
    rows = spark.createDataFrame([(1.0, 3.0), (1.0, 0.0), (0.0, 5.0), (1.0, 1.0)], "q_model double, c_model double")
    want = sum(0.5 * math.log2(0.5 / (c / 4)) for c in (3, 1))
    assert rows.agg(S.kl(F.col("q_model"), F.col("c_model")).alias("s")).first().s == pytest.approx(want)
    with pytest.raises(ValueError):
        S.check_tuples(rows.unionByName(spark.createDataFrame([(-1.0, 1.0)], rows.schema)))


def test_kl_decimal(spark):
    rng = random.Random(4)
    tuples = [(g, rng.random(), rng.random() * 10 ** -rng.randint(0, 5)) for g in range(4) for _ in range(30)] + [(0, 1.0, 0.0), (1, 0.0, 1.0)]
    rows = spark.createDataFrame(tuples, "q_id long, q_model double, c_model double")
    want = {r.q_id: r.s for r in rows.groupBy("q_id").agg(S.kl(F.col("q_model"), F.col("c_model")).alias("s")).collect()}
    got = {r.q_id: r.score for r in S.kl_decimal(rows).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-4) for k in want)
    assert all(float(f"{v:.7g}") == pytest.approx(v, rel=1e-12) for v in got.values())


def test_feedback(spark, view):
    t = terms(spark, view, "document1 value")
    whole = R.feedback(view, t, R.FeedbackSpec(unbounded=True))
    assert {(r.doc_id, r.level) for r in whole.collect()} == {(0, 0), (1, 1), (2, 1)}
    only = view.documents(view.doc_ids().where("doc_id < 2")).postings.where("doc_id = 1 or field <> 'f3'")
    filled = R.feedback(View(only), t, R.FeedbackSpec(most=3, fixed=True, fields=("f3",)))
    assert {r.doc_id for r in filled.collect()} == {0, 1} and R.feedback(view, t, R.FeedbackSpec(1, 2, kind="ctq"), ("f1",)).count() == 1
    assert R.top_n(R.tfidf(view, t), None).count() == 3 and R.top_n(R.tfidf(view, t), 2).count() == 2
    assert {r.doc_id: r.terms for r in R.inspect_feedback(view.fields(["f1"]), whole.where("level = 0")).collect()} == {0: "document1 document1field1 field field1 first value"}
    assert R.inspect_vocabulary(view, whole.where("level = 0")).count() == 12
    arrays = spark.createDataFrame([(0, ["document1", "value value"])], "q_id long, text array<string>")
    assert {(r.term, r.qtf) for r in R.query_terms(arrays, "q_id", "text").collect()} == {("document1", 1), ("value", 2)}
    for bad in ({"kind": "XYZ"}, {"fixed": True, "unbounded": True}):
        with pytest.raises(ValueError):
            R.FeedbackSpec(**bad)
    assert {r.doc_id for r in R.feedback(view, t, R.FeedbackSpec(1, 5)).collect()} == {0}
    assert {r.doc_id for r in R.feedback(view, t, R.FeedbackSpec(2, 2)).collect()} == {0, 2}
    assert R.feedback(view, t, R.FeedbackSpec(most=3, fixed=True)).count() == 3
    with pytest.raises(ValueError):
        R.FeedbackSpec(5, 2)


def test_codes(spark):
    rows = spark.createDataFrame([("A61K0031-4166",), ("A61K0000-0000",), ("A61K",), ("A00B",), ("X99",), (None,)], "code string")
    got = rows.select(ipc.parse(F.col("code")).alias("p"), ipc.n_set(ipc.parse(F.col("code"), zero_pad=True)).alias("n")).collect()
    assert [r.p.valid for r in got] == [True, False, True, False, True, False]
    assert [r.n for r in got][:3] == [5, 3, 3] and got[4].n == 0
    assert got[0].p[:5] == ("A", 61, "K", 31, 4166)
    assert ipc.Code("a", 61, "k", 31, 4166).regex() == r"[Aa]0*61[Kk]0*31\-0*4166"
    assert ipc.Code("a", 61).regex() == "[Aa]0*61.*"
    with pytest.raises(ValueError):
        ipc.Code("Z")
    docs = spark.createDataFrame([(1, ["A61K", "A01B"]), (2, ["A61K", "B01B"]), (3, ["A00B"]), (4, [])], "doc_id long, ipc array<string>")
    keep = lambda c: [r.doc_id for r in docs.where(c).orderBy("doc_id").collect()]
    codes = F.col("ipc")
    assert keep(ipc.sloppy(codes, ipc.Code("A", 61))) == [1]
    assert keep(ipc.sloppy(codes, ipc.Code("A", 61), exact=True)) == []
    assert keep(ipc.sloppy(codes, ipc.Code("B"), single=True)) == [2]
    assert keep(ipc.greedy(codes, ipc.Code("A"))) == [1, 3]
    assert keep(ipc.max_sections(codes, 1)) == [1, 3, 4]
    assert keep(ipc.standard_restriction(codes, ipc.Code("A", 61))) == [1]
    assert {r.code: r.n for r in P.ipc_distribution(docs).collect()}["A61K"] == 2
    assert keep(ipc.sloppy(codes, ipc.Code("A", 61), fields=("class",))) == [] and keep(ipc.sloppy(codes, ipc.Code("A", 61, "K"), fields=("section",))) == [1]
    with pytest.raises(ValueError):
        ipc.sloppy(codes, ipc.Code("A"), fields=("nope",))
    assert keep(ipc.all_of(ipc.max_sections(codes, 1), F.size(codes) > 0)) == [1, 3] and keep(ipc.all_of(F.lit(None).cast("boolean"))) == []
    pair = spark.createDataFrame([("A61K0031-4166", "a61k31-4166"), ("A61K", "A61B"), ("A61K", "A61")], "a string, b string")
    same = pair.select(*(ipc.same_record(ipc.parse(F.col("a")), ipc.parse(F.col("b")), f).alias(n) for n, f in (("all", ipc.PARTS), ("two", ipc.PARTS[:2])))).collect()
    assert [tuple(r) for r in same] == [(True, True), (False, True), (False, True)]
    assert [r.code for r in P.ipc_ordered(docs).where("section = 'A'").orderBy("place").collect()] == ["A01B", "A61K"]
    assert tuple(P.ipc_list_counts(P.ipc_list(docs, ipc.Code("B"))).first()) == (1, 3)
    numbers = spark.createDataFrame([("10", 1), ("9", 2)], "k string, n long")
    assert [r.k for r in P.by_key(numbers, "k").collect()] == ["9", "10"]


def test_analyzers(spark):
    assert [analysis.porter(w) for w in "caresses ponies running hopping relational triplicate adjustable sky".split()] == ["caress", "poni", "run", "hop", "relat", "triplic", "adjust", "sky"]
    assert analysis.german("häusern") == "haus" and analysis.german("straße") == "strass"
    assert analysis.french("chevaux") == "cheval" and analysis.language("EN") == "en" and analysis.language("xx") is None
    for one, many in (("administration", "administrations"), ("nationalité", "nationalités"), ("active", "actives"), ("cheval", "chevaux"), ("bateau", "bateaux"), ("heureuse", "heureuses")):
        assert analysis.french(one) == analysis.french(many), one
    pairs = [("haus", "häuser"), ("kind", "kindes"), ("hund", "hunde"), ("bild", "bilder"), ("frau", "frauen"), ("gut", "gutes"), ("schön", "schönen")]
    assert all(analysis.german(a) == analysis.german(b) for a, b in pairs)
    # Words and stems worked from the rules of the published description of 1980.
    english = {
        "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
        "filing": "file", "happy": "happi", "conditional": "condit", "rational": "ration", "digitizer": "digit", "differently": "differ", "operator": "oper",
        "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formality": "formal", "sensibility": "sensibl", "formative": "form",
        "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
        "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
        "activate": "activ", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    }
    assert {w: analysis.english(w) for w in english} == english and analysis.english("dog's") == "dog"
    row = spark.range(1).select(
        analysis.keyword(F.lit("A61K 1-2")).alias("k"), analysis.language_tokens("fr", ["le"])(F.lit("Le L'administration nationale")).alias("f"),
        analysis.language_tokens("en")(F.lit(None).cast("string")).alias("n"),
    ).first()
    assert row.k == ["A61K 1-2"] and row.f == [analysis.french("administration"), analysis.french("nationale")] and row.n is None
    words = spark.createDataFrame([("One two. Two!",), (None,)], "t string")
    assert {(r.word, r.n) for r in analysis.word_frequency(words, "t").collect()} == {("one", 1), ("two", 2)}
    assert spark.range(1).select(analysis.sentence_list(F.lit("A b.  C?\nD e.f! ")).alias("s")).first().s == ["a b.", "c?", "d e.f!"]
    text = "foo bar baz bam " + " ".join(f"{p}'bim" for p in analysis.ELISIONS)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.term for r in analysis.analyze(docs, "text", "fr", ["foo", "bar"]).orderBy("pos").collect()]
    assert got == ["baz", "bam", *["bim"] * 13]


def test_filters_and_scalars(spark):
    row = lambda **c: spark.range(1).select(*(v.alias(k) for k, v in c.items())).first().asDict()
    t = F.lit
    got = row(a=tf.simple_filter(t("house")), b=tf.simple_filter(t("12kg")), c=tf.simple_filter(t("aaab")), d=tf.simple_filter(t("αβγabc")), e=tf.not_number_with_unit(t("100"), 0.2, True))
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": True}
    assert row(x=scalar.rescale(t(5.0), t(0.0), t(10.0)))["x"] == pytest.approx(0.5)
    more = row(a=tf.accept_all(t("x")), l=scalar.all_lower(t("ab")), b=scalar.log_n(2.0, t(8.0)), r=scalar.seeded(t("k"), 3), r2=scalar.seeded(t("k"), 3), at=scalar.timestamp_text(F.timestamp_seconds(t(0))))
    assert more["a"] and more["l"] and more["b"] == pytest.approx(3) and 0 <= more["r"] == more["r2"] < 1 and more["at"] == "1970-01-01 00:00:00"
    assert row(u=scalar.all_upper(t("AB")), n=scalar.numeric(t("1e-5")), s=scalar.stripped_empty(t(" \n"))) == {"u": True, "n": True, "s": True}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"PN":"P1","CLMEN":["a\\tb","c"],"IPC":["A61K B01B","A61K"]}\n{"PN":"P2","DETD":["x"],"DETDL":"DE"}\n{"PN":null,"CLMEN":["z"]}\n')
    rows = corpus.read_json_documents(spark, str(tmp_path / "d.json"), "en").collect()
    assert [(r.pat_id, r.claims, r.ipc) for r in rows] == [("P1", "a b c", ["A61K", "B01B"])]
    (tmp_path / "s.txt").write_text("| c\nthe | x\nof\n")
    assert {r.term for r in corpus.read_stopwords(spark, str(tmp_path / "s.txt"), "snowball").collect()} == {"the", "of"}
    assert corpus.stopword_path("/x/", "stop", "EN") == "/x/stop_en.txt"
    docs = spark.createDataFrame([(1, "en", "a b a", None), (2, "de", "Häuser", "b")], "doc_id long, lang string, claims string, detd string")
    with pytest.raises(FileNotFoundError):
        segments.read_index(spark, str(tmp_path / "idx"))
    segments.write_index(docs, str(tmp_path / "idx"))
    back = {r.term: (r.tf, r.positions) for r in segments.read_index(spark, str(tmp_path / "idx")).where("lang = 'en'").collect()}
    assert back == {"a": (2, [0, 2]), "b": (1, [1])}
    opened = View.open(spark, str(tmp_path / "idx"), "en")
    assert tuple(opened.collection().first()) == (3, 1, 2) and opened.doc_model().count() == 2 and opened.stored().by_field().count() == 2
    segments.write_index(docs, str(tmp_path / "idx2"), by_language={"de": analysis.language_tokens("de", ["b"])})
    assert [r.term for r in segments.read_index(spark, str(tmp_path / "idx2")).collect()] == ["haus"]
    new = spark.createDataFrame([("A", "claims", 3)], "section string, field string, count long")
    root = str(tmp_path / "db")
    assert not sinks.exists(spark, root, "ipc_docfieldcount")
    assert sinks.insert(new, root, "ipc_docfieldcount").count() == 1
    with pytest.raises(ValueError):
        sinks.insert(new, root, "ipc_docfieldcount")
    assert sinks.insert(new, root, "ipc_docfieldcount", ignore=True).count() == 1
    assert sinks.rows(spark, root, "ipc_docfieldcount") == 1 and sinks.rows(spark, root, "terms") == 0
    assert sinks.has_column(spark, root, "ipc_docfieldcount", "field") and not sinks.has_column(spark, root, "ipc_docfieldcount", "x")
    twice = spark.createDataFrame([("B", "claims", 3), ("B", "claims", 4)], "section string, field string, count long")
    with pytest.raises(ValueError):
        sinks.insert(twice, root, "ipc_docfieldcount")
    assert sinks.insert(twice, root, "ipc_docfieldcount", ignore=True).count() == 2
    assert sinks.put_value(spark, root, "k", 1.5).first().value == "1.5" and sinks.log_stage(spark, root, "terms", "cmd").first().cmd == "cmd"
    one = sinks.register_run(spark, root, S.IcsConfig(), "claims", None)
    assert one == sinks.register_run(spark, root, S.IcsConfig(), "claims", None) != sinks.register_run(spark, root, S.IcsConfig(most=9), "claims", None)
    assert sinks.rows(spark, root, "ics_conf") == 2
    sinks.write_csv(new, f"{root}/out.csv")
    assert spark.read.option("header", True).csv(f"{root}/out.csv").first().asDict() == {"section": "A", "field": "claims", "count": "3"}
    assert sinks.contains(spark.read.parquet(f"{root}/ipc_docfieldcount"), section="A")
    c = Config(str(tmp_path / "p.properties"))
    assert c.get("n", 5) == 5
    c.save()
    assert Config(str(tmp_path / "p.properties")).get("n", 1) == 5


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "en", "a b", "c")], "doc_id long, lang string, claims string, detd string")
    docs.write.parquet(str(tmp_path / "in"))
    from termspire.streaming.postings import stream_postings

    stream_postings(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "scs_benchmark" in entry.queries()


def test_commands(spark, tmp_path):
    from termspire import cli

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: ". ".join(" ".join(rng.choice(words[: rng.randint(2, 40)]) for _ in range(8)) for _ in range(n)) + "."
    rows = [(i, text(1) + "\n" + text(3), ("en", "de", "es")[i % 3], "s", 1) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "src" / "documents.parquet"))
    (tmp_path / "stop_en.txt").write_text("w0 | common\n")
    (tmp_path / "stop_de.txt").write_text("w1\n")
    (tmp_path / "stop_fr.txt").write_text("le\n")
    index, db = str(tmp_path / "idx"), str(tmp_path / "db")
    go = lambda *args: cli.run(spark, [args[0], "--index", index, "--db", db, "--stop-dir", str(tmp_path), "--analyzer", "bare", *args[1:]])
    assert go("index", "--source", str(tmp_path / "src")).where("field is null").first().docs == 20
    assert segments.read_index(spark, index).where("lang = 'en' and term = 'w0'").isEmpty() and not segments.read_index(spark, index).where("lang = 'de' and term = 'w0'").isEmpty()
    assert go("dump-terms", "--threshold", "0.01").where("term = 'w0'").isEmpty()
    n = go("sample", "--fields", "claims", "--size", "4", "--picks", "1", "2").count()
    assert n > 2 and go("sentences", "--fields", "claims").count() == n
    assert go("sentences", "--fields", "claims", "--learned").count() == n
    assert go("score", "--what", "sentences").where("impl = 'SCS' and score is not null").count() == n
    assert go("score-ics", "--least", "1", "--band-high", "1").where("icsconf_ref is not null").count() == n
    assert go("score", "--impl", "dcs").where("impl = 'DCS'").count() == n
    assert go("score", "--impl", "all", "--fields", "claims").groupBy("impl").count().count() == 3
    assert go("score-bm25", "--amount", "3").count() >= n
    assert go("analyze-ics", "--query", "w2 w3", "--least", "1", "--band-high", "1").count() > 10
    assert go("ipc-stats").count() >= 1 and go("ipcs", "--ipc", "A").where("matched").count() >= 0 and go("idx-stats").count() == 3
    assert go("common-terms", "--threshold", "0.3").count() > 0 and go("term-filter").count() > 0
    assert go("feedback", "--query", "w2 w3", "--most", "3").select("doc_id").distinct().count() <= 3
    with pytest.raises(ValueError):
        go("score", "--ipc", "A", "--what", "terms")  # each document has codes of two sections, so the view is empty
    log = {r.table_name for r in sinks.read(spark, db, "_qc_meta").collect()}
    assert {"terms", "scoring_terms", "scoring_sentences", "scoring_results"} <= log and {r.key for r in sinks.read(spark, db, "_keyval").collect()} == {"query", "score"}
    for bad in (["score", "--index", index], ["nope"], ["index", "--index", index, "--lang", "xx"], ["feedback", "--index", index]):
        with pytest.raises(SystemExit):
            cli.parse(bad)
    with pytest.raises(ValueError):
        P.term_sample(spark.createDataFrame([], "term string, rel_df double"))
    terms_ = spark.createDataFrame([("a",), ("b",)], "term string")
    with pytest.raises(ValueError):
        P.check_sentences(spark.createDataFrame([("a",)], "term string"), terms_)


def test_index_follows_its_documents(spark, tmp_path):
    from termspire.plans import queries

    for n in (1, 2):
        rows = [(i, "a b", "en", "s", 1) for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert queries.view(spark, str(tmp_path)).collection().first().n_docs == n
    assert queries.index_of(spark, str(tmp_path)) == queries.index_of(spark, str(tmp_path))
