"""The learned sentence model against a plain form, and what it must not cut."""

import math
import random
import re
from collections import Counter

import pytest

from termspire.operators import joins
from termspire.operators import sentences as S
from termspire.plans import tables as P

SHAPE = "doc_id long, lang string, claims string, detd string"


def bare(t):
    return re.sub(r"^[\W_]+|[\W_]+$", "", t)


def plain_model(texts):
    """Abbreviations and starters of one language's lower-cased tokens."""
    stop = lambda t: re.search(r"\.[)\]}\"'»”’]*$", t)
    mark = lambda t: re.search(r"[!?][)\]}\"'»”’]*$", t)
    log = lambda n, p: n * math.log(p) if n else 0.0
    c, e = Counter(), Counter()
    for toks in texts:
        for t in toks:
            if w := bare(t):
                c[w] += 1
                e[w] += bool(stop(t))
    n, p = sum(c.values()), sum(e.values()) / sum(c.values())
    formed = lambda w: re.fullmatch(r"[^\W\d_]|\d+", w)
    abbr = set()
    for w in c:
        letters = len(w.replace(".", ""))
        ratio = 2 * (log(e[w], 0.99) + log(c[w] - e[w], 0.01) - log(e[w], p) - log(c[w] - e[w], 1 - p))
        if e[w] and not formed(w) and ratio * math.exp(-letters) * (len(w) - letters + 1) * letters ** -(c[w] - e[w]) >= 0.3:
            abbr.add(w)
    follow = Counter()
    for toks in texts:
        for t, u in zip(toks, toks[1:], strict=False):
            if bare(u) and (mark(t) or (stop(t) and bare(t) not in abbr and not formed(bare(t)))):
                follow[bare(u)] += 1
    a, starters = sum(follow.values()), set()
    likely = lambda hit, of, q: log(hit, q) + log(of - hit, 1 - q)
    for w, k in follow.items():
        b = c[w]
        if n > a and k / a > b / n and 2 * (likely(k, a, k / a) + likely(b - k, n - a, (b - k) / (n - a)) - likely(k, a, b / n) - likely(b - k, n - a, b / n)) >= 30:
            starters.add(w)
    return abbr, starters, stop, mark


def plain_split(toks, model):
    abbr, starters, stop, mark = model
    out, now = [], []
    for i, t in enumerate(toks):
        now.append(t)
        w, u = bare(t), bare(toks[i + 1]) if i + 1 < len(toks) else ""
        initial, number = re.fullmatch(r"[^\W\d_]", w), re.fullmatch(r"\d+", w)
        if mark(t) or (stop(t) and not (initial or ((w in abbr or number) and u not in starters))):
            out.append(" ".join(now))
            now = []
    return out + ([" ".join(now)] if now else [])


def corpus(rng, n):
    words = ["claim", "method", "device", "shown", "valve", "pump", "flow", "part", "made", "used", "größe", "n.b"]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(1, 8)):
            body = [rng.choice(words) for _ in range(rng.randint(2, 7))]
            if rng.random() < 0.6:
                body += [rng.choice(("fig.", "e.g.", "no.", "cf.")), rng.choice(("3.", "7", "j.", "valve"))]
            if rng.random() < 0.2:
                body[0] = f"({body[0]})"
            text.append(rng.choice(("The", "This", "however")) + " " + " ".join(body) + rng.choice((".", ".", ".", "!", "?", '."', "...")))
        rows.append((i, "en" if i % 4 else "de", "  ".join(text) if i % 7 else None, ("\n".join(text[:2]) + " trailing words") if i % 5 else ""))
    return rows


@pytest.mark.parametrize("small", [joins.SMALL, 0])
def test_model_and_sentences(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    rows = corpus(random.Random(6), 90)
    docs = spark.createDataFrame(rows, SHAPE)
    model = S.learn(docs)
    fold = lambda t: re.sub(r"\s+", " ", t.lower()).strip().split(" ")
    want = []
    for lang in ("en", "de"):
        own = plain_model([fold(t) for _, la, *texts in rows for t in texts if la == lang and t])
        for got, plain in ((model.abbreviations, own[0]), (model.starters, own[1])):
            assert {r.word for r in got.where(f"lang = '{lang}'").collect()} == plain
        assert {"fig", "cf"} <= own[0] and "the" in own[1]
        for i, la, *texts in rows:
            for f, t in zip(("claims", "detd"), texts, strict=True):
                if la == lang and t:
                    want += [(lang, i, f, k, x) for k, x in enumerate(plain_split(fold(t), own))]
    got = sorted(map(tuple, S.split(docs, model).collect()))
    assert got == sorted(want)
    assert not any(re.search(r"(^| )(fig|cf|e\.g)\.$", x[4]) for x in got if x[0] == "en")


def test_no_cut_after_initials_and_numbers(spark):
    rng, ends = random.Random(1), ["made", "used", "sold", "kept", "moved", "known", "heated", "closed"]
    part = "The valve of j. smith is no. 3. part of it, see fig. 7. The pump is {}. The flow {} and {} well is {}! "
    rows = [(i, "en", "".join(part.format(*rng.sample(ends, 4)) for _ in range(6)), None) for i in range(40)]
    docs = spark.createDataFrame(rows, SHAPE)
    found = [r.sentence for r in S.split(docs, S.learn(docs)).where("doc_id = 0").orderBy("i").collect()]
    assert found[::3] == ["the valve of j. smith is no. 3. part of it, see fig. 7."] * 6 and all(x.startswith("the pump is") for x in found[1::3]) and len(found) == 18


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SHAPE)
    model = S.learn(none)
    assert model.abbreviations.isEmpty() and model.starters.isEmpty() and S.split(none, model).isEmpty()
    docs = spark.createDataFrame([(1, "en", "one. two", ""), (2, "fr", None, " . ! "), (3, "en", "?", "x")], SHAPE)
    got = sorted((r.doc_id, r.field, r.i, r.sentence) for r in S.split(docs, S.learn(docs)).collect())
    assert got == [(1, "claims", 0, "one."), (1, "claims", 1, "two"), (2, "detd", 0, "."), (2, "detd", 1, "!"), (3, "claims", 0, "?"), (3, "detd", 0, "x")]


def test_texts_do_not_go_along_with_each_token(spark):
    """One sentence of 3,000 words: a copy of it for each word would be 90 MB to shuffle."""
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(3000))
    docs = spark.createDataFrame([(1, "en", text, None)], "doc_id long, lang string, claims string, detd string")
    terms = spark.createDataFrame([(text[:4],), ("absent",)], "term string")
    written = lambda: sum(e.totalShuffleWrite() for e in (found.apply(i) for found in [spark.sparkContext._jsc.sc().statusStore().executorList(False)] for i in range(found.size())))
    before = written()
    got = P.sentences(docs, terms).collect()
    assert [tuple(r) for r in got] == [("claims", text[:4], 1, text)]
    assert written() - before < 5e6


def test_common_terms_find_their_documents_early(spark, monkeypatch):
    """Terms with enough documents among the first ones of the order give what a look at all documents gives."""
    rng = random.Random(9)
    docs = [(i, "en", f"word{i % 7} common{'s' * (i % 3)} here. x{rng.randint(0, 40)} there", "common. rare" if i % 29 == 0 else None) for i in range(400)]
    docs = spark.createDataFrame(docs, "doc_id long, lang string, claims string, detd string")
    terms = spark.createDataFrame([(w,) for w in ("common", "word3", "rare", "x7", "o", "absent")], "term string")
    run = lambda: sorted(map(str, P.sentences(docs, terms, most=2).collect()))
    monkeypatch.setattr(P, "EARLY", 1000)
    whole = run()
    for early in (1, 4):
        monkeypatch.setattr(P, "EARLY", early)
        assert run() == whole
