"""Spelling variants, prefix tries and top-k search against plain forms."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termspire.llm import maxscore, prefix_trie, spelling


def plain_one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, times=10):
    near = {w: [x for x in words if plain_one_edit(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def test_one_edit():
    rng = random.Random(3)
    some = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    assert all(spelling.one_edit(a, b) == plain_one_edit(a, b) for a in some for b in some)


@pytest.mark.parametrize(("shared", "shard"), [(1, 40), (3, 10_000), (64, 500)])
def test_near_words(spark, shared, shard):
    """Common halves are cut again until few patterns share them; pairs are the same, each once."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(2, 8))) for _ in range(250)}
    words |= {"interna" + "".join(rng.choice("aé") for _ in range(rng.randint(0, 5))) for _ in range(60)}
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = sorted((r.word, r.near) for r in spelling.near_words(rows, shared, shard).collect())
    assert got == sorted((a, b) for a in words for b in words if plain_one_edit(a, b))


def test_variants_chain(spark):
    words = {"abcdefgh": 1, "abcdefghi": 10, "abcdefghij": 100, "abcdefghijk": 1000, "bcdefgh": 9, "zzzzzzz": 3, "zzzzzzy": 30, "zzzzzzx": 30, "lonely__": 5}
    out = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    got = sorted((tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in out.collect()), key=str)
    assert got == plain_variants(words)
    assert ("abcdefgh", 1, 2, "abcdefghi", 10, "abcdefghijk") in got
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_spelling_query(spark):
    rng = random.Random(9)
    base = ["Überprüfung", "réalisation", "traitement", "paramètre", "operation", "collection", "short", "naïveté", "ÀÉÎÕÜß×÷ÿ"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice((" ", ", ", "9", "\n")) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(None, "operation collection"), (7, rows[7][1]), (7, rows[7][1]), (500, None), (501, ""), (502, "traitement " * 5000), (2**60 + 1, "collection"), (-(2**63), "paramètre")]
    words = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, word string, key string, n int")
    out = spelling.group_spellings(docs)
    got = sorted((tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in out.collect()), key=str)
    assert got == plain_variants(words) and any(x[3] for x in got)
    assert spelling.group_spellings(docs.limit(0)).count() == 0


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5)) if abs(c) < 2**50 else c - (abs(c) % 5) * (1 if c > 0 else -1)
        built[c] = tuple(x[2:] for x in sorted(turns.get(base, []))[:h] + sorted(turns[c])[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, own in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(own) - 1) * (len(s[-1][1]) if s else 0)
    return sorted(
        (
            (min(own), len(s), min(members[s[:-1]]) if s else None, len(own), kids[s], leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(c for c in own if built[c] == s))).encode()).hexdigest())
            for s, own in members.items()
        ),
        key=str,
    )


def conversations(rng):
    rows = []
    for c in [*range(-12, 90), 2**60 + 1, 2**60 + 3, -(2**63)]:
        if c % 10 == 4:
            continue
        for t in range(rng.choice((1, 2, 3, 5, 12))):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(("user", "assistant", None)), rng.choice(("hi", "é" * 3, "", None, "longer text"))))
    for c in range(100, 160):  # copies of a long one, and what follows them
        rows += [(c, t, "user", f"turn {t}") for t in range(30)] + [(c, 30, "user", str(c % 3))]
    rows += [(200, 1, "b", "x"), (200, 1, "a", "z"), (200, 1, "a", "y"), (200, 1, "a", "y"), (200, None, "c", "")]
    return rows + [(None, 1, "user", "of nobody")]


@pytest.mark.parametrize("local", [1, 40, 20_000])
def test_prefix_trie(spark, monkeypatch, local):
    monkeypatch.setattr(prefix_trie, "LOCAL", local)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = conversations(random.Random(local))
    rng = random.Random(1)
    rng.shuffle(rows)
    turns = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, key string, c int, own int")
    out = prefix_trie.build(turns)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == plain_trie(rows)
    assert prefix_trie.build(turns.limit(0)).count() == 0


def plain_search(rows, k=10, every=100):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in rows:
        if i is not None and i % every == 0 and v is not None and all(x is not None and math.isfinite(x) for x in v):
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        w = [math.floor(1024 * x) for x in v]
        scored = [(sum(x * y for x, y in zip(w, u, strict=False)), i) for i, u in own if i != q]
        scored = sorted(((min(max(s, -(2**63)), 2**63 - 1), i) for s, i in scored), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [60, 1 << 19])
def test_search(spark, monkeypatch, shard):
    monkeypatch.setattr(maxscore, "SHARD_VALUES", shard)
    monkeypatch.setattr(maxscore, "PILOT", 30)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(1100, rows[5][1])]
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")]), (2300, [float("inf")]), (2400, []), (2500, [0.0] * 6), (2600, [1.0]), (2700, [2.0] * 9)]
    rows += [(None, [3.0] * 6), (None, [-3.0] * 6), (300, rows[300][1]), (300, rows[7][1]), (2**60 + 100 - 2**60 % 100, rows[9][1]), (-100, rows[10][1])]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, id int, cell int, score int")
    out = maxscore.search(docs, docs.where(F.col("vec_id") % 100 == 0))
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = out.collect()
    # A null id has no order of its own; it comes after the others of its score.
    assert sorted(map(tuple, got), key=str) == plain_search(rows)
    few = docs.where("vec_id in (100, 101, 200)")
    assert few.count() == maxscore.search(few, few.where("vec_id = 100")).count() + 1
    assert maxscore.search(docs.limit(0), docs).count() == 0 == maxscore.search(docs, docs.limit(0)).count()


def test_huge_components(spark):
    rows = [(0, [1e300, -1.0]), (1, [1e300, 5.0]), (2, [-1e300, 5.0]), (3, [2.0**51, 2.0**50]), (4, [2.0**51, 2.0**50 + 1.0]), (5, [0.5, 0.25]), (100, [2.0**51, 3.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = maxscore.search(docs, docs.where("vec_id % 100 = 0")).collect()
    assert {(r.query_id, r.vec_id): r.score for r in got} == {(q, i): s for q, _, i, s in plain_search(rows)}


def test_blocks_leave_out_what_cannot_compete():
    """Vectors in no essential posting aren't scored, and the rest is what a full scan finds."""
    rng = np.random.default_rng(8)
    rows = np.floor(1024 * rng.standard_normal((3000, 16)) * (rng.random((3000, 16)) < 0.2))
    shard = maxscore.Shard(list(range(3000)), list(rows))
    for q in rows[:20]:
        want = sorted(((-int(s), i) for i, s in enumerate((rows @ q).tolist())))[:10]
        assert [(i, s) for i, s in shard.top(None, q, 10, None)] == [(i, -s) for s, i in want]
        block = shard.blocks(False)[0]
        bounds = block.bounds(q)
        least = 0.9 * -want[9][0]
        at, score = block.search(q, bounds, least)
        assert set(at.tolist()) == set(np.flatnonzero(block.rows @ q >= least).tolist()) and (block.rows[at] @ q == score).all()
