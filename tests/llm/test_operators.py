"""Each operator on small tables against a plain form, with the awkward rows that its docstring speaks of."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termspire.llm import embedding_dedup, flac, line_dedup, media, minhash, mixing, packing, pii, quality, token_counts, tokenizer, warc
from termspire.llm.components import components

DOCS = "doc_id long, text string, source string, id string, h long"
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def frame(spark, rows):
    """Rows of (doc_id, text[, source]) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1) for r in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randint(0, 40)) for _ in range(n))


def odd(rng):
    long = prose(rng, 6000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one"), (5, "one"), (None, "no id here"), (6, "x" * 20000)]


def root(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_hubs(spark, monkeypatch):
    from termspire.llm import components as module
    from termspire.operators import joins

    monkeypatch.setattr(joins, "LIGHT", 3)
    monkeypatch.setattr(module, "LIGHT", 3)
    edges = [(7, i) for i in range(100, 150)] + [(i, i + 1) for i in range(149, 160)] + [(5, 3), (500, 400), (500, 401), (500, 402), (500, 403)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root(edges, {n for e in edges for n in e})


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = root(edges, {n for e in edges for n in e})
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    rng = random.Random(2)
    lines = [prose(rng, n) for n in (60, 55, 20, 20, 20, 5, 3, 30, 10)]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.9 else "" for _ in range(rng.randint(1, 9)))) for i in range(10, 50)]
    rows += odd(rng) + [(99, rows[3][1]), (98, f"{lines[0]}\n{lines[0]}")]
    first, want = {}, {}
    for key, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        own = text.split("\n")
        real = [(i, x.strip(" \t\r\x0b\x0c"), len(re.findall(mixing.WORDS, x))) for i, x in enumerate(own)]
        real = [x for x in real if x[2]]
        gone = set()
        for a in range(len(real)):
            for b in range(a, len(real)):
                if sum(x[2] for x in real[a : b + 1]) >= 50:
                    place = first.setdefault(tuple(x[1] for x in real[a : b + 1]), (key, real[a][0]))
                    if place != (key, real[a][0]):
                        gone |= set(range(real[a][0], real[b][0] + 1))
        want[key, text] = "\n".join(x for i, x in enumerate(own) if i not in gone)
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "id", "h", "n_lines", "n_removed"]
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert got == sorted((str(k), str(want.get((k, t), t))) for k, t in rows)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_repeated_rows_are_one(spark):
    """However often a row repeats, lines are made of it once, and all of its copies change alike."""
    rng = random.Random(12)
    text = "\n".join(prose(rng, 30) for _ in range(4))
    rows = [(1, text)] * 3000 + [(None, text)] * 2000 + [(2, text + "\nmore")] + [(3, "other")] * 5
    docs = frame(spark, rows).repartition(7)
    keyed = docs.selectExpr("doc_id as id", "xxhash64(text) as th", "text")
    assert line_dedup.once(keyed).count() == 4 and line_dedup.lines_of(keyed).count() == 14
    got = {(r.doc_id, r.text): r.n for r in line_dedup.dedup_lines(docs).groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, text): 3000, (None, ""): 2000, (2, "more"): 1, (3, "other"): 5}


def plain_passages(rows):
    """(text, words, removed words) of each (id, text), by a set of all runs of 50 words that were seen."""
    seen, want = set(), {}
    for key, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        own = [(m.start(), m.end()) for m in re.finditer(mixing.WORDS, text)]
        words, gone = [text[a:b] for a, b in own], set()
        for a in range(len(words) - 49):
            run = tuple(words[a : a + 50])
            if run in seen:
                gone |= set(range(a, a + 50))
            seen.add(run)
        fresh, last = "", None
        for i, (a, b) in enumerate(own):
            if i not in gone:
                white = text[(own[last][1] if last is not None else 0) : a]
                if i and i - 1 in gone:
                    white = "" if last is None else "\n" if "\n" in white else " "
                fresh, last = fresh + white + text[a:b], i
        want[key, text] = (fresh if gone else text, len(words), len(gone))
    return want


@pytest.mark.parametrize("common", [1, 8, 1_000])
def test_passages(spark, monkeypatch, common):
    monkeypatch.setattr(line_dedup, "COMMON", common)
    rng = random.Random(21)
    source = [prose(rng, 200).split() for _ in range(4)]
    rows = []
    for i in range(10, 60):
        w = []
        for _ in range(rng.randint(1, 4)):
            a, n = rng.randint(0, 150), rng.choice((20, 49, 50, 51, 80))
            w += prose(rng, rng.randint(0, 30)).split() + rng.choice(source)[a : a + n]
        rows.append((i, rng.choice(("", " ", "\n")) + "".join(x + rng.choice((" ", " ", "  ", "\n", " \n\n")) for x in w)))
    rows += odd(rng) + [(99, rows[3][1]), (5, rows[3][1]), (None, rows[4][1]), (98, " ".join(source[0] + source[0]))]
    want = plain_passages(rows)
    out = line_dedup.dedup_passages(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "id", "h", "n_words", "n_removed"]
    got = sorted(str((r.doc_id, r.text, r.n_words, r.n_removed)) for r in out.collect())
    assert got == sorted(str((k, *want.get((k, t), (t, 0, 0)))) for k, t in rows)
    assert sum(0 < n < m for _, m, n in want.values()) > 20 and line_dedup.dedup_passages(frame(spark, [])).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows = odd(rng)
    for g in range(12):
        base = prose(rng, rng.choice((8, 30, 120))).split()
        for _ in range(rng.randint(1, 8)):
            w = [rng.choice(VOCAB) if rng.random() < rng.choice((0, 0.02, 0.06)) else x for x in base]
            rows.append((len(rows) + 10, " ".join(w).replace("a", "A", rng.randint(0, 3))))
    sets = [(k, minhash.shingles(t or "", 2)) for k, t in rows]
    ids = {k for k, _ in sets if k is not None}
    links = [(a, b) for a, x in sets for b, y in sets if None not in (a, b) and a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = root(links, ids)
    got = minhash.near_duplicates(frame(spark, rows), n=2).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles in {len(s) for k, s in sets if k == r.doc_id}
    assert len(links) > 20 and minhash.near_duplicates(frame(spark, []), n=2).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Groups of many blocks: long chains of edits, members that share bands with a hub but not its words, one common text."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    rng = random.Random(31)
    rows, base = [], prose(rng, 60).split()
    for i in range(90):  # a chain: neighbours are close, ends are far apart
        base[i % 60] = f"new{i}"
        if i % 7 == 0:
            base = [*base[1:], f"x{i}"]
        rows.append((i, " ".join(base)))
    half = prose(rng, 40)
    rows += [(200 + i, half + " " + prose(rng, rng.choice((6, 9, 12, 40)))) for i in range(60)]
    rows += [(400 + i, "the very same text in many rows of the table") for i in range(40)] + [(500, "the very same text in many rows of a table")]
    rng.shuffle(rows)
    sets = [(k, minhash.shingles(t, 2)) for k, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 80 * len(x | y)]
    want = root(links, [k for k, _ in rows])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), n=2).collect()}
    assert got == want and len(set(want.values())) > 20


def test_spread_join(spark, monkeypatch):
    from termspire.llm import common
    from termspire.operators import joins

    monkeypatch.setattr(joins, "LIGHT", 5)
    monkeypatch.setattr(joins, "MOST_HEAVY", 4)
    rng = random.Random(32)
    rows = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, 4, 5, None]), i) for i in range(300)], "k long, x long")
    side = spark.createDataFrame([(1, "a"), (3, "b"), (9, "c")], "k long, y string")
    for how in ("inner", "left", "left_semi"):
        assert sorted(map(str, common.spread_join(rows, side, "k", how).collect())) == sorted(map(str, rows.join(side, "k", how).collect()))
    assert common.share_bound(3000 / 1e17) > 0 and common.share_bound(1.0) == common.share_bound(7.0) == common.SPACE


def test_odd_sketch_estimates():
    s = minhash.Sketcher(2)
    rng = random.Random(5)
    w = prose(rng, 800).split()
    x = [w[0] if rng.random() < 0.02 else v for v in w]
    a, b = s.distinct(" ".join(w)), s.distinct(" ".join(x))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sk = s.sketches(np.array([s.minima(a), s.minima(b)]))
    differ = sum(bin(int(p) & (1 << 64) - 1).count("1") for p in sk[0] ^ sk[1])
    bits = minhash.SKETCH_WORDS * 64
    estimate = 1 + bits / (4 * minhash.BANDS * minhash.ROWS) * np.log(1 - 2 * differ / bits)
    assert abs(estimate - true) < 0.08


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 60)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 64))
    rows = []
    for i in range(700):
        v = base[rng.integers(0, 60)] + rng.standard_normal(64) * rng.choice([0.0, 0.12, 0.2, 1.0])
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 2))))
    hot = base[0] + rng.standard_normal((200, 64)) * 0.05
    rows += [(1000 + i, [float(x) for x in v], 1) for i, v in enumerate(hot)]
    odd_rows = [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, [float("nan")] * 64, 1), (5003, [None] + [1.0] * 63, 1), (5004, rows[0][1], None), (5005, [1.0, 2.0], 1), (5006, [1.0, 2.0], 1), (None, rows[0][1], 1), (5007, [], 1)]
    got = {r.vec_id: r for r in embedding_dedup.link(spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<double>, label int")).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    want = root([(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(near), strict=True)], [r[0] for r in rows])
    assert [got[r[0]].n_links for r in rows] == near.sum(axis=1).tolist()
    assert all(got[k].component_id == c for k, c in want.items())
    assert [got[k].n_links for k in (5000, 5001, 5002, 5003, 5004, 5005, 5006, None, 5007)] == [0, 0, 0, 0, 0, 1, 1, 0, 0]
    assert got[5006].component_id == 5005 and not got[5006].kept
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_embedding_leaves_split_again(spark, monkeypatch):
    """Leaves of the sample's trees stay too large, so executors split them; lengths without trees start at the root."""
    for name, value in (("SAMPLE", 40), ("LEAF", 20), ("MOST", 60), ("BLOCK", 50), ("FITTED", 1)):
        monkeypatch.setattr(embedding_dedup, name, value)
    seen = []
    monkeypatch.setattr(embedding_dedup, "split_again", lambda at, v, w, f=embedding_dedup.split_again: seen.append((at, f(at, v, w))) or seen[-1][1])
    rng = np.random.default_rng(6)
    rows = []
    for dim, start, n in ((32, 0, 500), (24, 1000, 300)):
        base = rng.standard_normal((n // 4, dim))
        rows += [(start + i, [float(x) for x in base[rng.integers(0, len(base))] + rng.standard_normal(dim) * 0.05], 1) for i in range(n)]
    rows += [(3000 + i, rows[0][1], 1) for i in range(80)] + [rows[7]]  # a class of copies, a repeated row
    frame_ = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, c string, v double")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(frame_).collect()}
    rows = sorted({r[0]: r for r in rows}.values())
    links, count = [], {}
    for i, (a, x, _) in enumerate(rows):
        for b, y, _ in rows[i + 1 :]:
            if len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links.append((a, b))
                count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    want = root(links, [r[0] for r in rows])
    assert got == {k: (count.get(k, 0), c) for k, c in want.items()}
    before, after = seen[0]
    most = lambda t: t.groupBy("label", "dim", "leaf").count().agg(F.max("count")).first()[0]
    assert most(before) > 150 and most(after) <= 60


@pytest.mark.parametrize("dim", [64, 384, 768])
def test_embedding_recall_by_dimension(dim):
    """Pairs just above the threshold share a leaf, and vectors have about as many leaves in any dimension."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((1000, dim))
    z -= (z * x[:1000]).sum(axis=1, keepdims=True) * x[:1000]
    y = 0.981 * x[:1000] + (1 - 0.981**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    shape = embedding_dedup.plan(np.log2(3000 / 150))
    forest = embedding_dedup.fit(x, 150, shape)
    a, b = embedding_dedup.assign(x, forest, shape.spill), embedding_dedup.assign(y, forest, shape.spill)
    found = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=False)])
    print(dim, shape, np.mean([len(p) for p in a]), found)
    assert found > 0.998 and np.mean([len(p) for p in a]) < 12


def test_leaves_grow_slowly():
    """A vector's leaves follow the plan, whose growth for four times the rows falls with the depth."""
    planned = {d: p.trees * (1 + 0.8 * p.spill) ** d for d in range(0, 36, 2) for p in [embedding_dedup.plan(d)]}
    print({d: round(planned[d + 2] / planned[d], 2) for d in planned if d + 2 in planned})
    assert all(planned[d + 2] < (1.65 if d < 10 else 1.4 if d < 14 else 1.25 if d < 20 else 1.2) * planned[d] for d in range(4, 34, 2))
    rng, leaves = np.random.default_rng(1), []
    for k in (10, 40, 160):
        x = rng.standard_normal((k * 60, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        shape = embedding_dedup.plan(np.log2(k))
        forest = embedding_dedup.fit(x, 60, shape)
        leaves.append(np.mean([len(p) for p in embedding_dedup.assign(x, forest, shape.spill)]))
    print(leaves)
    assert leaves[1] < 2 * leaves[0] and leaves[2] < 1.6 * leaves[1]


def test_pairs_of_earlier_leaves(monkeypatch):
    """One by one or as a product, the same pairs are left."""
    rng = np.random.default_rng(2)
    leaves = [np.unique(rng.integers(0, 40, rng.integers(1, 6))) for _ in range(90)]
    earlier = embedding_dedup._earlier(leaves, 25)
    near = rng.random((90, 90)) < 0.3
    want = np.array([[near[i, j] and not (set(leaves[i][leaves[i] < 25]) & set(leaves[j][leaves[j] < 25])) for j in range(90)] for i in range(90)])
    for few in (0, 25, 1000):
        monkeypatch.setattr(embedding_dedup, "FEW", few)
        assert (embedding_dedup._fresh(near, earlier, earlier) == want).all()
    assert (embedding_dedup._fresh(near, earlier[:, :0], earlier[:, :0]) == near).all()


def test_packing(spark):
    rng = random.Random(6)
    rows = odd(rng) + [(100 + i, prose(rng, rng.randint(0, 300))) for i in range(80)]
    enc = tokenizer.encoder(tokenizer.default_path())
    got = packing.pack_documents(frame(spark, rows)).collect()
    want = []
    for key, text in rows:
        ids = np.frombuffer(enc.ids(text or ""), "<u4").tolist() + [2]
        stop, start, piece = len(ids) % 1024 or 1024, 0, 0
        while start < len(ids):
            want.append((str(key), piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start, stop, piece = stop, stop + 1024, piece + 1
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    enc, lib = tokenizer.encoder(tokenizer.default_path()), Tokenizer.from_file(tokenizer.default_path())
    lib.encode_special_tokens = True
    rng = random.Random(7)
    parts = ["a", "b", " ", "  ", "\n", " \n", "'s", "1", "é", "\x1c", "!", "\t", "the", "<|endoftext|>", "日本"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        tree = token_counts.PretokenTree.of_text(t, enc)
        for _ in range(3):
            s, n, new = rng.randint(0, len(t) + 1), rng.randint(0, 5), "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
            at = min(s, len(t))
            t = t[:at] + new + t[at + n :]
            tree.edit(s, n, new)
            assert tree.text() == t and tree.n_tokens == len(lib.encode(t, add_special_tokens=False).ids)


def test_ids_of_whole_tables_equal_the_library(spark):
    """Every document, page and conversation turn of the smallest tables."""
    from tokenizers import Tokenizer

    enc, lib = tokenizer.encoder(tokenizer.default_path()), Tokenizer.from_file(tokenizer.default_path())
    lib.encode_special_tokens = True
    for name, column in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
        texts = [r[0] or "" for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(column).collect()]
        want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(enc.ids(t), "<u4").tolist() for t in texts] == want
        assert [enc.count(t) for t in texts] == list(map(len, want))


def test_token_counts(spark):
    rng = random.Random(8)
    rows = odd(rng) + [(50, prose(rng, 200))]
    edit = F.expr("""array(named_struct('start', 3, 'length', 4, 'new', " new 's"), null, named_struct('start', 1000000, 'length', 5, 'new', cast(null as string)))""")
    got = token_counts.count_tokens(frame(spark, rows).withColumn("edits", F.when(F.col("doc_id") != 5, edit))).collect()
    enc = tokenizer.encoder(tokenizer.default_path())
    want = []
    for key, text in rows:
        t = text or ""
        new = t if key in (5, None) else t[:3] + " new 's" + t[7:]
        want.append((str(key), enc.count(t), enc.count(new), len(new)))
    assert sorted((str(r.doc_id), *r[1:4]) for r in got) == sorted(want)
    assert {r.doc_id: r.n_chars_encoded for r in got}[50] < 60
    assert token_counts.count_tokens(frame(spark, []).withColumn("edits", edit)).count() == 0


def test_stored_trees_follow_batches_of_edits(spark):
    """Trees are written once; later batches encode little, leave other rows alone, and agree with counting from scratch."""
    rng = random.Random(81)
    texts = {i: t or "" for i, (_, t) in enumerate(odd(rng))} | {100 + i: prose(rng, rng.randint(0, 400)) for i in range(30)}
    docs = frame(spark, [(k, t or None) for k, t in texts.items()])
    enc = tokenizer.encoder(tokenizer.default_path())
    trees = token_counts.build(docs).cache()
    assert {r.doc_id: (r.n_tokens, r.n_chars) for r in trees.collect()} == {k: (enc.count(t), len(t)) for k, t in texts.items()}
    encoded = 0
    for batch in range(3):
        chosen = rng.sample(sorted(texts), 12)
        plan = {k: [(rng.randint(0, len(texts[k]) + 2), rng.randint(0, 30), prose(rng, rng.choice((0, 1, 90)))) for _ in range(2)] for k in chosen}
        for k, edits in plan.items():
            for start, n, new in edits:
                at = min(start, len(texts[k]))
                texts[k] = texts[k][:at] + new + texts[k][at + n :]
        given = spark.createDataFrame(list(plan.items()), "doc_id long, edits array<struct<start:int,length:int,new:string>>")
        after = token_counts.edit(trees.join(given, "doc_id", "left")).cache()
        got = {r.doc_id: r for r in after.collect()}
        assert {k: (r.n_tokens_edited, r.n_chars_edited, r.text) for k, r in got.items()} == {k: (enc.count(t), len(t), t) for k, t in texts.items()}
        assert {k for k, r in got.items() if r.n_chars_encoded} <= set(plan) and all(sum(r.lengths) == len(texts[k]) for k, r in got.items())
        encoded = sum(r.n_chars_encoded for r in got.values()) - sum(len(new) for edits in plan.values() for _, _, new in edits)
        # A leaf that an insertion filled is split again: no leaf of several runs outgrows the limit.
        assert all(n <= token_counts.LEAF_CHARS or " " not in r.text[sum(r.lengths[:i]) + 1 :][: n - 1] for r in got.values() for i, n in enumerate(r.lengths) if n > 300)
        trees = after.select("doc_id", F.col("n_tokens_edited").alias("n_tokens"), F.col("n_chars_edited").alias("n_chars"), "text", "lengths", "counts")
    assert encoded < 0.2 * sum(map(len, texts.values()))
    plan = token_counts.edit(docs.select("doc_id").limit(0).join(trees, "doc_id").withColumn("edits", F.lit(None).cast("array<struct<start:int,length:int,new:string>>")), keep=False)
    assert plan.count() == 0


def test_trees_of_a_large_batch_are_held_some_at_a_time(spark, monkeypatch):
    """What a worker allocates to build and edit trees doesn't grow with the rows of its batch; all rows come out, right, in small batches."""
    rng = random.Random(82)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(3000)] + ["", "é" * 9, prose(rng, 3000)]
    frames, works = type(spark.range(0)), []
    for name in ("mapInArrow", "mapInPandas"):
        real = getattr(frames, name)
        monkeypatch.setattr(frames, name, lambda df, work, shape, real=real, name=name: works.append((df, work, name)) or real(df, work, shape))
    edits = F.expr("array(named_struct('start', 3, 'length', 4, 'new', ' new '), null)").cast("array<struct<start:int,length:int,new:string>>")
    trees = token_counts.build(frame(spark, list(enumerate(texts)))).withColumn("edits", edits).cache()
    token_counts.edit(trees)
    assert len(works) == 2

    def run(df, work, name, n):
        table = df.orderBy("id").limit(n).toArrow().combine_chunks()
        given = table.to_pandas() if name == "mapInPandas" else table.to_batches()[0]
        assert len(given) == n
        tracemalloc.start()
        sizes = [len(out) for out in work(iter([given]))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(sizes) == n and max(sizes) <= 512
        return peak

    for one in works:
        run(*one, 3000)  # fills the encoder's cache
        assert run(*one, 3000) < 2 * run(*one, 512)
    monkeypatch.setattr(token_counts, "BYTES", 1000)
    assert min(len(out) for out in works[0][1](iter(works[0][0].toArrow().combine_chunks().to_batches()))) == 1
    enc = tokenizer.encoder(tokenizer.default_path())
    got = {r.doc_id: r for r in token_counts.edit(trees).collect()}
    for i, t in enumerate(texts):
        new = t[:3] + " new " + t[7:]
        assert (got[i].n_tokens, got[i].n_tokens_edited, got[i].text, sum(got[i].counts)) == (enc.count(t), enc.count(new), new, enc.count(new))


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        lines = [" ".join(rng.choice(VOCAB) for _ in range(rng.randint(5, 20))).capitalize() + "." for _ in range(rng.randint(1, 6))]
        if not good:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = [" | ".join(rng.choice(VOCAB) for _ in range(60)), " ".join(w.upper() + "!!" for w in rng.choices(VOCAB, k=50))]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    return rows, labels


def test_quality(spark):
    rng = random.Random(9)
    rows, labels = labelled(rng, 300)
    lab = spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, quality int")
    docs = frame(spark, rows + [(k and k + 1000, t) for k, t in odd(rng)])
    model = quality.fit(docs, lab)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + 8 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert quality.score(docs.limit(0), model).count() == 0
    again = quality.fit(docs.repartition(5), lab.repartition(3))
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.calibration, model.calibration)


def test_quality_without_two_classes(spark):
    """Without labels of both kinds scores are the labels' smoothed share, never simply good."""
    docs = frame(spark, [(i, "some text") for i in range(40)])
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert isinstance(none, quality.Prior) and none.n == 0 and {(r.score, r.predicted) for r in quality.score(docs, none).collect()} == {(0.5, 0)}
    for y in (0, 1):
        labels = spark.createDataFrame([(i, y) for i in range(40)], "doc_id long, quality int")
        one = quality.fit(docs, labels)
        used = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
        assert one.n == used and one.value == (used * y + 1) / (used + 2)
        assert {r.predicted for r in quality.score(docs, one).collect()} == {y}
    both = spark.createDataFrame([(i, i % 2) for i in range(100, 200)], "doc_id long, quality int")
    assert isinstance(quality.fit(docs, both), quality.Prior) and isinstance(quality.fit(docs.limit(0), both), quality.Prior)


def test_quality_samples_rare_classes(spark, monkeypatch):
    monkeypatch.setattr(quality, "RARE", 12)
    rng = random.Random(41)
    rows, labels = labelled(rng, 400)
    bad = [k for k, y in labels if not y and zlib.crc32(str(k).encode()) % 4 != 2][:12]
    keep = [(k, y) for k, y in labels if y or k in bad]
    seen = []
    monkeypatch.setattr(quality, "train", lambda base, size, lines, y, w, f=quality.train: seen.append((y, w)) or f(base, size, lines, y, w))
    model = quality.fit(frame(spark, rows), spark.createDataFrame(keep, "doc_id long, quality int"), sample=60)
    y, w = seen[0]
    assert (y == 0).sum() == 12 and 30 < (y == 1).sum() < 100 and w[y == 1].mean() > 2 * w[y == 0].mean()
    monkeypatch.setattr(quality, "LINES", 100)
    quality.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(seen[1][0]) < 60 and isinstance(model, quality.Model)


def plain_line(t: bytes) -> list[float]:
    """A line's values, a byte and a word at a time."""
    kinds = [sum(quality._LUT[c] == k for c in t) for k in range(1, len(quality._KINDS) + 1)]
    words = [w for w in re.split(rb"[ \t\r\x0b\x0c]+", t) if w]
    n, m = max(len(t), 1), max(len(words), 1)
    ends = sum(quality._LUT[w[-1]] in (6, 8) for w in words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    first, last = (quality._LUT[t[0]], quality._LUT[t[-1]]) if t else (0, 0)
    return [*(k / n for k in kinds), np.log1p(len(words)), np.log1p(len(t)), (len(t) - kinds[3]) / m, len(set(words)) / m, again / m, ends / m, first == 2, last == 5]


def plain_score(model, text: str) -> float:
    """Features by hand, marginals by enumeration of all labellings of up to eight lines."""
    lines = text.encode().split(b"\n")
    base = np.array([plain_line(t) for t in lines])
    z = (base - model.mean) / model.scale
    k, u = quality.N_BASE, []
    for i in range(len(lines)):
        bins = [float((base[i, f] > model.cuts[f]).sum() == b) for f in range(k) for b in range(quality.BINS)]
        x = [*z[i], *(z[i - 1] if i else np.zeros(k)), *(z[i + 1] if i + 1 < len(lines) else np.zeros(k)), *bins, i == 0, i + 1 == len(lines), 1]
        u.append(float(np.dot(x, model.weights)))
    total, good = 0.0, np.zeros(len(lines))
    for code in range(1 << len(lines)):
        y = [(code >> i) & 1 for i in range(len(lines))]
        p = np.exp(sum(a * b for a, b in zip(u, y, strict=True)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:], strict=False)))
        total, good = total + p, good + p * np.array(y)
    w = np.array([len(t) + 1e-3 for t in lines])
    share = np.clip((good / total * w).sum() / w.sum(), 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(model.calibration[0] + model.calibration[1] * np.log(share / (1 - share)))))


def test_quality_scores_equal_brute_force(spark):
    rng = random.Random(43)
    rows, labels = labelled(rng, 200)
    docs = frame(spark, rows)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    parts = ["Word", "word", "word ", "ÉÜ", "12", "!!", "| ", "\t", "\n", " ", ".", "a$", "?"]
    odd_ones = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    every = [r for r in rows + odd_ones + [(2000, None), (2001, ""), (2002, "\n\n")] if (r[1] or "").count("\n") < 8]
    got = {r.doc_id: r.score for r in quality.score(frame(spark, every), model).collect()}
    assert len(every) > 250 and all(got[k] == pytest.approx(plain_score(model, t or ""), abs=2e-4) for k, t in every)


def test_field_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    m = quality.Model(np.zeros((quality.N_BASE, quality.BINS - 1)), np.zeros(1), np.ones(1))
    m.transitions = rng.standard_normal((2, 2))
    lines = np.array([1, 4, 3])
    u = rng.standard_normal(8)
    good, moves, z = m.chains(u, lines)
    want, total, edges = [], 0.0, np.zeros((2, 2))
    at = 0
    for n in lines:
        weights = {}
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            weights[tuple(y)] = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(m.transitions[a, b] for a, b in zip(y, y[1:], strict=False)))
        s = sum(weights.values())
        total += np.log(s)
        want += [sum(w for y, w in weights.items() if y[i]) / s for i in range(n)]
        for y, w in weights.items():
            for a, b in zip(y, y[1:], strict=False):
                edges[a, b] += w / s
        at += n
    assert np.allclose(good, want) and np.isclose(z, total) and np.allclose(moves, edges)


def plain_model():
    rng = np.random.default_rng(3)
    texts = [b"\n".join(rng.choice([b"a b c", b"the cat sat on it.", b"|| x", b"", b"12 34", "é à".encode()], rng.integers(1, 60))) for _ in range(60)]
    base, size, lines = quality.describe(texts)
    return texts, quality.train(base, size, lines, rng.integers(0, 2, 60))


def test_long_chains_equal_short_ones(monkeypatch):
    """In slices, and by blocks of matrices, a text has the score that it has as a whole."""
    texts, model = plain_model()
    texts += [b"", b"\n", b"one line", b"\n\n\n", b"x" * 700 + b"\n" + b"y z " * 90]
    want = model.share(*quality.describe(texts))
    whole = quality._scores(texts, model)
    for slice_, group in ((1, 1 << 19), (7, 1 << 19), (20_000, 40), (3, 100)):
        monkeypatch.setattr(quality, "SLICE", slice_)
        monkeypatch.setattr(quality, "GROUP", group)
        assert all(b"\n".join(quality.slices(t)) == t for t in texts)
        assert np.allclose([model.long_share(t) for t in texts], want, atol=1e-6)
        assert np.allclose(quality._scores(texts, model), whole, atol=1e-5)
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 97):
        score, t = rng.standard_normal((n, 2)), rng.standard_normal((2, 2))
        plain = [score[0]]
        for s in score[1:]:
            plain.append(s + np.logaddexp(plain[-1][0] + t[0], plain[-1][1] + t[1]))
        assert np.allclose(quality.forward(score, t), plain)


def test_two_million_lines_take_bounded_memory():
    _, model = plain_model()
    text = b"a\n" * 1_000_000 + b"the cat sat.\n" * 1_000_000
    tracemalloc.start()
    share = model.long_share(text)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert 0 <= share <= 1 and peak < 600, peak


def test_flac_streams():
    rng = np.random.default_rng(3)
    pad = lambda b: b + b"\0" * (-len(b) % 64 or 64 * (not b))
    t = np.arange(9000)
    payloads = [pad(b""), *(pad(b"a" * n) for n in (1, 64, 4096, 4097, 8192))]
    payloads += [pad(rng.integers(0, 256, int(n), dtype=np.uint8).tobytes()) for n in rng.integers(1, 9000, 10)]
    payloads += [(128 + 100 * np.sin(t / f)).astype(np.uint8).tobytes()[:8960] for f in (3, 10, 50, 300)]
    payloads += [pad(("Some words of text, with é. " * n).encode()) for n in (1, 10, 400)]
    streams = flac.encode(payloads)
    assert [b"".join(x for _, x in s) for s in flac.decode(streams)] == payloads
    assert [at for at, _ in flac.decode(streams)[5]] == [0, 4096]
    total, _, _, first = flac.metadata(streams[5])
    bare = b"fLaC\x80\x00\x00\x22" + streams[5][8:42] + streams[5][first:]
    assert b"".join(x for _, x in flac.decode([bare])[0]) == payloads[5] and total == 8192
    for at in (first + 2, -1, -30, 30):
        bad = bytearray(streams[8])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_flac_known_answer():
    """The mono 8-bit example stream of the public format specification (RFC 9639, appendix D.3)."""
    stream = bytes.fromhex(
        "664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32"
        "fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3"
    )
    samples = [0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]
    ((at, pcm),) = flac.decode([stream])[0]
    assert at == 0 and [b - 128 for b in pcm] == samples
    # The check strings of the public CRC definitions.
    assert flac.crc8(b"123456789") == 0xF4 and int(flac.crc16(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0]) == 0xFEE8


def test_flac_seek():
    rng = np.random.default_rng(5)
    p = rng.integers(60, 120, 30016, dtype=np.uint8).tobytes()
    (m,) = flac.encode([p])
    for start, n in ((0, 10), (4090, 20), (29990, 100), (8192, 4096), (0, 99999), (30016, 5), (12345, 0)):
        assert flac.read(m, start, n) == p[start : start + n]
    broken = bytearray(m)
    broken[-20] ^= 1
    assert flac.read(bytes(broken), 0, 4096) == p[:4096]  # frames that aren't asked for aren't touched
    with pytest.raises(ValueError):
        flac.read(bytes(broken), 30000, 10)


def plain_feature(p: bytes) -> str:
    x = [b - 128 for b in p]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    return f"{sum(x) * 1000 // len(x)}:{sum(v * v for v in x) // len(x)}:{crossings * 10000 // len(x)}:{max(map(abs, x))}"


def test_media(spark):
    from termspire.sources.store import shared_dir

    rng = random.Random(10)
    rows = odd(rng)
    stored = media.store(frame(spark, rows))
    got = media.round_trip(frame(spark, rows), slices=3).collect()
    streams = {str(r.doc_id): bytes(r.media) for r in stored.collect()}
    want = []
    for key, text in rows:
        b = (text or "").encode()
        p = b + b"\0" * (-len(b) % 64 or 64 * (not b))
        m = streams[str(key)]
        want.append((str(key), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), plain_feature(p)))
        assert b"".join(x for _, x in flac.decode([m])[0]) == p
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    assert media.blocks(stored).where("doc_id = 6").agg(F.sum("n_samples")).first()[0] == 20032
    assert media.round_trip(frame(spark, [])).count() == 0
    left = [p for p in __import__("pathlib").Path(shared_dir(spark)).iterdir() if p.name.startswith(("media-", "pcm-"))]
    assert not left  # media and PCM of a slice go when its digests are written
    blocks = media.pcm(stored).where("doc_id = 6").first().blocks
    found = [(b.sample_offset, bytes(b.pcm)) for b in blocks]
    assert [b.n_samples for b in blocks] == [4096] * 4 + [3648] and media._digest(found)[0] == 20032
    with pytest.raises(ValueError):
        media._digest(found[1:])


def test_mixing(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["b", "a", "é", None, "b", "b"])) for i in range(3000)]
    rows += [(5000, None, "tiny"), (5001, "a b", "tiny"), (5001, "a b", "tiny")]
    got = mixing.mix(frame(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, budget = {}, set(names), float(sum(sizes.values()))
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        budget -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = {}
    for r in got:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows).repartition(7)).collect()))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_of_null_and_repeated_ids(spark, monkeypatch):
    """Rows that share an id, or have none, are taken one by one, so their sources come near their targets."""
    monkeypatch.setattr(mixing, "COPIES", 8)
    rows = [(None, "a b c d e f g h i j", "n")] * 50 + [(7, f"{i} b c d e", "m") for i in range(100)] + [(8, "same words here", "o")] * 90 + [(None, None, "n")] * 3
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sum(r.size == 10 for r in got) == 50
    for source in "nmo":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5.5 and own[0].source_size == sum(r.size for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_targets_of_many_sources(spark):
    rng = random.Random(51)
    sizes = {f"host{i:04}": rng.choice([0, 1, 5, 50, 5000]) for i in range(400)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(6)).collect()}
    names = sorted(sizes)
    weight, target, free, budget = {s: 1 + i % 3 for i, s in enumerate(names)}, {}, set(names), float(sum(sizes.values()))
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        budget -= sum(target[s] for s in over)
        free = free - over if over else set()
    assert got == pytest.approx(target)


def test_mixing_takes_documents_without_words(spark):
    import corpus_pipeline

    rows = [(i, "w " * 20, "a") for i in range(200)] + [(i, "w w", "c") for i in range(200, 210)]
    empty = [(i, (None, "", " \n")[i % 3], "c") for i in range(300, 330)] + [(i, "", "e") for i in range(400, 410)]
    docs = frame(spark, rows + empty + [(i, None, "a") for i in range(500, 530)])
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(0).alias("n_chars"))
    mix = {r.doc_id: r for r in mixing.mix(docs).collect()}
    got = corpus_pipeline.mix_sources(spark, docs, "").groupBy("doc_id").count().collect()
    got = {r.doc_id: r["count"] for r in got}
    # Source a is cut, c stands at three times its size, e has no words at all.
    assert {got[i] for i in (*range(200, 210), *range(300, 330))} == {3} and {got[i] for i in range(400, 410)} == {1}
    q = int(mix[0].target // mix[0].source_size)
    assert all(got.get(i, 0) in (q, q + 1) for i in (*range(200), *range(500, 530)))
    assert got == {i: r.times for i, r in mix.items() if r.times} and all(r.taken == r.size * r.times for r in mix.values())


def test_warc(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "u", big), (9, "u\nx", big), (4, None, big), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (None, "u", big), (9, "u", big)]
    pages = spark.createDataFrame([(a, u, h, "z") for a, u, h in rows], "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "revisit", 9), ("4", "revisit", 9), ("None", "revisit", 9), ("9", "response", None), ("9", "response", None), ("5", "response", None), ("6", "response", None), ("7", "response", None)])
    html = {str(a): (h or "").encode() for a, _, h in rows}
    assert all((r.payload_bytes, r.payload_digest) == (len(html[str(r.page_id)]), hashlib.sha1(html[str(r.page_id)]).hexdigest()) for r in got)
    assert all(bytes(r.payload) == html[str(r.page_id)] for r in got if r.record_type == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_normaliser():
    one = warc.record(1, "u", b"a" * 3000, "d", None, "response") + warc.record(2, "u", b"", "d", None, "response")
    cut = lambda d, n: (d[i : i + n] for i in range(0, len(d), n))
    for data in (warc._gzip(one), b"".join(warc._gzip(one[i : i + 700]) for i in range(0, len(one), 700))):
        for n in (1, 7, 100, 1 << 20):
            found = list(warc.normalise(cut(data, n)))
            new, index = b"".join(m for m, _ in found), [e for _, e in found]
            assert b"".join(warc.inflate(iter([new]))) == one and len(index) == 2
            assert all(b"".join(warc.inflate(iter([new[o : o + k]]))).startswith(b"WARC/1.1") for _, o, k, _ in index)
    for bad in (warc._gzip(one[:-9]), warc._gzip(one)[:-9], warc._gzip(one)[:40]):
        with pytest.raises(ValueError):
            list(warc.normalise(iter([bad])))


def test_warc_files(spark, tmp_path, monkeypatch):
    """Archives and sidecars are files; a record is one seek and one member."""
    monkeypatch.setattr(warc, "ARCHIVE", 4000)
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 150) for i in range(20)], "page_id long, url string, html string").repartition(2)
    whole = warc.write_archives(pages, str(tmp_path / "a"))
    made = warc.normalise_archives(whole, str(tmp_path / "b")).collect()
    assert len(made) > 4 and sum(r.n_records for r in made) == 20
    assert {f"{r.archive}.warc.gz" for r in made} == {p.name for p in (tmp_path / "a").iterdir()} == {p.name for p in (tmp_path / "b").glob("*.gz")}
    for r in made:
        entries = warc.read_index(r.index_path)
        with warc.files.Reader(f"file://{r.path}") as file:
            head, record = warc.read_record(file, entries[-1])
            assert file.read_bytes == entries[-1]["length"] < r.size or len(entries) == 1
        key = int(head["WARC-Record-ID"].split(":")[-1][:-1])
        assert record.endswith((f"page {key} " * 150).encode() + b"\r\n\r\n")
    wrong = [{**e, "record": "x"} for e in entries]
    with warc.files.Reader(made[-1].path) as file, pytest.raises(ValueError):
        warc.read_record(file, wrong[0])


PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def good(k, v):
    d = re.sub("[^0-9]", "", v)
    if k == 1:
        return all(int(x) <= 255 for x in v.split("."))
    if k == 2:
        return 16 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return k != 3 or 8 <= len(d) <= 15


def test_pii(spark):
    rng = random.Random(12)
    parts = ["a", "@", ".", "b-c", " ", "1", "23", "255", "256", "+", "(", ")", "-", "_", "é", "\n", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "+1 (555) 010-9999", "日"]
    rows = odd(rng) + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(900, "7" * 30000), (901, "a.b@c.d " * 500)]
    got = pii.find_pii(frame(spark, rows)).select("*", pii.spans_text("base_spans").alias("b")).collect()
    want = []
    for key, text in rows:
        spans = [(k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text or "") if good(k, m.group())]
        want.append((str(key), ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans), *(sum(s[0] == k for s in spans) for k in range(4))))
    assert sorted((str(r.doc_id), r.b, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == sorted(want)
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_pii_zero_octets(spark):
    good_ones = ["10.0.0.1", "127.0.0.1", "192.168.0.5", "255.255.255.0", "0.0.0.0", "00.00.00.00", "8.0255.0.000", "0010.1.01.9"]
    rows = [(i, f"from {ip} on") for i, ip in enumerate([*good_ones, "10.0.0256.1", "0.0.0.300", "1000.0.0.1", "0.0.0.0999", "0" * 30000 + ".0.0.256"])]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base_spans if s.kind == 1] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got == {i: [(1, 5, 5 + len(good_ones[i]))] if i < len(good_ones) else [] for i, _ in rows}


def test_pii_contexts(spark):
    rows = [(i, f"Please call me +1 555 010 {1000 + i} today") for i in range(9)]
    rows += [(50, "so call me 555-0199-22, or not"), (51, "invoice total 555-0199-23"), (52, "the year of 19992"), (53, "do call me (555) 010-2000 or 7 times")]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    assert [(s.kind, s.start, s.end) for s in got[50].spans] == [(3, 11, 22)] and got[50].n_phone == 0
    assert [(s.kind, s.start, s.end) for s in got[53].spans] == [(3, 11, 25)]
    assert got[51].spans == [] and got[52].spans == [] and len(got[0].spans) == 1


def test_pii_found_entities_induce_patterns(spark):
    """Identifiers found by seeds' contexts stand in another context, which finds further ones in the next round."""
    rows = [(i, f"please dial number +1 555 010 {1000 + i} soon") for i in range(20)]
    rows += [(100 + i, f"we dial number 77-{3000 + i} soon") for i in range(4)]  # by the first pattern
    rows += [(200 + i, f"reference of person: 77-{3000 + i} end of record") for i in range(4)]  # the same ones elsewhere
    rows += [(300, "another, reference of person: 88-9999 end"), (301, "nothing about 88-9998 here")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got[100] == [(3, 15, 22)] and got[200] == [(3, 21, 28)] and got[300] == [(3, 30, 37)] and got[301] == []
    one = pii.matches(frame(spark, rows).selectExpr("doc_id as id", "text", "xxhash64(text) as th"))
    first = {r.id for r in pii.discover(one.where(pii._valid(F.col("kind"), F.col("value"))), rounds=1).collect()}
    assert 100 in first and 300 not in first


def test_pii_goes_on_until_nothing_is_found(spark):
    """Each round's identifiers stand in a context of their own, which points at the next ones; the eighth round's are found."""
    rows, seeds, rounds = [], [f"+1 555 010 {1000 + i}" for i in range(20)], 7
    for k in range(rounds):
        # A pattern is trusted once the six identifiers of the level before are; then it points at six more.
        own = [*seeds, *(f"7{k - 1}-{3000 + i}" for i in range(6 * (k > 0))), *(f"7{k}-{3000 + i}" for i in range(6))]
        rows += [(1000 * k + i, f"see entry {chr(97 + k) * 2} {value} {chr(97 + k)}{chr(97 + i)} and so on") for i, value in enumerate(own)]
    got = {r.doc_id: len(r.spans) for r in pii.find_pii(frame(spark, rows)).collect()}
    assert set(got.values()) == {1}
    assert {key: len(own) for key, own in plain_spans(rows).items()} == got
    spans = pii.matches(frame(spark, rows).selectExpr("doc_id as id", "text", "xxhash64(text) as th"))
    early = {r.id // 1000 for r in pii.discover(spans.where(pii._valid(F.col("kind"), F.col("value"))), rounds=3).collect()}
    assert early == {0, 1, 2}


def plain_spans(rows, support=3, confidence=0.75):
    """All spans of each row, by loops over texts, tokens and pairs."""
    items = []
    for key, text in rows:
        text = text or ""
        base = [(k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if good(k, m.group())]
        words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text)]
        marked = [w for w in words if re.search("[0-9@]", text[w[0] : w[1]])]
        at = {w: i for i, w in enumerate(words)}
        left = lambda w, words=words, at=at, text=text: " ".join(text[a:z].lower() for a, z in words[max(0, at[w] - 2) : at[w]])
        right = lambda w, words=words, at=at, text=text: " ".join(text[a:z].lower() for a, z in words[at[w] + 1 : at[w] + 3])
        for k, a, z in base:
            first, last = max(w for w in marked if w[0] <= a), max(w for w in marked if w[0] <= z - 1)
            items.append((key, a, z, text[a:z].lower(), k, left(first), right(last)))
        runs = []
        for w in marked:
            if any(a < w[1] and z > w[0] for _, a, z in base):
                continue
            if runs and text[runs[-1][-1][1] : w[0]] == " ":
                runs[-1].append(w)
            else:
                runs.append([w])
        for run in runs:
            a, whole = run[0][0], text[run[0][0] : run[-1][1]]
            ok = lambda c, more: c.isalnum() or c in more
            while whole and not ok(whole[0], "+("):
                a, whole = a + 1, whole[1:]
            while whole and not ok(whole[-1], ")"):
                whole = whole[:-1]
            if len(re.findall("[0-9]", whole)) >= 4 or "@" in whole:
                items.append((key, a, a + len(whole), whole.lower(), None, left(run[0]), right(run[-1])))
    pairs, seeds = {}, {}
    for _, _, _, value, seed, l, r in items:
        for pattern in ("<" + l, ">" + r):
            if value and len(pattern) > 1:
                pairs.setdefault(pattern, set()).add(value)
                if seed is not None:
                    seeds[value] = max(seed, seeds.get(value, 0))
    scores, trust = {v: (k, 1.0) for v, k in seeds.items()}, {}
    while True:
        trust = {}
        for pattern, values in pairs.items():
            best = []
            for kind in range(4):
                own = [scores[v][1] for v in values if v in scores and scores[v][0] == kind and scores[v][1] >= confidence]
                if len(own) >= support and sum(own) / len(values) >= confidence:
                    best.append((sum(own) / len(values), -kind))
            if best:
                trust[pattern] = max(best)
        fresh = {v: (c, -k) for v, (k, c) in scores.items()}
        for pattern, (c, k) in trust.items():
            for v in pairs[pattern] - set(seeds):
                fresh[v] = max((c, k), fresh.get(v, (0, 0)))
        done = all(c - scores.get(v, (0, 0))[1] <= pii.RISE for v, (c, _) in fresh.items())
        scores = {v: (-k, c) for v, (c, k) in fresh.items()}
        if done:
            break
    out = {}
    for key, a, z, _, seed, l, r in items:
        if seed is not None:
            out.setdefault(key, set()).add((seed, a, z))
        elif best := [trust[p] for p in ("<" + l, ">" + r) if p in trust and len(p) > 1]:
            out.setdefault(key, set()).add((-max(best)[1], a, z))
    return {key: sorted(out.get(key, ())) for key, _ in rows}


def test_pii_spans_equal_brute_force(spark):
    rng = random.Random(91)
    lead, trail = ["call me", "mail to", "at host", "ref no", "x " * 3 + "é", "y" * 200 + " z", "12 34"], ["now", "or later", "\n", ", please", "5 6", ""]
    entity = [
        lambda: f"+1 555 010 {rng.randint(1000, 1200)}", lambda: f"a{rng.randint(0, 90)}@b.example", lambda: f"10.0.{rng.randint(0, 90)}.7",
        lambda: f"({rng.randint(200, 202)}) 010-{rng.randint(2000, 2002)},", lambda: f"77-{rng.randint(1000, 1005)}", lambda: f"id@{rng.randint(1, 9)}", lambda: str(rng.randint(1, 99)),
    ]
    rows = []
    for i in range(500):
        k = rng.randrange(7) if rng.random() < 0.25 else rng.choice([(0, 0), (1, 1), (2, 2), (0, 3), (0, 4), (3, 4), (1, 5)])
        a, e = (k, k) if isinstance(k, int) else k
        text = " ".join(f"{rng.choice(VOCAB)} {lead[a]} {entity[e]()} {rng.choice(trail)}" for _ in range(rng.randint(1, 3)))
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, "9" * 5000 + " call me"), (903, "call me " + "1 " * 3000)]
    want = plain_spans(rows)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(frame(spark, rows)).collect()}
    base = {r.doc_id: len(r.base_spans) for r in pii.find_pii(frame(spark, rows)).collect()}
    assert sum(len(v) - base[k] for k, v in got.items()) > 40
    assert got == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    rows, labels = labelled(rng, 160)
    copies = [(500 + i, rows[j][1] + " more words") for i, j in enumerate(range(0, 40, 2))]
    docs = spark.createDataFrame([(k, t, "en", f"src{k % 3}", len(t)) for k, t in rows + copies], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, now = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen.append(now)
    assert all(d.columns == docs.columns for d in seen[:-1])
    truth = dict(labels)
    kept = {r.doc_id for r in seen[1].select("doc_id").collect()}
    assert sum((k in kept) == bool(y) for k, y in labels) > 0.95 * len(labels)
    texts = [(r.doc_id, minhash.shingles(r.text, 5)) for r in seen[3].collect()]
    assert not [1 for a, x in texts for b, y in texts if a < b and x and y and 5 * len(x & y) >= 4 * len(x | y)]
    assert truth and seen[5].agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[5].count()


def awkward_documents(rng):
    rows, labels = labelled(rng, 120)
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in rows]
    rows += [(500 + i, rows[j][1] + " more words", "en", "src1", 1) for i, j in enumerate(range(0, 40, 2))]
    run = prose(rng, 70)
    rows += [(600 + i, f"Alpha beta {i}. {run} gamma {i}.", "fr", None, 5) for i in range(6)]
    rows += [(700, None, None, None, None), (701, "", "en", "src0", 0), (702, " \n ", "en", "src9", 3), (703, "Alpha beta gamma.", "en", "src0", 1)]
    rows += [rows[3]] * 2 + [(7, "Alpha beta gamma delta epsilon.", "de", "src2", 9), (None, "Alpha beta gamma zeta.", "en", "src0", 2)]
    rows += [(None, "Alpha beta gamma zeta.", "en", "src0", 2), (None, None, "en", None, None), (704, " ".join(["Alpha beta."] * 8000), "en", "src2", 1)]
    return [(*r, "x", 1) for r in rows], labels


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, id string, th long"


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, with nulls, repeated rows and ids, empty and long texts and clashing columns."""
    import corpus_pipeline as cp

    rows, labels = awkward_documents(random.Random(71))
    spark.createDataFrame(rows, AWKWARD).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    now, tables = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    model = quality.fit(now, spark.read.parquet(str(tmp_path / "labels.parquet")))
    for name, stage in cp.STAGES:
        now = cp.table(stage(spark, now, str(tmp_path)), f"t-{name[:4].strip()}")
        tables.append(now)
    assert all(t.columns == AWKWARD.replace(" long", "").replace(" string", "").split(", ") for t in tables[:-1])
    good, lines, near, mixed, packed = ([tuple(r) for r in t.collect()] for t in tables)
    texts = lambda rs: sorted(str(r[:4]) for r in rs)
    assert texts(good) == texts([r for r in rows if plain_score(model, r[1] or "") >= quality.THRESHOLD])
    cut = plain_passages([r[:2] for r in good])
    want = [(k, cut.get((k, t), (t,))[0], lang, s) for k, t, lang, s, *_ in good]
    assert texts(lines) == texts(want) and any(t[2] for t in cut.values())
    assert all(n == len(t) for (_, t, _, _, n, *_), old in zip(sorted(lines, key=str), sorted(good, key=str), strict=True) if t and t != old[1] and n not in {g[4] for g in good})
    # Near copies: one row an id, the smallest id of each group, one row a text among rows without an id.
    sets = [(k, minhash.shingles(t or "", 5)) for k, t, *_ in lines if k is not None]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 5 * len(x & y) >= 4 * len(x | y)]
    keep = set(root(links, [k for k, _ in sets]).values())
    assert sorted(r[0] for r in near if r[0] is not None) == sorted(keep)
    assert sorted(str(r[1]) for r in near if r[0] is None) == sorted({str(r[1]) for r in lines if r[0] is None}) and set(near) <= set(lines)
    # The mix: as many copies of each row as the operator says, which has a test of its own.
    times = {(r.doc_id, r.source, r.text_hash): r.times for r in mixing.mix(tables[2]).collect()}
    hashes = {(r.doc_id, r.source, r.text): r.h for r in tables[2].select("doc_id", "source", "text", F.xxhash64("text").alias("h")).collect()}
    assert sorted(map(str, mixed)) == sorted(str(r) for r in near for _ in range(times[r[0], r[3], hashes[r[0], r[3], r[1]]]))
    enc = tokenizer.encoder(tokenizer.default_path())
    assert sum(r[3] for r in packed) == sum(enc.count(r[1] or "") + 1 for r in mixed)
    assert corpus_rows(tables[-1]) == corpus_rows(cp.run(spark, str(tmp_path)))


def corpus_rows(packed):
    """Pieces without the numbers of their sequences."""
    return sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in packed.collect())


def test_stages_take_repeated_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    labels = "doc_id long, quality int"
    spark.createDataFrame([], labels).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], AWKWARD)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
    same = [(9, "Alpha beta gamma.", "en", "a", 1, "x", 1)] * 30 + [(None, "Alpha delta.", "en", "a", 1, "x", 1)] * 20 + [(8, "zeta eta", "en", "b", 1, "x", 1)]
    docs = spark.createDataFrame(same, AWKWARD)
    assert cp.quality_classifier(spark, docs, str(tmp_path)).count() == len(same)  # no label rejects anything
    assert sorted(str(r.doc_id) for r in cp.dedup_documents(spark, docs, "").collect()) == ["8", "9", "None"]
    mixed = cp.mix_sources(spark, docs, "").groupBy("doc_id").count().collect()
    taken = {r.doc_id: r.times for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("times").alias("times")).collect()}
    assert {r.doc_id: r["count"] for r in mixed} == {k: n for k, n in taken.items() if n}


def test_classifier_keeps_columns(spark):
    rows, labels = labelled(random.Random(72), 80)
    docs = frame(spark, [*rows, (None, None), (None, "x")])
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = quality.keep_good(docs, model)
    want = [r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()]
    assert kept.columns == docs.columns and sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect()) and len(want) < len(rows)
