"""Ids beyond what a double holds, beside null ones, in every operator."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from termspire.llm import line_dedup, media, minhash, mixing, packing, pii, quality, token_counts, warc

IDS = [2**60 + 1, 2**60 + 3, 7, None, -(2**63)]
RNG = random.Random(77)
TEXTS = {i: " ".join(RNG.choice("abcdefgh") + str(RNG.randint(0, 99)) for _ in range(80)) for i in IDS}


def docs(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in TEXTS.items()], "doc_id long, text string, source string").coalesce(1)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


def test_whole_ids(spark):
    d, want = docs(spark), sorted(IDS, key=str)
    assert ids(packing.pack_documents(d).collect()) == want
    assert ids(quality.score(d, quality.Prior(0.5, 0)).collect()) == want
    assert ids(media.round_trip(d).collect()) == want
    stored = media.store(d)
    assert ids(media.pcm(stored).collect()) == want == sorted({r.doc_id for r in media.blocks(stored).collect()}, key=str)
    edits = d.withColumn("edits", F.expr("array(struct(0 as start, 1 as length, 'x' as new))"))
    assert ids(token_counts.count_tokens(edits).collect()) == want
    assert ids(token_counts.edit(token_counts.build(d).withColumn("edits", F.lit(None).cast("array<struct<start:int,length:int,new:string>>"))).collect()) == want
    for out in (line_dedup.dedup_lines(d), line_dedup.dedup_passages(d), mixing.mix(d), pii.find_pii(d)):
        assert ids(out.collect()) == want


def test_near_duplicates_of_large_ids(spark):
    copy = spark.createDataFrame([(2**60 + 5, TEXTS[7], "s"), (2**60 + 7, TEXTS[2**60 + 1], "s")], "doc_id long, text string, source string")
    d = docs(spark).unionByName(copy).coalesce(1)
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(d, n=2, percent=80).collect()}
    want = {i: (i, True) for i in IDS if i is not None} | {2**60 + 5: (7, False), 2**60 + 7: (2**60 + 1, False)}
    assert {i: x for i, x in got.items() if i is not None} == want


def test_pages_of_large_ids(spark):
    big = "<p>x</p>" * 300
    rows = [(2**60 + 1, "a", big), (2**60 + 3, "b", big), (5, None, big), (2**60 + 5, "", "small"), (-(2**63), None, "small")]
    for some in (rows, [*rows, (None, "n", big)]):
        pages = spark.createDataFrame(some, "page_id long, url string, html string").coalesce(1)
        got = {r.page_id: (r.url, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
        first = 2**60 + 3
        want = {2**60 + 1: ("a", "revisit", first), first: ("b", "response", None), 5: (None, "revisit", first), 2**60 + 5: ("", "response", None), -(2**63): (None, "response", None)}
        assert got == want | ({None: ("n", "revisit", first)} if len(some) > len(rows) else {})


def test_stages_keep_documents_of_large_ids(spark, tmp_path):
    d = docs(spark)
    for stage in (corpus_pipeline.dedup_lines, corpus_pipeline.dedup_documents, corpus_pipeline.mix_sources):
        d = stage(spark, d, str(tmp_path))
        assert sorted({r.doc_id for r in d.collect()}, key=str) == sorted(IDS, key=str)
    assert sorted({r.doc_id for r in corpus_pipeline.pack_sequences(spark, d, str(tmp_path)).collect()}, key=str) == sorted(IDS, key=str)
