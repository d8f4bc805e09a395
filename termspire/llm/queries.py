"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.llm import embedding_dedup, line_dedup, maxscore, media, minhash, mixing, packing, pii, prefix_trie, quality, spelling, token_counts, warc
from termspire.llm.common import read, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read(spark, sf_dir, "embeddings"))


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(read(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), n=2, percent=80)


def op9_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of all documents, stored, then three edits of each that follow from its id and length: a deletion, a replacement and an insertion."""
    trees = table(token_counts.build(read(spark, sf_dir, "documents")), "trees", "zstd")
    n, key = F.col("n_chars"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(9973))
    at = lambda k: F.pmod(key * k + 17, F.greatest(n, F.lit(1))).cast("int")
    edit = lambda start, length, new: F.struct(start.alias("start"), F.lit(length).alias("length"), new.alias("new"))
    edits = F.array(
        edit(at(31), 5, F.lit("")),
        edit(at(57), 3, F.concat(F.lit(" <"), key.cast("string"), F.lit("> "))),
        edit(at(83), 0, F.lit("\nedited 's text  ")),
    )
    return token_counts.edit(trees.withColumn("edits", edits), keep=False)


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(f"n_{k}" for k in pii.KINDS),
        F.sha2(pii.spans_text("base_spans"), 256).alias("base_sha256"), pii.spans_text("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op11_spelling_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(read(spark, sf_dir, "conversations"))


def op13_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return maxscore.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_embedding_dedup, op3_pattern_packing, op4_quality_crf, op5_flac_media,
        op6_source_mix, op7_warc_normaliser, op8_odd_sketch_dedup, op9_edit_token_counts, op10_contextual_pii,
        op11_spelling_halves, op12_prefix_trie, op13_maxscore_topk, pipeline,
    )
}

#: The table of the check sum that zip files have, and the sum of a list of bytes by it.
_CRC_TABLE = """
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
_CRC = "xor(list_reduce([4294967295] || {}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    # A run of lines is compared by its text; windows are the shortest runs of 50 words from and back to each line.
    "op1_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, trim(unnest(a), E' \t\r\x0b\x0c') AS line
  FROM (SELECT doc_id, string_split(text, E'\n') AS a FROM documents WHERE text <> '')),
real AS (SELECT *, len(regexp_extract_all(line, {_WORDS})) AS n FROM lines),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto,
         sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS since
  FROM real WHERE n > 0),
wins AS (
  SELECT doc_id, sum(n) OVER f AS n, list(line) OVER f AS ls, min(pos) OVER f AS a, max(pos) OVER f AS b FROM run
  WINDOW f AS (PARTITION BY doc_id ORDER BY since RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, sum(n) OVER f, list(line) OVER f, min(pos) OVER f, max(pos) OVER f FROM run
  WINDOW f AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
keyed AS (SELECT doc_id, a, b, md5(array_to_string(ls, E'\n')) AS k FROM wins WHERE n >= 50),
first AS (SELECT k, min(struct_pack(d := doc_id, p := a)) AS f FROM keyed GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM keyed JOIN first USING (k)
  WHERE struct_pack(d := doc_id, p := a) > f),
rest AS (
  SELECT doc_id, string_agg(line, E'\n' ORDER BY pos) AS fresh
  FROM (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
        FROM (SELECT doc_id, string_split(text, E'\n') AS a FROM documents WHERE text IS NOT NULL))
  ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(r.fresh, '') END AS text,
       CAST(coalesce(len(string_split(d.text, E'\n')), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN cut c USING (doc_id) LEFT JOIN rest r USING (doc_id)""",
    "op2_embedding_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN cnt c ON c.a = e.vec_id LEFT JOIN low l ON l.a = e.vec_id""",
    "op7_warc_normaliser": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to FROM g""",
    "op8_odd_sketch_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low l ON l.a = d.doc_id""",
    # Two words are one replacement apart if they agree without the character at one place, one insertion if one is the other without it.
    "op11_spelling_halves": f"""
WITH RECURSIVE {_CRC_TABLE},
low AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents),
runs AS (SELECT d, r, count(*) AS k FROM low WHERE length(r) >= 7 GROUP BY d, r),
hashed AS (
  SELECT r, k, {_CRC.format("flatten(list_transform(string_split(d || ':' || r, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END))")} AS h
  FROM runs, crc),
words AS (
  SELECT w AS word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS w FROM hashed)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.s
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.s),
best AS (SELECT a, count(*) AS k, arg_min(struct_pack(f := b, m := m), struct_pack(m := -m, f := b)) AS f FROM near GROUP BY a),
forms AS (
  SELECT word, n, CAST(coalesce(k, 0) AS BIGINT) AS n_near, CASE WHEN f.m >= 10 * n THEN f.f END AS form, CASE WHEN f.m >= 10 * n THEN f.m END AS form_n
  FROM words LEFT JOIN best ON a = word),
walk(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.last WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.last AS root FROM walk w JOIN forms f ON f.word = w.last WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""",
    "op12_prefix_trie": f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_CRC.format("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x))")} % 9 AS h FROM (SELECT DISTINCT c FROM turns), crc),
built AS (
  SELECT v.c, t.i, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 AND t.i <= v.h
  UNION ALL SELECT v.c, t.i, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.i > v.h),
lists AS (SELECT c, list(md5(len(role) || ':' || role || text) ORDER BY i) AS l, list(strlen(text) ORDER BY i) AS b FROM built GROUP BY c),
whole AS (SELECT v.c, coalesce(l, []) AS l, coalesce(b, []) AS b FROM convs v LEFT JOIN lists USING (c)),
p AS (
  SELECT c, d, len(l) AS n, md5(array_to_string(l[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(l[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS size
  FROM (SELECT c, l, b, unnest(range(0, len(l) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends
  FROM p GROUP BY d, k),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS k_n FROM nodes LEFT JOIN kids ON kids.up = nodes.k),
sums AS (
  SELECT p.k, sum(CASE WHEN o.k_n = 0 THEN 1 ELSE 0 END) AS leaves, sum((o.n - 1) * o.size) AS saved
  FROM own o JOIN p ON p.c = o.c AND p.d <= o.d GROUP BY p.k)
SELECT o.c AS conv_id, CAST(o.d AS BIGINT) AS depth, u.c AS parent_conv_id, o.n AS n_convs, CAST(o.k_n AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN sums USING (k) LEFT JOIN nodes u ON u.k = o.up""",
    "op13_maxscore_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
}
