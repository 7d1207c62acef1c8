"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import (
    chunk_bpe, classifier, html_text, license_scan, mixing, near_dedup, packing, robust_outliers, spelling, suffix_dedup, token_counts, topk_search, whitening)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_near_dedup(spark, sf):
    return near_dedup.components(_docs(spark, sf), words=4)


def op2_license_scan(spark, sf):
    return license_scan.scan(_docs(spark, sf))


def op3_robust_outliers(spark, sf):
    return robust_outliers.judge(_docs(spark, sf))


def op4_best_fit_packing(spark, sf):
    return packing.pack(_docs(spark, sf))


def op5_quality_classifier(spark, sf):
    docs = _docs(spark, sf)
    return classifier.score(docs, classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))


def op6_token_counts(spark, sf):
    return token_counts.token_counts(_docs(spark, sf))


def op7_chunk_bpe(spark, sf):
    docs = _docs(spark, sf)
    return chunk_bpe.by_document(docs, chunk_bpe.encoded_texts(docs, digests=True))


def op8_suffix_dedup(spark, sf):
    return suffix_dedup.deduplicate(_docs(spark, sf))


def op9_topk_search(spark, sf):
    vectors = topk_search.integer_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return topk_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op10_html_text(spark, sf):
    return html_text.extract(spark.read.parquet(f"{sf}/pages.parquet"))


def op11_spelling_variants(spark, sf):
    return spelling.spelling_variants(_docs(spark, sf))


def op12_source_mix(spark, sf):
    return mixing.mix(_docs(spark, sf))


def op13_embedding_whitening(spark, sf):
    return whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_license_scan, op3_robust_outliers, op4_best_fit_packing, op5_quality_classifier, op6_token_counts, op7_chunk_bpe, op8_suffix_dedup, op9_topk_search, op10_html_text,
    op11_spelling_variants, op12_source_mix, op13_embedding_whitening)}
ORACLES = {
    "op1_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), items AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), pairs AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM items p JOIN items q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * common >= 80 * (len(p.s) + len(q.s) - common)
), reach AS (
  SELECT doc_id, doc_id AS seen FROM sets UNION SELECT reach.doc_id, b FROM reach JOIN links ON seen = a
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id, sets.doc_id = c.component_id AS kept
FROM sets JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = sets.doc_id
""",
    "op9_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(1, 9)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents
), counted AS (
  SELECT doc_id, w, count(*) AS k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS x FROM runs GROUP BY ALL
), hashed AS (
  SELECT w, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode(x)) + 1),
    lambda i: CAST(('0x' || substr(hex(encode(x)), 2 * i - 1, 2)) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h
  FROM counted, tab WHERE length(w) >= 7
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(k) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING sum(k) >= 2 AND length(word) >= 7
), skips AS (
  SELECT word, n, i, substr(word, 1, i) || chr(1) || substr(word, i + 2) AS hole, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, range(200) r(i) WHERE i < length(word)
), near AS (
  SELECT a.word, b.word AS other, b.n AS o FROM skips a JOIN skips b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY o DESC, other) AS other, max(o) AS o FROM near GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN o >= 10 * w.n THEN other END AS form, CASE WHEN o >= 10 * w.n THEN o END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, word AS top FROM judged UNION ALL SELECT chain.word, form FROM chain JOIN judged ON top = judged.word WHERE form IS NOT NULL
)
SELECT j.word, j.n, j.n_near, j.form, j.form_n, top AS root FROM judged j JOIN chain ON chain.word = j.word JOIN judged e ON e.word = top AND e.form IS NULL
""",
    "op12_source_mix": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS mark FROM documents
), sources AS (
  SELECT row_number() OVER (ORDER BY source NULLS LAST) AS unit, source, CAST(sum(size) AS BIGINT) AS s FROM docs GROUP BY source
), weighed AS (
  SELECT *, CASE unit % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS w FROM sources
), steps AS (
  SELECT *, row_number() OVER o AS p, (SELECT sum(s) FROM weighed) - coalesce(3 * sum(s) OVER before, 0) AS remaining,
    (SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER before, 0) AS shares
  FROM weighed WINDOW o AS (ORDER BY s / w, unit), before AS (ORDER BY s / w, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT remaining, shares FROM steps WHERE 3 * s * shares >= w * remaining ORDER BY p LIMIT 1
), targets AS (
  SELECT unit, source, s, w * remaining > 3 * s * shares AS capped,
    CASE WHEN w * remaining > 3 * s * shares THEN CAST(3 * s AS DOUBLE) ELSE w * CAST(remaining AS DOUBLE) / CAST(shares AS DOUBLE) END AS target FROM weighed, level
), block AS (
  SELECT greatest(1, CAST(pow(2, least(8, floor(log2(min(target) / 128)))) AS BIGINT)) AS b FROM targets WHERE target > 0
), wanted AS (
  SELECT CAST(floor(sum(target) / max(b) + 0.5) AS BIGINT) AS blocks FROM targets, block
), seats AS (
  SELECT unit, count(*) AS seats FROM (
    SELECT unit FROM targets, wanted, range((SELECT blocks FROM wanted)) r(k) WHERE target > 0
    QUALIFY row_number() OVER (ORDER BY target / (2 * k + 1) DESC, unit) <= blocks) GROUP BY unit
), placed AS (
  SELECT d.*, t.unit, t.s, t.target, t.capped, coalesce(x.seats, 0) AS source_seats, mark // 32 % greatest(1, CAST(floor(sqrt(s) / 8) AS BIGINT)) AS shard
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN seats x ON x.unit = t.unit
), shards AS (
  SELECT unit, shard, CAST(sum(size) AS BIGINT) AS words, max(source_seats) AS source_seats, any_value(capped) AS capped FROM placed GROUP BY unit, shard
), shard_seats AS (
  SELECT unit, shard, count(*) AS seats FROM (
    SELECT unit, shard, source_seats FROM (SELECT *, unnest(range(source_seats)) AS k FROM shards WHERE words > 0)
    QUALIFY row_number() OVER (PARTITION BY unit ORDER BY words / (2 * k + 1) DESC, shard) <= source_seats) GROUP BY unit, shard
), quotas AS (
  SELECT s.unit, s.shard, words, b, CASE WHEN capped THEN 3 * words ELSE least(coalesce(seats, 0) * b, 3 * words) END AS quota,
    CAST(ceil(words / b) AS BIGINT) AS m, CAST('0x' || substr(md5('mix-1|' || s.unit || '|' || s.shard), 1, 15) AS BIGINT) AS mark
  FROM shards s LEFT JOIN shard_seats x ON x.unit = s.unit AND x.shard = s.shard, block
), rests AS (
  SELECT *, CASE WHEN words > 0 THEN quota // words ELSE 0 END AS whole, CASE WHEN m > 0 THEN mark % m ELSE 0 END AS c FROM quotas
), chosen AS (
  SELECT *, least(m, CAST(floor((quota - whole * words) / b + 0.5) AS BIGINT)) AS r FROM rests
), streams AS (
  SELECT p.*, b, m, r, c, whole, CAST(sum(size) OVER (PARTITION BY p.unit, p.shard ORDER BY p.mark, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM placed p JOIN chosen q ON q.unit = p.unit AND q.shard = p.shard
)
SELECT doc_id, size, s AS source_size, target, CAST(whole * size + CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range((e - size) // b, (e - 1) // b + 1),
  lambda j: (((j + 1) * r + c) // m - (j * r + c) // m) * (least(e, (j + 1) * b) - greatest(e - size, j * b)))) END AS BIGINT) AS taken FROM streams
""",
}
