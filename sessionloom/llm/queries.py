"""The registered queries of this subpackage: one per operator, thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bwtmerge, covertree, dartminhash, langid, licenses, merkle, mergedropout, packing, periods, pii, topk, urlrules, warc
from sessionloom.llm.common import read


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, 10)


#: The rules that every page is held against before mined ones (fixed values).
URL_RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number its URL ends in: low quality or toxic."""
    pages, labels = read(spark, sf_dir, "pages").select("page_id", "url"), read(spark, sf_dir, "labels")
    number = F.regexp_extract("url", r"/(\d{1,18})(?:\.\w+)?/?(?:[?#].*)?$", 1).try_cast("long")
    labelled = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return urlrules.judge(pages, labelled, URL_RULES)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.fold("id") != 2)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (langid.fold() == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dartminhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mergedropout.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op2_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(read(spark, sf_dir, "documents")).drop("n_copied")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.find(read(spark, sf_dir, "documents"), plant=True))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bwtmerge.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op12_repeated_passages": op12_repeated_passages,
    "op13_periodic_runs": op13_periodic_runs,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op2_vector_duplicates": op2_vector_duplicates,
    "op4_licenses": op4_licenses,
    "op3_merge_dropout": op3_merge_dropout,
    "op6_personal_data": op6_personal_data,
    "op7_near_duplicates": op7_near_duplicates,
    "op1_url_rules": op1_url_rules,
    "op10_language": op10_language,
    "op5_exact_topk": op5_exact_topk,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_packing": op9_packing,
}

ORACLES: dict[str, str] = {
    "op12_repeated_passages": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
cut AS (SELECT doc_id, j, substr(x, 2000 * j + 1, 2098) AS y FROM (SELECT doc_id, x, unnest(range((len(x) // 2 + 999) // 1000)) AS j FROM d)),
w AS (SELECT doc_id, 1000 * j + i AS i, substr(y, 2 * i + 1, 100) AS s FROM (SELECT doc_id, j, y, unnest(range(least(1000, len(y) // 2 - 49))) AS i FROM cut)),
low AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
f AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS opens FROM w JOIN low USING (s) WHERE first_id < doc_id),
g AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT d.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS y,
    sum(b - a) AS n_removed, count(*) AS n_spans FROM gaps JOIN d USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op11_merkle_manifest": """
WITH RECURSIVE said AS (
  SELECT doc_id, source, text,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda acc, x:
      list_reduce(list_prepend(xor(acc, x), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))) AS crc
  FROM documents
), d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN
      sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) END AS changed
  FROM said
), up AS (
  SELECT 0 AS level, source, idx, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM d
  UNION ALL
  SELECT level + 1, source, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY level, source, n, idx // 3
), subroots AS (SELECT source, digest, level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, idx, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, n, idx // 3
), sides AS (
  SELECT a.source, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
), top_sides AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
), climb AS (
  SELECT doc_id, source, 0 AS level, idx, coalesce(changed, leaf) AS digest, '' AS sides FROM d
  UNION ALL
  SELECT doc_id, c.source, c.level + 1, c.idx // 3, sha256(l || digest || r), sides || l || r
  FROM climb c JOIN sides s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.idx = s.idx
), on_top AS (
  SELECT c.doc_id, c.source, 0 AS level, s.idx, c.digest, c.sides FROM climb c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level
  UNION ALL
  SELECT doc_id, source, c.level + 1, c.idx // 3, sha256(l || digest || r), sides || l || r FROM on_top c JOIN top_sides s ON c.level = s.level AND c.idx = s.idx
)
SELECT d.doc_id, d.leaf, s.digest AS subroot, t.digest AS root, sha256(o.sides) AS proof_sha256, o.digest AS folded_root, o.digest = t.digest AS verified
FROM d JOIN subroots s ON d.source IS NOT DISTINCT FROM s.source JOIN top t ON t.n = 1 JOIN on_top o ON o.doc_id = d.doc_id AND o.level = t.level
""",
    "op2_vector_duplicates": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op5_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op8_warc_revisits": """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), r AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS response_id FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN response_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response_id <> page_id THEN response_id END AS refers_to
FROM r
""",
}
