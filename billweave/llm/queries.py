"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm.alignment import align_tokens
from billweave.llm.bpe import encode_decode
from billweave.llm.decontamination import contamination
from billweave.llm.fingerprints import edited_fingerprints
from billweave.llm.html_text import page_texts
from billweave.llm.line_dedup import line_dedup
from billweave.llm.manifest import merkle_manifest
from billweave.llm.near_dup import near_duplicates
from billweave.llm.quality import quality_scores
from billweave.llm.suffix_dedup import remove_repeats
from billweave.llm.tables import table
from billweave.llm.toxicity import toxicity_scores
from billweave.llm.url_rules import judge_urls
from billweave.llm.warc_zip import archive_round_trip

#: Host, path and verdict, as the contract gives them.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels"), threshold=0.3).select(
        "doc_id", "held_out", "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, table(spark, sf_dir, "labels"), threshold=0.5, with_sentences=False).select(
        "doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated")


def op8_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0).drop("url")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, numerator=85, denominator=100)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).drop("url")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=400).drop("kept")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    every_fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered=every_fifth).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_bpe": op2_bpe,
    "op3_html_text": op3_html_text,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_warc_packages": op8_warc_packages,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_url_rules": op10_url_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

CHECK_SQL: dict[str, str] = {}

CHECK_SQL["op4_line_dedup"] = r"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM texts),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY doc_id
"""

CHECK_SQL["op8_warc_packages"] = r"""
WITH full_pages AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
bits AS (SELECT *, CAST(unhex(digest) AS BIT)::VARCHAR AS b FROM full_pages),
least AS (SELECT digest, min(page_id) AS first_id FROM full_pages GROUP BY digest)
SELECT page_id, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
    + CAST(substr(b, 5 * i + 5, 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits JOIN least USING (digest)
"""

CHECK_SQL["op10_url_rules"] = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hosts AS (
  SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM split),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM hosts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM hosts h LEFT JOIN fits f ON h.page_id = f.page_id
"""

CHECK_SQL["op7_decontamination"] = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) AS size FROM item_words WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM grams),
windows AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, h.size, item FROM windows h JOIN grams g ON h.gram = g.gram AND h.size = g.size),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

CHECK_SQL["op9_near_duplicates"] = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc_words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(b, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least l ON d.doc_id = l.doc_id
"""

CHECK_SQL["op12_suffix_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
begins AS (
  SELECT id, s, md5_number(hex(array_slice(bytes, s + 1, s + 400))) AS digest
  FROM (SELECT id, bytes, unnest(range(octet_length(bytes) - 399)) AS s FROM docs WHERE octet_length(bytes) >= 400)),
again AS (SELECT id, s FROM begins WHERE digest IN (SELECT digest FROM begins GROUP BY digest HAVING count(*) > 1)),
marked AS (SELECT id, s, s > lag(s, 1, -1000) OVER w + 400 AS fresh FROM again WINDOW w AS (PARTITION BY id ORDER BY s)),
runs AS (SELECT id, s, sum(fresh::INT) OVER (PARTITION BY id ORDER BY s) AS run FROM marked),
spans AS (SELECT id, min(s) AS low, max(s) + 400 AS high FROM runs GROUP BY id, run),
gaps AS (
  SELECT d.id, coalesce(lag(high) OVER w, 0) AS low, s.low AS high, bytes FROM docs d JOIN spans s USING (id)
  WINDOW w AS (PARTITION BY d.id ORDER BY s.low)
  UNION ALL
  SELECT d.id, coalesce(max(s.high), 0), octet_length(any_value(bytes)), any_value(bytes) FROM docs d LEFT JOIN spans s USING (id) GROUP BY d.id),
kept AS (
  SELECT id, unhex(coalesce(string_agg(hex(array_slice(bytes, low + 1, high)), '' ORDER BY low), '')) AS kept
  FROM gaps WHERE high > low GROUP BY id),
sums AS (SELECT id, count(*) AS n_spans, CAST(sum(high - low) AS BIGINT) AS n_removed FROM spans GROUP BY id)
SELECT doc_id, octet_length(bytes) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(coalesce(kept, ''::BLOB)) AS kept_sha256
FROM docs LEFT JOIN sums USING (id) LEFT JOIN kept USING (id)
"""

CHECK_SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE parts AS (
  SELECT row_number() OVER () AS id, doc_id, source, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295)
      % 5 = 0 AS tampered
  FROM documents),
leaves AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(lower_text) || ':' || lower_text, '-')) END AS other FROM parts),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes(tree, level, pos, n, digest) AS (
  SELECT source, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes
  WHERE n > 1 GROUP BY tree, level, pos // 16, n),
subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops(level, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops
  WHERE n > 1 GROUP BY level, pos // 16, n),
root AS (SELECT digest AS root FROM tops WHERE n = 1),
own AS (
  SELECT p.*, s.digest AS subroot, s.pos AS top_pos FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.tree),
siblings AS (
  SELECT o.id, 0 AS part, k.level, k.pos, k.digest FROM own o JOIN nodes k ON o.source IS NOT DISTINCT FROM k.tree
    AND k.n > 1 AND k.pos // 16 = (o.pos >> (4 * k.level)) // 16 AND k.pos <> o.pos >> (4 * k.level)
  UNION ALL
  SELECT o.id, 1, k.level, k.pos, k.digest FROM own o JOIN tops k
    ON k.n > 1 AND k.pos // 16 = (o.top_pos >> (4 * k.level)) // 16 AND k.pos <> o.top_pos >> (4 * k.level)),
proofs AS (SELECT id, sha256(string_agg(digest, '' ORDER BY part, level, pos)) AS proof FROM siblings GROUP BY id),
fold(id, tree, level, pos, n, digest) AS (
  SELECT id, source, 0, pos, n, coalesce(other, leaf) FROM own
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.pos // 16, (f.n + 15) // 16,
    sha256(string_agg(CASE WHEN k.pos = f.pos THEN f.digest ELSE k.digest END, '' ORDER BY k.pos))
  FROM fold f JOIN nodes k ON f.tree IS NOT DISTINCT FROM k.tree AND f.level = k.level AND f.pos // 16 = k.pos // 16
  WHERE f.n > 1 GROUP BY f.id, f.tree, f.level, f.pos, f.n),
fold_top(id, level, pos, n, digest) AS (
  SELECT o.id, 0, o.top_pos, s.n, f.digest FROM own o JOIN fold f ON o.id = f.id AND f.n = 1 JOIN subroots s
    ON s.pos = o.top_pos
  UNION ALL
  SELECT f.id, f.level + 1, f.pos // 16, (f.n + 15) // 16,
    sha256(string_agg(CASE WHEN k.pos = f.pos THEN f.digest ELSE k.digest END, '' ORDER BY k.pos))
  FROM fold_top f JOIN tops k ON f.level = k.level AND f.pos // 16 = k.pos // 16
  WHERE f.n > 1 GROUP BY f.id, f.level, f.pos, f.n)
SELECT o.doc_id, o.leaf, o.subroot, r.root, coalesce(p.proof, sha256('')) AS proof_sha256, t.digest AS folded_root,
  t.digest = r.root AS verified
FROM own o CROSS JOIN root r JOIN fold_top t ON o.id = t.id AND t.n = 1 LEFT JOIN proofs p ON o.id = p.id
"""
