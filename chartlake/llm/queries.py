"""The registered queries of the numbered operators: thin calls that shape each operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.llm.bpe import encode
from chartlake.llm.class_lm import score_texts
from chartlake.llm.conversation_trie import prefix_trie, turn_lists, with_shared_heads
from chartlake.llm.html_extract import extract_main_text
from chartlake.llm.mixing import mix_sources
from chartlake.llm.multi_index_hashing import nearest
from chartlake.llm.near_dedup import near_duplicates
from chartlake.llm.pii import BASE, find_pii
from chartlake.llm.quality import score_quality
from chartlake.llm.sharding import assign_shards
from chartlake.llm.substring_dedup import substring_dedup
from chartlake.llm.voronoi_knn import exact_top_k
from chartlake.llm.whitening import whiten
from chartlake.session import table


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep=("doc_id",), ids=False)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken", "_mix.copies")


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op11_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256.0)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(turn_lists(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (
    op1_bpe_roundtrip, op2_minhash_near_dedup, op3_voronoi_top_k, op4_source_mixing, op5_class_lm, op6_html_main_text,
    op7_pii_spans, op8_multi_index_hashing, op9_quality_rules, op10_substring_dedup,
    op11_minimax_sharding, op12_embedding_whitening, op13_conversation_trie,
)}
#: SQL for the operators whose results it can express.
ORACLE: dict[str, str] = {
    "op3_voronoi_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
    "op10_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
least_id AS (SELECT win, min(doc_id) AS least_id FROM win GROUP BY win),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM win JOIN least_id USING (win) WHERE least_id < coalesce(doc_id, 9223372036854775807)),
word AS (SELECT r, i, w[i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op13_conversation_trie": """
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT c, t, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                             lambda v, i: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))),
    4294967295::UBIGINT) % 9 AS h FROM own),
seq AS (
  SELECT o.c, list_concat(coalesce(b.t[1:CAST(o.h AS BIGINT)], []), o.t[CAST(o.h AS BIGINT) + 1:]) AS p
  FROM crc o LEFT JOIN own b ON b.c = o.c - o.c % 5),
pre AS (SELECT c, d, p[1:d] AS path, len(p) AS n FROM seq, LATERAL (SELECT unnest(range(0, len(p) + 1)) AS d)),
node AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d) AS ends
  FROM pre GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
every AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
below AS (
  SELECT path[1:e] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
         sum(CASE WHEN d > 0 THEN (n - 1) * strlen(path[d].x) ELSE 0 END) AS saved_tokens
  FROM every, LATERAL (SELECT unnest(range(0, d + 1)) AS e) GROUP BY 1)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM every v JOIN below USING (path) LEFT JOIN every up ON up.path = v.path[1:v.d - 1] AND up.d = v.d - 1""",
}
