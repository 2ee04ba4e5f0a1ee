"""The queries opN_<name>: each applies one operator to its whole table and derives its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgrain.llm import decontaminate, html_blocks, packing, pii, pivot_index, simhash, substring_dedup, suffix_array, toxicity, warc


#: The key of the queries, open for all to see: for tests and checks, never for data that matters.
OPEN_KEY = "an open key for tests"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(_read(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_read(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_passages(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_read(spark, sf_dir, "documents"), packing.Packing(packing.tokenizer_path()))
    return pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"), F.col("sequence_length").cast("long").alias("sequence_length"), "step_group")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").cast("long").alias("n_tiles"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(_read(spark, sf_dir, "documents"), OPEN_KEY, found_column="pii")
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_substring_dedup, op3_suffix_array, op4_toxicity, op5_embedding_dedup, op6_html_text, op7_simhash, op8_packing, op9_decontamination, op10_pii)}

_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM d
"""

_OP2 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM w WHERE len(w) >= 13),
k AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM s),
bad AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM k) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p + j AS p FROM bad, (SELECT unnest(range(0, 13)) AS j)),
g AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
x AS (SELECT w.doc_id, w.w, unnest(range(1, len(w.w) + 1)) AS p FROM w),
kept AS (SELECT x.doc_id, string_agg(x.w[x.p], ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p WHERE gone.p IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP3 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM w WHERE len(w) >= 50),
k AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS k FROM s),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least, max(doc_id) OVER (PARTITION BY k) AS most FROM k) WHERE least < most),
new AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
island AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM new)
SELECT doc_id, CAST(min(p) - 1 AS BIGINT) AS first_word, CAST(max(p) - min(p) + 50 AS BIGINT) AS n_words FROM island GROUP BY doc_id, island
"""

_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_warc": _OP1, "op2_substring_dedup": _OP2, "op3_suffix_array": _OP3, "op5_embedding_dedup": _OP5}
