"""Queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docql.llm import bpe, decontaminate, html, langid, linededup, maxscore, pii, ppm, shards, simhash
from docql.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file; the nodes have them installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Of the demonstration: a deployment passes its own secret key.
PSEUDONYM_KEY = "docql demonstration key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonyms(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return found.select("doc_id", F.size("pii").cast("bigint").alias("n_values"), F.concat_ws(",", F.array_sort(F.array_distinct(F.col("pii.kind")))).alias("kinds"), "text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True).drop("items")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_maxscore_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_vectors(table(spark, sf_dir, "embeddings"), k=5)


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), partners="every").select("doc_id", "n_lines", "n_removed", "text")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT item, w, least(8, len(w)) AS size, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM i WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[s : s + size - 1], ' ') AS g FROM iw
), sizes AS (
  SELECT DISTINCT size FROM windows
), dw AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes)
), hits AS (
  SELECT doc_id, item, p, size FROM dw JOIN windows USING (size, g)
), covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p + unnest(range(0, size)) AS q FROM hits) GROUP BY doc_id
), terms AS (
  SELECT DISTINCT item, w AS item_words, unnest(w) AS term FROM i
), needed AS (
  SELECT item, item_words, count(*) AS terms FROM terms GROUP BY item, item_words
), placed AS (
  SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d
), held AS (
  SELECT doc_id, item, item_words FROM (SELECT DISTINCT doc_id, term FROM placed) JOIN terms USING (term) GROUP BY ALL HAVING count(*) = len(list_distinct(item_words))
), near_terms AS (
  SELECT doc_id, item, item_words, term, pos FROM held JOIN terms USING (item, item_words) JOIN placed USING (doc_id, term)
), near AS (
  SELECT doc_id, count(DISTINCT item) AS n_near FROM (
    SELECT a.doc_id, a.item FROM (SELECT DISTINCT doc_id, item, item_words, pos FROM near_terms) a JOIN near_terms b USING (doc_id, item, item_words)
    WHERE b.pos BETWEEN a.pos AND a.pos + 2 * len(a.item_words) - 1
    GROUP BY a.doc_id, a.item, a.item_words, a.pos HAVING count(DISTINCT b.term) = len(list_distinct(a.item_words))
  ) GROUP BY doc_id
), named AS (
  SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""

def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""

OP5_SQL = """
WITH crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), drawn AS (
  SELECT rid, s.shard, -ln((CAST('0x' || substr(md5(d.k || ':' || s.shard), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) AS cost
  FROM docs d, (SELECT unnest(range(0, 41)) AS shard) s
), won AS (
  SELECT rid, arg_min(shard, (cost, shard)) FILTER (WHERE shard < 40) AS shard, arg_min(shard, (cost, shard)) AS grown_shard FROM drawn GROUP BY rid
), summed AS (
  SELECT rid, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS crc
  FROM docs, crc
)
SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k || ':' || crc), doc_id, crc, strlen(text)) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM docs JOIN won USING (rid) JOIN summed USING (rid)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_maxscore_top5": op4_maxscore_top5,
    "op5_rendezvous_shards": op5_rendezvous_shards,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_bpe": op8_bpe,
    "op9_ppm_score": op9_ppm_score,
    "op10_main_text": op10_main_text,
}
ORACLES: dict[str, str] = {"op2_decontamination": OP2_SQL, "op4_maxscore_top5": OP4_SQL, "op5_rendezvous_shards": OP5_SQL}
