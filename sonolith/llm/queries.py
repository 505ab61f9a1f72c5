"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm import bpe, exact_dedup, language_id, packing, pieces, revisits, sharding, simhash, token_files, topk, toxicity
from sonolith.llm.common import cut, remove_folder, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "shards")
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"), folder=folder)
    digest = cut(rows.select("doc_id", "size", sharding.text_crc32(F.col("text")).alias("text_crc32"), "law", "shard", "slot", "grown_shard"))
    remove_folder(spark, folder)
    return digest


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language_id.held_out()
    profiles = language_id.learn(docs, ~held)
    return language_id.identify(docs, profiles).withColumn("held_out", held)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), toxicity.held_out()
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), ~held)
    return toxicity.scored(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def captures(pages: DataFrame) -> DataFrame:
    """Captures told by ``pages``: each page as a full response at time page_id, and a revisit 1,000 later.

    Every seventh revisit names another ETag, every eleventh has none, every thirteenth response has
    none either; every fifth revisit spells its URL with another scheme, a fragment and a tracking parameter.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit(""))), F.lit('"'))
    i, none = F.col("page_id"), F.lit(None).cast("string")
    stored = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("date"), i.cast("string"), F.lit("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"),
        F.lit("etag"), F.when(i % 13 == 0, none).otherwise(tag),
    )
    update = F.create_map(
        F.lit("date"), (i + 1000).cast("string"), F.lit("content-length"), F.lit("0"), F.lit("age"), F.lit("1"),
        F.lit("etag"), F.when(i % 7 == 0, F.lit('"changed"')).when(i % 11 == 0, none).otherwise(F.concat(F.lit("W/"), tag)),
    )
    spelled = F.when(i % 5 == 0, F.concat(F.lit("https://"), F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^[a-z]+://", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_medium=feed#x"))).otherwise(F.col("url"))
    full = pages.select((2 * i).alias("record_id"), F.lit("response").alias("kind"), "url", i.alias("ts"), F.map_filter(stored, lambda _, v: v.isNotNull()).alias("headers"))
    again = pages.select((2 * i + 1).alias("record_id"), F.lit("revisit").alias("kind"), spelled.alias("url"), (i + 1000).alias("ts"), F.map_filter(update, lambda _, v: v.isNotNull()).alias("headers"))
    return full.unionByName(again)


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return revisits.resolve_revisits(captures(pages)).withColumn("headers", revisits.header_lines(F.col("headers")))


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_batches(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    digest = cut(token_files.read_token_digest(manifest, folder))
    remove_folder(spark, folder)
    return digest


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact(_table(spark, sf_dir, "documents"), digest_all=True)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    if public_tokenizers.PATTERN != pieces.PATTERN:
        raise ValueError("pieces are found for another pattern")
    return bpe.encode_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_histogram_shards, op2_simhash, op3_language, op4_toxicity, op5_ball_tree, op6_revisits, op7_length_buckets, op8_token_files, op9_exact_dedup, op10_byte_bpe)
}

ORACLE_SQL = {
    "op5_ball_tree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_revisits": r"""
        WITH p AS (
            SELECT page_id, url, html, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages
        ), parts AS (
            SELECT *, regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p
        ), canon AS (
            SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
                   regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                   list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
                       lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'fbclid', 'gclid'))) AS q
            FROM parts
        ), u AS (
            SELECT page_id, 'http://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS target_url,
                   '"' || md5(coalesce(html, '')) || '"' AS tag, coalesce(strlen(html), 0) AS size
            FROM canon
        ), full_ AS (
            SELECT target_url, page_id AS ts, max(page_id) AS id FROM u GROUP BY ALL
        ), f AS (
            SELECT full_.target_url, full_.ts, u.page_id, CASE WHEN u.page_id % 13 = 0 THEN NULL ELSE u.tag END AS tag, u.size
            FROM full_ JOIN u ON u.page_id = full_.id
        ), r AS (
            SELECT page_id, target_url, page_id + 1000 AS ts,
                   CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 11 = 0 THEN NULL ELSE 'W/' || tag END AS tag
            FROM u
        ), j AS (
            SELECT r.page_id, r.target_url, r.tag, f.page_id AS response, f.tag AS tag0, f.size
            FROM r ASOF LEFT JOIN f ON r.target_url = f.target_url AND r.ts > f.ts
        ), s AS (
            SELECT *, CASE WHEN response IS NULL THEN 'orphan' WHEN tag IS NULL OR tag0 IS NULL THEN 'unchecked'
                           WHEN regexp_replace(tag, '^W/', '') = tag0 THEN 'resolved' ELSE 'mismatch' END AS status
            FROM j
        )
        SELECT 2 * page_id + 1 AS record_id, target_url, 2 * response AS response_id, status,
               CASE WHEN status IN ('resolved', 'unchecked')
                    THEN 'age: 1' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (page_id + 1000)
                    ELSE 'age: 1' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || (page_id + 1000) END
               || CASE WHEN status IN ('resolved', 'unchecked') THEN coalesce(chr(10) || 'etag: ' || coalesce(tag, tag0), '') ELSE coalesce(chr(10) || 'etag: ' || tag, '') END AS headers
        FROM s
    """,
}
