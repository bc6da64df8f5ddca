"""One query per operator of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.llm import bpe, licences, mips, mixing, nn_descent, pii, simhash, toxicity, unigram, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, _table(spark, sf_dir, "pages")).drop("url")


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), words=3, radius=2)


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("evidence")


def op5_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.top_products(_table(spark, sf_dir, "embeddings"), queries="vec_id % 100 = 0", k=10)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(_table(spark, sf_dir, "documents"))
    return found.withColumn("expressions", F.concat_ws("; ", "expressions"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), keep_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_dictionary, op2_simhash_bktree, op3_nn_descent, op4_toxicity_neighbours, op5_norm_buckets, op6_token_counts, op7_mix_sources, op8_licence_scan, op9_pii_surrogates, op10_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "op1_warc_dictionary": """
            WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
                 k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
                   CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
            FROM p LEFT JOIN k USING (d)""",
        "op5_norm_buckets": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
                 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    }
