"""A corpus pipeline over `documents`: each stage works on all that the one before kept.

Stages: toxic documents go; one document of each group of near duplicates stays; personal data get surrogates;
documents are repeated or left out so that sources meet their target weights; texts are encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.llm import bpe, mixing, near_text, pii, toxicity
from quadweave.llm.common import durable, removed, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half.

    A score belongs to a text, so of texts that share a doc_id only the toxic ones go; rows with a null doc_id are
    judged by their text too. Null and empty texts are judged like labelled texts without words. Equal rows stay or
    go together; an empty table stays empty; columns beyond those of documents are left out.
    """
    scored = toxicity.score_toxicity(docs.withColumn("_h", near_text.text_key()), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["_h"])
    gone = durable(scored.where("predicted = 1").select("_h").distinct())
    return near_text.with_keys(docs.withColumn("_h", near_text.text_key()), gone, ["_h"], "left_anti").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (five words, similarity 0.8).

    Null and blank texts are one group. Texts that share a doc_id are compared as any others; of equal rows one
    stays; rows with a null doc_id stay. An empty table stays empty; other columns are left out.
    """
    return near_text.drop_near_duplicates(docs.select(*COLUMNS), words=5, similarity=0.8)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars follows the new text.

    Null texts stay null and have null n_chars; equal rows get equal texts; every row stays, those with a null
    doc_id too; an empty table stays empty; other columns are left out.
    """
    out = pii.pseudonymize(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Documents without words stay once.

    Texts that share a doc_id are documents of their own; of equal rows each is taken by itself, so together they
    are there as often as the mix takes them all. A null source is a source; null ids are allowed. An empty table
    stays empty; other columns are left out.
    """
    on = ["_id", "_none", "_h", "_source"]
    # nulls joined as values, so that the join is a plain one
    keyed = docs.select(*COLUMNS).withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull().cast("int") + 2 * F.col("source").isNull().cast("int"), "_h": near_text.text_key(), "_source": F.coalesce("source", F.lit(""))})
    plan = mixing.mix_sources(keyed, keep=on)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("cast(taken div size as int)"))
    taken = durable(plan.select(*on, times.alias("times")).groupBy(*on).agg(F.sum("times").cast("int").alias("times"), F.count("*").alias("rows")))
    # documents taken once are most of them and need no list
    out = near_text.one_of_equal_rows(keyed, durable(taken.where("rows > 1").select(*on)), on)
    out = near_text.with_keys(out, durable(taken.where("times <> 1").select(*on, "times")), on, "left")
    return out.withColumn("copy", F.explode(F.expr("array_repeat(1, coalesce(times, 1))"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: what a trainer reads.

    Null and empty texts have the end id only; equal rows give equal rows; null doc_ids stay; an empty table gives
    no rows; other columns are left out.
    """
    return bpe.encode_documents(docs).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("pii_surrogates", hide_personal_data),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

#: SQL can't express the stages; tests/llm hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in between so that lost executors cost one stage at most.

    A stage's table goes when that of the next is written; the last one stays, as the result is read from it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = written(docs)
            if before:
                removed(spark, before)
            before = path
    return docs
