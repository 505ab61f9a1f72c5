"""From raw documents to packed batches: toxicity, language, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm import exact_dedup, language_id, packing, simhash, toxicity
from sonolith.llm.common import cut, remove_folder, shared_folder

#: Cosine with the nearest language below which a text counts as no language at all.
LEAST_COSINE = 0.03


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, learned from all labels, predicts to be toxic go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.kept(docs, model)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every language, go."""
    profiles = language_id.learn(docs, F.lit(True))
    return language_id.kept(docs, profiles, LEAST_COSINE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the greatest doc_id stays."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (similarity 4/5 or more) one stays, that with the least doc_id."""
    return simhash.drop_near(docs, components=simhash.similar_components)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches in optimal length buckets."""
    return packing.pack_batches(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_unknown_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]

#: Fingerprints, learned models and the dynamic programme are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again, and goes when the next has read it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last:
            remove_folder(spark, last)
        last = folder
    packed = cut(STAGES[-1][1](spark, docs, sf_dir))  # numbers only
    if last:
        remove_folder(spark, last)
    return packed
