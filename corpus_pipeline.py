"""The training-data pipeline: quality, near-duplicates, decontamination, secrets, tokens.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.llm import bpe, knlm, omh, phrases, secrets
from plumeline.llm.common import written

#: Up to so many ids (8 bytes each) are broadcast to leave documents out; beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000


def own_id() -> Column:
    """doc_id, or for rows without one a negative number made of the text: one decision for rows of one text."""
    return F.coalesce("doc_id", -2 - F.pmod(F.xxhash64("text"), F.lit(1 << 62)))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those own ids."""
    ids = written(ids.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct(), "left-out")
    return docs.withColumn("_id", own_id()).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of higher perplexity than their language's trusted texts go, toxic ones, and those without words; rows that share a doc_id go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = knlm.classify(docs.withColumn("doc_id", own_id()), labels.where("quality <=> 1 AND toxic <=> 0"), labels=labels)
    return without(docs, judged.where("NOT accepted"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of least doc_id; of rows with one doc_id, which are one document, that of the least text.
    Rows without a doc_id are in no class and stay."""
    found = written(omh.classes(docs), "classes")
    kept = without(docs, found.where("NOT kept"))
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        first = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(*kept.columns), F.struct("text", *[c for c in kept.columns if c != "text"])).alias("row")).select("row.*")
        kept = first.select(*kept.columns).unionByName(kept.where("doc_id IS NULL"))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return without(docs, phrases.contamination(docs.withColumn("doc_id", own_id()), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_removal),
    ("byte-level BPE", tokens),
]

#: Perplexities and sketches have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
