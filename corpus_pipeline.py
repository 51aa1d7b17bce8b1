"""From documents to packed sequences: language ID, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as
Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import dartminhash, langid, packing, pii
from sessionloom.llm.common import free_name, read, scratch, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; one without text or letters goes. Ambiguous ones stay as they are."""
    model = langid.fit(docs, langid.fold("id") != 2)
    into = free_name(docs)
    return langid.predict(docs, model, into).filter(F.col(f"{into}.lang_pred") != langid.UNKNOWN).drop(into)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id, and one row of it."""
    classes = dartminhash.near_duplicates(docs)
    gone = stored(classes.filter("doc_id <> class_id").select("doc_id").distinct())
    near = F.broadcast(gone) if gone.count() <= dartminhash.BROADCAST_IDS else gone
    kept = docs.join(near, "doc_id", "left_anti").select(*docs.columns)
    twice = stored(classes.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    # rows repeated with one id: the others are whole already, so only these are grouped
    few = F.broadcast(twice) if twice.count() <= dartminhash.BROADCAST_IDS else twice
    return kept.join(few, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(few, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind, and n_chars to match."""
    model = pii.fit(pii.scan(docs))
    return pii.redact(docs, model).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packed)]

#: Trained and hashed stages have no SQL; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
