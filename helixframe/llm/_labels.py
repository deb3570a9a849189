"""Bounded, reproducible training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; -1 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, may_train: Column, rows: int) -> DataFrame:
    """text and label (0/1) of at most ``rows`` labelled documents, those of the smallest hash of their id.

    The sample of ids is bounded by ``rows``, so it is broadcast and documents aren't shuffled. Equal texts with equal
    labels count once. Unlabelled documents and null labels, texts and ids are left out.
    """
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & may_train)
    picked = picked.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return texts.select("text", "label", F.xxhash64("text").alias("th")).dropDuplicates(["th", "label"])
