"""Bounded, hash-ordered samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents teach a classifier; their choice depends on ids alone.
SAMPLE_ROWS = 20_000


def remainder(doc_id: str, modulus: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, wanted, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, target, fold) of up to ``rows`` labelled documents for which ``wanted`` holds.

    Null ids and labels teach nothing. An id labelled more than once counts as 1 from a mean of
    one half; of documents that share an id the least text is taken, so the bound holds for rows as
    well. The chosen ids are few by construction, so they are broadcast to the documents.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & wanted)
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("target"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int").alias("fold")
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("target").alias("target"))
    return texts.select("doc_id", "text", "target", fold)
