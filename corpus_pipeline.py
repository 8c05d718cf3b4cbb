"""A training corpus from raw documents: the stages in order, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the folder all executors share and reads it back for the next stage. All stages but
the last return the columns of documents (and extra ones that came in). Where a stage cuts a
text, ``n_chars`` counts what is left. Null and empty texts go through all stages: they are
not toxic, near no other, and have no tokens. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrain.llm import bpe, chosen_path, fm_index, toxicity, windows
from lotgrain.llm.queries import vocabulary
from lotgrain.llm.rows import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _counted(cut: DataFrame) -> DataFrame:
    if "n_chars" not in cut.columns:
        return cut
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.reject(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the one with the least id stays."""
    return chosen_path.drop_near_duplicates(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that occur elsewhere are cut out of texts; every document stays."""
    return _counted(windows.remove_repeats(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out of texts; every document stays."""
    return _counted(fm_index.remove_hits(docs, _table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as tokens and back: their number, and hashes of the ids and of the decoded text."""
    keep = [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns]
    return bpe.digests(docs, bpe.load(vocabulary()), keep=keep)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", remove_repeats),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: The first two stages are a trained model and components of a graph of trees: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
