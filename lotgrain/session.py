"""Session settings the operators are written for."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Plain Spark settings; nothing here depends on local mode.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys: AQE splits the skewed side of a sort-merge or shuffled-hash join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets AQE take a hash join instead of a sort-merge join where each partition's map is small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.parquet.filterPushdown": "true",
    # Call-site capture on every Column call doubles the time to build the wide extraction plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.files.maxPartitionBytes": "128MB",
}


def build_session(
    app_name: str = "lotgrain",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above; ``master`` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for state, stream checkpoints and tables between steps.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``, which every executor
    can reach. Where that is unset, a session whose executors are this very process gets a
    temporary folder; any other is refused, as its executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.mkdtemp(prefix=f'{name}-')}/table"
