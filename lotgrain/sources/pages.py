"""Raw page tables, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrain.schema import PAGES, RESULT_PAGES


def read_pages(spark: SparkSession, path: str, schema: T.StructType = PAGES) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_pages(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RESULT_PAGES,
    files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Page files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def spread(rows: DataFrame, bytes_per_task: int = 16 * 1024 * 1024) -> DataFrame:
    """Deal a small input out to all cores before CPU-heavy text work.

    A file of one row group is read by one task however many cores wait. Inputs that give
    every core its share by size are left alone, so large tables are never shuffled here.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows if size >= tasks * bytes_per_task else rows.repartition(tasks)


def page_window(
    start_page: int = 1, max_pages: int | None = None, page_no: str = "page_no"
) -> Column:
    """Pages from ``start_page`` on, at most ``max_pages`` of them when given."""
    wanted = F.col(page_no) >= start_page
    return wanted if max_pages is None else wanted & (F.col(page_no) < start_page + max_pages)


def until_last_page(
    counted: DataFrame, run: str = "run_id", page_no: str = "page_no", is_last: str = "is_last"
) -> DataFrame:
    """Pages of each run up to and with the first one whose counter says it is the last.

    A run without such a page is kept whole.
    """
    last = counted.groupBy(run).agg(F.min(F.when(F.col(is_last), F.col(page_no))).alias("_last"))
    last = last.withColumnRenamed(run, "_run")
    within = F.col("_last").isNull() | (F.col(page_no) <= F.col("_last"))
    # Pages without a run are a run of their own.
    return counted.join(last, F.col(run).eqNullSafe(F.col("_run"))).where(within).drop("_last", "_run")
