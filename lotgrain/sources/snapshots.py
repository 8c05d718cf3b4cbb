"""The table of current listings: plain parquet, read as the newest row of each key.

``rows/v=<n>`` holds what batch n changed, ``base/v=<n>/bucket=<b>`` all current rows after some
batch, written anew every ``compact_every`` batches, and ``clock/v=<n>`` one row with the time
of the state, its base and the changes since. The clock is written last: a batch that dies half-way changes nothing, and a
replayed batch writes the same folders again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrain.operators.joins import broadcast_if_small
from lotgrain.operators.upkeep import KEY, duplicate_keys, latest_per_key, not_expired
from lotgrain.schema import LISTINGS

_CLOCK = "as_of_us bigint, base bigint, changes array<bigint>, v bigint"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class State:
    """The last committed batch, the time of the state, and the folders that make it up."""

    version: int | None = None
    as_of_us: int | None = None
    base: int | None = None
    changes: tuple[int, ...] = ()


class ListingSnapshots:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        buckets: int = 64,
        schema: T.StructType = LISTINGS,
        key: str = KEY,
        retention_days: float = 7,
        compact_every: int = 16,
    ):
        """``buckets`` is fixed for the life of a table: size it for 256 MB to 1 GB each.

        A batch reads the buckets of its keys in the base and the changes of at most
        ``compact_every`` batches.
        """
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema, self.key, self.retention_days = schema, key, retention_days
        self.compact_every = compact_every

    def table(self, kind: str, schema: str) -> DataFrame:
        """What all batches kept under ``kind``, by version ``v``; no rows where none has yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _clock(self) -> DataFrame:
        return self.table("clock", _CLOCK)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(r.v for r in self._clock().select("v").collect())

    def state(self, before: int | None = None) -> State:
        """The last committed state; one row is fetched."""
        clock = self._clock() if before is None else self._clock().where(F.col("v") < before)
        last = clock.orderBy(F.desc("v")).first()
        return State() if last is None else State(last.v, last.as_of_us, last.base, tuple(last.changes))

    def first_since(self, before: int, oldest_us: int) -> int:
        """The first version that is not followed by a state older than ``oldest_us``."""
        old = self._clock().where((F.col("v") < before) & (F.col("as_of_us") < oldest_us))
        last = old.agg(F.max("v").alias("v")).first().v
        return 0 if last is None else last + 1

    def current(self, state: State, keys: DataFrame | None = None, at_most: int | None = None) -> DataFrame:
        """The newest row of each key, expired ones included; only those of ``keys`` when given.

        ``keys`` (the key column, without repeats) meets the rows before any shuffle where it is
        few, and prunes the buckets of the base. ``at_most`` is a bound of their number, if known.
        """
        names = self.schema.fieldNames()
        parts = []
        if keys is not None:
            bucket = bucket_of(F.col(self.key), self.buckets)
            # The comparison tells Spark that this side is worth pruning the buckets by.
            keys = broadcast_if_small(keys.withColumn("bucket", bucket).where(F.col("bucket") >= 0), at_most=at_most)
        for kind, versions in (("base", [state.base] if state.base is not None else []), ("rows", state.changes)):
            if not versions:
                continue
            schema = T.StructType([*self.schema.fields, T.StructField("v", T.LongType())])
            if kind == "base":
                schema.add("bucket", T.IntegerType())
            folders = [f"{self.path}/{kind}/v={v}" for v in versions]
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*folders)
            if keys is not None:
                rows = rows.join(keys, [self.key, "bucket"] if kind == "base" else self.key, "left_semi")
            parts.append(rows.select(*names, "v"))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        once = len(parts) == 1 and (state.base is not None or len(state.changes) == 1)
        return (rows if once else latest_per_key(rows, self.key, ("v",))).select(*names)

    def _live(self, rows: DataFrame, as_of_us: int | None) -> DataFrame:
        if as_of_us is None:
            return rows
        return rows.where(not_expired(F.timestamp_micros(F.lit(as_of_us)), self.retention_days))

    def read(self, before: int | None = None, live_only: bool = True) -> DataFrame:
        """Current listings, without expired ones unless asked for."""
        state = self.state(before)
        rows = self.current(state)
        return self._live(rows, state.as_of_us) if live_only else rows

    def keep(self, kind: str, version: int, rows: DataFrame) -> DataFrame:
        """Write a table of a batch beside the listings and read it back.

        What is read back has no lineage to the batch, so a lost executor costs no recomputing.
        """
        folder = f"{self.path}/{kind}/v={version}"
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def kept(self, kind: str, version: int | None, schema: T.StructType) -> DataFrame | None:
        """What the batch ``version`` wrote under ``kind``; nothing where there was no batch."""
        if version is None:
            return None
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/v={version}")

    def commit(self, version: int, changed: DataFrame, as_of_us: int | None, state: State | None = None) -> None:
        """Make ``changed`` (one row per key) current; a key with two rows refuses the batch.

        ``as_of_us`` is the time of the batch in microseconds; time never runs backwards.
        ``state`` is that before the batch, where it has been read already.
        """
        state = self.state(version) if state is None else state
        as_of_us = max((t for t in (state.as_of_us, as_of_us) if t is not None), default=None)
        written = self.keep("rows", version, changed.select(*self.schema.fieldNames()))
        twice = duplicate_keys(written.select(self.key), self.key).first()
        if twice is not None:
            raise ValueError(f"batch {version} has {twice['count']} rows of {self.key} {twice[self.key]}")
        base, changes = state.base, [*state.changes, version]
        if len(changes) >= self.compact_every:
            whole = State(version, as_of_us, base, tuple(changes))
            base, changes = version, []
            live = self._live(self.current(whole), as_of_us)
            (
                live.withColumn("bucket", bucket_of(F.col(self.key), self.buckets))
                .repartition("bucket")
                .write.mode("overwrite")
                .partitionBy("bucket")
                .parquet(f"{self.path}/base/v={version}")
            )
        clock = self.spark.createDataFrame([(as_of_us, base, changes)], _CLOCK.rsplit(",", 1)[0])
        clock.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clock/v={version}")
