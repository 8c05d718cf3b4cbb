"""Structured Streaming: pages in, one current record per ad out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lotgrain.operators import lookups as K
from lotgrain.operators.lifetimes import micros
from lotgrain.operators.upkeep import KEY, outcome_counts
from lotgrain.plans import ingest as I
from lotgrain.plans.extraction import page_counter
from lotgrain.sources.pages import page_window, spread
from lotgrain.sources.snapshots import ListingSnapshots

# Fixed value: addresses of ad pages; every other page is a result page.
AD_PAGE_URL = r"/auto-oglasi/\d+/"
FEATURES = ("safety", "options", "details")
_SUMS = ("attempted", "inserted", "refreshed", "failed")
_RUN = "run string, last_page int, pages bigint, attempted bigint, inserted bigint, refreshed bigint, failed bigint, total_ads int"

Sightings = Callable[[DataFrame], DataFrame]
Details = Callable[[DataFrame, DataFrame], DataFrame]


def result_page_sightings(batch: DataFrame) -> DataFrame:
    return I.page_sightings(batch.where(~F.col("url").rlike(AD_PAGE_URL)))


def details_in_batch(batch: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ad pages that arrive in the same stream as the result pages."""
    pages = batch.where(F.col("url").rlike(AD_PAGE_URL)).select("page_id", "url", "html")
    return I.ad_page_details(pages, wanted)


def details_from(ad_pages: DataFrame, buckets: int | None = None) -> Details:
    """Ad pages from a table of their own; every batch reads its numbers and the pages it needs.

    With ``buckets`` the table was written by ``bucketed_ad_pages`` and bucket, and a batch of
    few ads reads the buckets of these alone.
    """
    return lambda batch, wanted: I.ad_page_details(ad_pages, wanted, buckets)


def coded_features(details: DataFrame, lookups: DataFrame) -> DataFrame:
    """Feature labels of ad pages as codes, the form the feature facets ask for; unknown ones are null."""
    return K.translate_checked(details, {name: K.domain(lookups, name) for name in FEATURES})


@dataclass(frozen=True)
class PageRun:
    """One pass over the result pages: from ``start_page`` on, at most ``max_pages`` of them, up to the
    first one whose counter says it is the last. Pages come in their order; a run may take several batches
    and restarts, and another name begins another run over the same listings.
    """

    name: str = "run"
    start_page: int = 1
    max_pages: int | None = None


@dataclass
class BatchIngest:
    """What a micro-batch does; also callable on a plain batch with a version number.

    Beside the listings it writes ``sightings``, ``changes``, ``quarantine`` and ``stats``
    folders per version under the snapshot path.

    Where ad pages come in the same stream, a batch adds its own to ``ad_pages``, by version and
    bucket, and reads those of the last ``wait_days`` of stream time; a sighting whose page is
    not there yet waits for as long. So the listings do not depend on how files fall into
    batches. With ``lookups`` (domain, key, value) the
    feature lists are stored as codes. A sighting dated more than ``lateness_days`` ahead of
    the clock is set aside: it would expire all others.

    With ``run`` result pages outside of it are left out, and ``runs`` has its totals after every
    batch: pages read, ads attempted, inserted, refreshed and failed, the last page once it is
    known, and the announced total.
    """

    store: ListingSnapshots
    sightings: Sightings = field(default=result_page_sightings)
    details: Details = field(default=details_in_batch)
    lookups: DataFrame | None = None
    wait_days: float = 7
    lateness_days: float = 1
    run: PageRun | None = None
    _run_is_over: bool = field(default=False, init=False)

    @property
    def waits(self) -> bool:
        return self.details is details_in_batch

    def _checked(self, found: DataFrame) -> DataFrame:
        latest = F.current_timestamp() + F.make_dt_interval(secs=F.lit(self.lateness_days * 86400.0))
        ahead = F.when(F.col("seen_at") > latest, F.array(F.lit("seen_at"))).otherwise(F.array().cast("array<string>"))
        return found.withColumn("parse_error", F.concat("parse_error", ahead))

    def __call__(self, batch: DataFrame, version: int) -> None:
        store = self.store
        state = store.state(version)
        run, counters = None, None
        if self.run is not None:
            run = self._run_before(version)
            batch, counters, run["last_page"] = self._within_run(batch, version, run["last_page"])
        # Pages are parsed once; usable and broken ads are told apart in the written table.
        checked = self._checked(self.sightings(spread(batch)))
        broken, noted = F.size("parse_error") > 0, Observation()
        metrics = F.count_if(~broken).alias("n"), F.max(F.when(~broken, micros("seen_at"))).alias("as_of")
        found = store.keep("sightings", version, checked.observe(noted, *metrics))
        times = [t for t in (state.as_of_us, noted.get["as_of"]) if t is not None]
        seen, at_most, as_of = found.where(~broken), noted.get["n"], max(times, default=None)
        late = store.kept("waiting_sightings", state.version, found.schema) if self.waits else None
        if late is not None:
            seen, at_most = seen.unionByName(late), at_most + late.count()
        stored = store.current(state, seen.select(KEY).distinct(), at_most)
        # Looked at for the pages to parse and again for the changes.
        lives = I.current_lives(seen, stored, store.retention_days * 86400)
        lives = lives.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            wanted = I.unstored(lives).select(KEY)
            if self.waits:
                details = I.ad_page_details(self._ad_pages(batch, version, as_of), wanted, store.buckets, at_most)
            else:
                details = self.details(batch, wanted)
            if self.lookups is not None:
                details = coded_features(details, self.lookups)
            changes = store.keep("changes", version, I.changed_rows(lives, stored, details, at_most))
        finally:
            lives.unpersist()
        if self.waits:
            seen, changes = self._wait(version, found.schema, seen, changes, as_of)

        failed = changes.where(F.col("outcome") == "failed").select(
            F.col("first_page").alias("page_id"),
            F.col("first_link").alias("url"),
            "parse_error",
        )
        unread = found.where(broken).select("page_id", "url", "parse_error")
        store.keep("quarantine", version, failed.unionByName(unread))
        stats = store.keep("stats", version, outcome_counts(I.page_outcomes(seen, changes), ["page_id"]))
        if run is not None:
            self._count_run(version, run, counters, stats)
        store.commit(version, I.storable(changes), as_of, state)
        self._run_is_over = run is not None and self._over(run)

    def _run_before(self, version: int | None = None) -> dict:
        """The totals of the run before a batch, or up to the last committed one."""
        rows = self.store.table("runs", f"{_RUN}, v bigint").where(F.col("run") == self.run.name)
        if version is None:
            version = self.store.state().version
            version = 0 if version is None else version + 1
        last = rows.where(F.col("v") < version).orderBy(F.desc("v")).drop("v").first()
        return last.asDict() if last else {"run": self.run.name, "last_page": None, "pages": 0, **dict.fromkeys(_SUMS, 0), "total_ads": None}

    def _over(self, run: dict) -> bool:
        limit = self.run.max_pages
        return run["last_page"] is not None or (limit is not None and run["pages"] >= limit)

    def _within_run(self, batch: DataFrame, version: int, last: int | None) -> tuple[DataFrame, DataFrame, int | None]:
        """The batch without result pages outside of the run, the counters of those inside, and the last page if known."""
        is_ad_page = F.col("url").rlike(AD_PAGE_URL)
        inside = page_window(self.run.start_page, self.run.max_pages)
        pages = batch.where(~is_ad_page & inside).select("page_id", "page_no", "html")
        counted = page_counter(spread(pages)).select("page_id", "page_no", "total", "is_last")
        # The first last page is seen while the counters are written.
        noted = Observation()
        counted = counted.observe(noted, F.min(F.when(F.col("is_last"), F.col("page_no"))).alias("last"))
        counters = self.store.keep("counters", version, counted)
        last = min((n for n in (last, noted.get["last"]) if n is not None), default=None)
        if last is not None:
            inside, counters = inside & (F.col("page_no") <= last), counters.where(F.col("page_no") <= last)
        return batch.where(is_ad_page | inside), counters, last

    def _count_run(self, version: int, run: dict, counters: DataFrame, stats: DataFrame) -> None:
        """Add a batch to the totals of the run and keep them; single numbers are fetched."""
        read = counters.agg(F.countDistinct("page_id").alias("pages"), F.max("total").alias("total_ads")).first()
        sums = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS]).first()
        run["pages"] += read["pages"]
        run["total_ads"] = max((n for n in (run["total_ads"], read["total_ads"]) if n is not None), default=None)
        for c in _SUMS:
            run[c] += sums[c]
        self.store.keep("runs", version, self.store.spark.createDataFrame([run], _RUN).coalesce(1))

    def run_totals(self) -> DataFrame:
        """One row: the totals of the run up to the last committed batch."""
        return self.store.spark.createDataFrame([self._run_before()], _RUN)

    def run_is_over(self, look: bool = False) -> bool:
        """Whether the last page, or as many pages as wanted, were read; ``look`` asks the stored totals."""
        return self._run_is_over or (look and self.run is not None and self._over(self._run_before()))

    def _oldest(self, as_of: int | None) -> int | None:
        return None if as_of is None else as_of - round(self.wait_days * 86_400_000_000)

    def _ad_pages(self, batch: DataFrame, version: int, as_of: int | None) -> DataFrame:
        """Add the batch's ad pages to those that came before; gives all young enough to count."""
        store, folder = self.store, f"{self.store.path}/ad_pages"
        pages = I.bucketed_ad_pages(batch.where(F.col("url").rlike(AD_PAGE_URL)), store.buckets)
        pages.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={version}")
        oldest = self._oldest(as_of)
        first = 0 if oldest is None else store.first_since(version, oldest)
        table = store.spark.read.schema(pages.withColumn("v", F.lit(0).cast("bigint")).schema).parquet(folder)
        return table.where(F.col("v").between(first, version))

    def _wait(
        self, version: int, schema: T.StructType, seen: DataFrame, changes: DataFrame, as_of: int | None
    ) -> tuple[DataFrame, DataFrame]:
        """Put aside sightings that wait for their page; gives the sightings and changes that are decided."""
        young = F.coalesce(micros("seen_at") >= F.lit(self._oldest(as_of)).cast("bigint"), F.lit(True))
        no_page = changes.where((F.col("outcome") == "failed") & (F.col("parse_error") == F.array(F.lit("ad_page"))))
        missing = seen.join(no_page.select(F.col("sighted_number").alias(KEY)), KEY, "left_semi")
        # All sightings of an ad wait as long as its last one is young.
        open_keys = missing.where(young).select(KEY).distinct()
        waiting = missing.join(open_keys, KEY, "left_semi").select(*schema.fieldNames())
        waiting = self.store.keep("waiting_sightings", version, waiting).select(KEY).distinct()
        decided = changes.join(waiting, F.col("sighted_number") == waiting[KEY], "left_anti")
        return seen.join(waiting, KEY, "left_anti"), decided


def start_ingest(
    pages: DataFrame, work: BatchIngest, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Run the batch work on a page stream; a restart goes on from the checkpoint."""
    writer = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def await_run(query: StreamingQuery, work: BatchIngest, poll_seconds: float = 0.5) -> DataFrame:
    """Wait until the run is over or the stream has ended, stop the stream, and give the run's totals.

    A batch cut off by the stop has pages outside of the run only, or is done again after a restart.
    """
    over = work.run_is_over(look=True)
    while not over and not query.awaitTermination(poll_seconds):
        over = work.run_is_over()
    query.stop()
    return work.run_totals()
