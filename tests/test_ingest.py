from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotgrain.operators.facets import facet_filter
from lotgrain.plans import ingest as I
from lotgrain.schema import RESULT_PAGES
from lotgrain.sources.pages import stream_pages
from lotgrain.sources.snapshots import ListingSnapshots
from lotgrain.streaming.ingest import BatchIngest, PageRun, await_run, details_from, start_ingest
from tests.test_extraction import ad_page

DAY0 = datetime(2024, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


def result_page(page_id, day_no, *ads):
    """A result page with ads; an ad is its number, its link ends with the page."""
    blocks = "".join(
        f"<article class='classified ad-{n}'><a class='firstImage' href='/auto-oglasi/{n}/p{page_id}?x=1'></a></article>"
        for n in ads
    )
    return (page_id, page_id, "/search", blocks, day(day_no))


def details_page(n, own=None, **changes):
    html = ad_page(**changes).replace("<i>123</i>", str(own or n))
    return (1000 + n, 0, f"/auto-oglasi/{n}/x", html, None)


AD_PAGES = [
    details_page(1), details_page(2), details_page(3, own=33), details_page(5),
    details_page(4, basic={"Gorivo": None}),
]


@pytest.fixture
def store(spark, tmp_path):
    return ListingSnapshots(spark, str(tmp_path / "state"), buckets=4)


@pytest.fixture(scope="module")
def ad_pages(spark):
    return spark.createDataFrame(AD_PAGES, RESULT_PAGES).select("page_id", "url", "html").cache()


def run(spark, store, ad_pages, version, *pages):
    BatchIngest(store, details=details_from(ad_pages))(spark.createDataFrame(list(pages), RESULT_PAGES), version)


def state(store):
    return {
        r.ad_number: (r.link, r.ad_link, (r.createdAt - DAY0).days, (r.updatedAt - DAY0).days)
        for r in store.read().collect()
    }


def stats(spark, store, version):
    rows = spark.read.parquet(f"{store.path}/stats/v={version}").collect()
    return {r.page_id: (r.inserted, r.failed, r.refreshed, r.attempted) for r in rows}


def test_insert_refresh_and_quarantine_in_one_batch(spark, store, ad_pages):
    run(spark, store, ad_pages, 0, result_page(1, 0, 1, 4), result_page(2, 1, 1, 2, 9))
    assert state(store) == {
        1: ("/auto-oglasi/1/p1", "/auto-oglasi/1/p2", 0, 1),
        2: ("/auto-oglasi/2/p2", None, 1, 1),
    }
    assert stats(spark, store, 0) == {1: (1, 1, 0, 2), 2: (1, 1, 1, 2)}
    failed = spark.read.parquet(f"{store.path}/quarantine/v=0").collect()
    assert sorted((r.page_id, r.url, r.parse_error) for r in failed) == [
        (1, "/auto-oglasi/4/p1", ["fuel_type"]), (2, "/auto-oglasi/9/p2", ["ad_page"]),
    ]


def test_page_number_wins_and_is_flagged(spark, store, ad_pages):
    run(spark, store, ad_pages, 0, result_page(1, 0, 3))
    assert list(state(store)) == [33]
    changes = spark.read.parquet(f"{store.path}/changes/v=0").first()
    assert (changes.sighted_number, changes.ad_number, changes.number_mismatch) == (3, 33, True)


def test_later_batches_refresh_expire_and_revive(spark, store, ad_pages):
    run(spark, store, ad_pages, 0, result_page(1, 0, 1, 2, 5))
    run(spark, store, ad_pages, 1, result_page(2, 5, 1))
    assert state(store)[1] == ("/auto-oglasi/1/p1", "/auto-oglasi/1/p2", 0, 5)
    # Ads 2 and 5 were last seen on day 0; on day 9 they are gone, and 2 starts a new life.
    run(spark, store, ad_pages, 2, result_page(3, 9, 2))
    assert state(store) == {
        1: ("/auto-oglasi/1/p1", "/auto-oglasi/1/p2", 0, 5),
        2: ("/auto-oglasi/2/p3", None, 9, 9),
    }
    # A late sighting does not turn the clock back.
    run(spark, store, ad_pages, 3, result_page(4, 8, 2))
    assert state(store)[2] == ("/auto-oglasi/2/p3", None, 9, 9)


def test_replay_gives_the_same_snapshot(spark, store, ad_pages):
    run(spark, store, ad_pages, 0, result_page(1, 0, 1, 2))
    run(spark, store, ad_pages, 1, result_page(2, 1, 1, 5))
    before = state(store)
    run(spark, store, ad_pages, 1, result_page(2, 1, 1, 5))
    assert state(store) == before and store.versions() == [0, 1]


def test_batch_without_usable_ads(spark, store, ad_pages):
    run(spark, store, ad_pages, 0, result_page(1, 0))
    assert state(store) == {}
    run(spark, store, ad_pages, 1, result_page(2, 1, 1))
    assert list(state(store)) == [1]


@pytest.mark.parametrize("split", [[6], [1, 2, 1, 2]])
def test_any_page_split_gives_the_same_listings(spark, store, ad_pages, split):
    pages = [
        result_page(1, 0, 1, 2), result_page(2, 3, 1, 4), result_page(3, 6, 5, 1), result_page(4, 11, 2),
        result_page(5, 12, 1, 3), result_page(6, 13, 5, 2),
    ]
    at = 0
    for version, size in enumerate(split):
        run(spark, store, ad_pages, version, *pages[at : at + size])
        at += size
    assert state(store) == {
        1: ("/auto-oglasi/1/p1", "/auto-oglasi/1/p5", 0, 12),
        2: ("/auto-oglasi/2/p4", "/auto-oglasi/2/p6", 11, 13),
        33: ("/auto-oglasi/3/p5", None, 12, 12),
        5: ("/auto-oglasi/5/p3", "/auto-oglasi/5/p6", 6, 13),
    }


def test_stream_equals_batch(spark, store, ad_pages, tmp_path):
    folder = str(tmp_path / "pages")
    pages = [result_page(1, 0, 1, 2), result_page(2, 1, 1, 5), result_page(3, 2, 2, 4)]
    # Ad pages arrive in the same stream, with the result page that names them.
    for page in pages:
        rows = [page, *[p for p in AD_PAGES if page[0] == 1 or p[0] == 1005]]
        spark.createDataFrame(rows, RESULT_PAGES).coalesce(1).write.mode("append").parquet(folder)
    checkpoint = str(tmp_path / "checkpoint")
    for _ in range(2):
        # The second run finds nothing new and changes nothing.
        source = stream_pages(spark, folder, files_per_trigger=1)
        start_ingest(source, BatchIngest(store), checkpoint).awaitTermination()
    assert store.versions() == [0, 1, 2]
    other = ListingSnapshots(spark, str(tmp_path / "other"), buckets=4)
    run(spark, other, ad_pages, 0, *pages)
    assert state(store) == state(other) and len(state(store)) == 3


@pytest.mark.parametrize("pages_first", [False, True])
def test_pages_and_sightings_wait_for_each_other(spark, store, pages_first):
    sighted = [[result_page(1, 0, 1, 2)], [result_page(2, 1, 5, 1)], [result_page(3, 2, 2)]]
    pages = [[AD_PAGES[0], AD_PAGES[1]], [AD_PAGES[3]], []]
    batches = [*zip(pages, sighted)] if pages_first else [*zip([[], *pages[:2]], sighted)]
    rows = [a for a, _ in batches], [b for _, b in batches]
    order = [rows[0][0], *[b + a for a, b in zip(rows[0][1:], rows[1])], rows[1][2]] if pages_first else [b + a for a, b in batches]
    for version, batch in enumerate(order):
        BatchIngest(store)(spark.createDataFrame(batch, RESULT_PAGES), version)
    assert state(store) == {
        1: ("/auto-oglasi/1/p1", "/auto-oglasi/1/p2", 0, 1),
        2: ("/auto-oglasi/2/p1", "/auto-oglasi/2/p3", 0, 2),
        5: ("/auto-oglasi/5/p2", None, 1, 1),
    }
    quarantined = [spark.read.parquet(f"{store.path}/quarantine/v={v}").count() for v in range(len(order))]
    assert quarantined == [0] * len(order)


def test_waiting_ends(spark, store):
    for version, at in enumerate([0, 4, 9]):
        BatchIngest(store)(spark.createDataFrame([result_page(version, at, *([7] if at == 0 else [1])), AD_PAGES[0]], RESULT_PAGES), version)
    failed = [[(r.url, r.parse_error) for r in spark.read.parquet(f"{store.path}/quarantine/v={v}").collect()] for v in range(3)]
    assert failed == [[], [], [("/auto-oglasi/7/p0", ["ad_page"])]]
    assert list(state(store)) == [1]


def test_a_page_from_the_future_is_set_aside(spark, store, ad_pages):
    ahead = (datetime.now() - DAY0).days + 30
    run(spark, store, ad_pages, 0, result_page(1, 0, 1), result_page(2, ahead, 2))
    assert list(state(store)) == [1]
    assert spark.read.parquet(f"{store.path}/quarantine/v=0").first().parse_error == ["seen_at"]


def test_features_are_stored_as_codes_that_facets_find(spark, store, ad_pages):
    lookups = spark.createDataFrame([("safety", "ABS", "abs"), ("details", "Garažiran", "garage")], "domain string, key string, value string")
    work = BatchIngest(store, details=details_from(ad_pages), lookups=lookups)
    work(spark.createDataFrame([result_page(1, 0, 1)], RESULT_PAGES), 0)
    row = store.read().first()
    assert (row.safety, row.options, row.details) == (["abs", None], [], ["garage"])
    assert store.read().where(facet_filter("?abs=1", lookups)).count() == 1


def test_refreshed_rows_keep_their_record(spark, store, ad_pages):
    run(spark, store, ad_pages, 0, result_page(1, 0, 1))
    first = store.read().first()
    run(spark, store, ad_pages, 1, result_page(2, 1, 1))
    second = store.read().first()
    changed = {f for f in first.asDict() if first[f] != second[f]}
    assert changed == {"ad_link", "updatedAt"}
    assert (second.make, second.price, second.safety) == ("Mercedes Benz", 8500, ["ABS", "Nepoznato"])


def test_state_is_compacted_and_every_version_can_be_read(spark, tmp_path, ad_pages):
    store = ListingSnapshots(spark, str(tmp_path / "compacted"), buckets=4, compact_every=2)
    plain = ListingSnapshots(spark, str(tmp_path / "plain"), buckets=4)
    pages = [result_page(1, 0, 1, 2), result_page(2, 1, 5), result_page(3, 2, 1), result_page(4, 9, 3, 1)]
    for version, page in enumerate(pages):
        for to in (store, plain):
            run(spark, to, ad_pages, version, page)
        assert state(store) == state(plain)
    assert (store.state().base, store.state().changes) == (3, ())
    assert plain.state().changes == (0, 1, 2, 3)
    assert [store.read(before=v).count() for v in range(5)] == [0, 2, 3, 3, 2]
    # Ads 2 and 5 expired; a compacted base has left them out.
    assert (store.read(live_only=False).count(), plain.read(live_only=False).count()) == (2, 4)


def test_a_batch_with_two_rows_of_a_key_is_refused(spark, store, ad_pages):
    run(spark, store, ad_pages, 0, result_page(1, 0, 1))
    twice = store.read().unionAll(store.read())
    with pytest.raises(ValueError, match="2 rows of ad_number 1"):
        store.commit(1, twice, None)
    assert store.versions() == [0] and len(state(store)) == 1


def test_a_batch_writes_its_own_ad_pages_only(spark, store):
    for version, batch in enumerate([[AD_PAGES[0]], [AD_PAGES[1], result_page(1, 1, 1)], [result_page(2, 2, 2)]]):
        BatchIngest(store)(spark.createDataFrame(batch, RESULT_PAGES), version)
    written = spark.read.parquet(f"{store.path}/ad_pages").select("v", "ad_number").collect()
    assert sorted(tuple(r) for r in written) == [(0, 1), (1, 2)]
    assert sorted(state(store)) == [1, 2]


def test_ad_pages_by_bucket_are_pruned(spark, ad_pages, tmp_path):
    I.bucketed_ad_pages(ad_pages, 64).write.partitionBy("bucket").parquet(f"{tmp_path}/pages")
    table = spark.read.parquet(f"{tmp_path}/pages")
    wanted = spark.createDataFrame([(1,), (77,)], "ad_number long")
    rows = I.ad_page_details(table, wanted, buckets=64)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("dynamicpruning" in line for line in scans), plan
    assert [(r.sighted_number, r.page_id) for r in rows.collect()] == [(1, 1001)]


@pytest.mark.parametrize("limit", [10, 0])
def test_only_wanted_pages_are_parsed(spark, ad_pages, monkeypatch, limit):
    # With and without a broadcast of the wanted ads.
    monkeypatch.setattr(I, "MAX_KEY_ROWS", limit)
    newer = ad_pages.where("page_id = 1001").withColumn("page_id", F.lit(5000).cast("long"))
    wanted = spark.createDataFrame([(1,), (77,)], "ad_number long")
    rows = I.ad_page_details(ad_pages.unionByName(newer), wanted).collect()
    assert [(r.sighted_number, r.page_id) for r in rows] == [(1, 5000)]


def counted(page, to, total):
    """A result page with its counter."""
    counter = f"<h1 class='uk-h1 js-hide-on-filter'>x</h1><small>Prikazano 1 do {to} od ukupno {total}</small>"
    return (*page[:3], counter + page[3], page[4])


RUN_PAGES = [
    counted(result_page(1, 0, 5), 1, 9), counted(result_page(2, 0, 1), 2, 9), counted(result_page(3, 0, 4, 1), 4, 9),
    counted(result_page(4, 0, 2), 9, 9), counted(result_page(5, 0, 3), 9, 9),
]


def test_a_run_starts_at_its_page_and_ends_at_the_last_one(spark, store, ad_pages):
    # Nothing of the first batch is in the run, and the last batch has a page too many.
    split = [1, 2, 2]
    work, at = BatchIngest(store, details=details_from(ad_pages), run=PageRun("a", start_page=2)), 0
    for version, size in enumerate(split):
        work(spark.createDataFrame(RUN_PAGES[at : at + size], RESULT_PAGES), version)
        at += size
    assert sorted(state(store)) == [1, 2] and work.run_is_over()
    expected = {"run": "a", "last_page": 4, "pages": 3, "attempted": 3, "inserted": 2, "refreshed": 1, "failed": 1, "total_ads": 9}
    assert work.run_totals().first().asDict() == expected
    # A batch that is done again counts once; another run begins anew over the same listings.
    work(spark.createDataFrame(RUN_PAGES[at - split[-1] :], RESULT_PAGES), len(split) - 1)
    assert work.run_totals().first().asDict() == expected
    other = BatchIngest(store, details=details_from(ad_pages), run=PageRun("b", max_pages=1))
    assert not other.run_is_over(look=True) and other.run_totals().first()["pages"] == 0
    other(spark.createDataFrame(RUN_PAGES, RESULT_PAGES), len(split))
    assert sorted(state(store)) == [1, 2, 5] and other.run_is_over()
    assert (other.run_totals().first()["pages"], other.run_totals().first()["last_page"]) == (1, None)


def test_a_running_stream_stops_at_the_last_page(spark, store, ad_pages, tmp_path):
    folder = str(tmp_path / "run-pages")
    spark.createDataFrame(RUN_PAGES[:4], RESULT_PAGES).coalesce(1).write.parquet(folder)
    work = BatchIngest(store, details=details_from(ad_pages), run=PageRun(start_page=2))
    query = start_ingest(stream_pages(spark, folder), work, str(tmp_path / "run-checkpoint"), available_now=False)
    totals = await_run(query, work).first()
    assert not query.isActive and (totals["last_page"], totals["pages"]) == (4, 3)
