import pytest

from lotgrain.plans import extraction as E
from lotgrain.sources import pages as PG

HEAD = '<span class="priceClassified regular">8.500&nbsp;&euro;</span>'
BASIC = {
    "Marka": "mercedes-benz", "Model": "a <b>klasa</b>", "Stanje:": " Polovno ", "Godi&scaron;te": "2015.",
    "Kilometraža": "123.456 km", "Karoserija": "Limuzina", "Gorivo": "Dizel", "Kubikaža": "1968 cm3",
    "Snaga motora": "110/150 (kW/KS)", "Fiksna cena": "DA", "Zamena:": "NE", "Broj oglasa:": "<i>123</i>",
}
INFO = {
    "Pogon": "Prednji", "Menjač": "Manuelni", "Broj sedišta": "5", "Strana volana": "Levi",
    "Klima": "Auto<div>matska</div>", "Boja": "Bela", "Poreklo vozila": "D", "Oštećenje": "Nije",
}
FEATURES = {"Sigurnost": ["ABS", " Nepoznato "], "Stanje": ["Gara&#382;iran"]}


def ad_page(basic=None, info=None, head=HEAD, features=None, tail="</div></body>"):
    pair = "<div><span>{}</span><div>{}</div></div>".format
    return (
        f"<html>{head}<!-- <div>Marka</div> --><script>'<div>Model</div>'</script>"
        "<div id='classified-content' class='uk classified-content'>"
        "<section class='a js_fixedContetLoad'>"
        + "".join(f"<p>{k}</p><div>{v}</div>" for k, v in {**BASIC, **(basic or {})}.items() if v is not None)
        + "</section><section><h2>Dodatne informacije </h2><div>"
        + "".join(pair(k, v) for k, v in {**INFO, **(info or {})}.items() if v is not None)
        + "</div></section>"
        + "".join(
            f"<h2>{k}</h2><div>" + "".join(f"<div class='x uk-width-medium-1-4'>{v}</div>" for v in vs) + "</div>"
            for k, vs in (FEATURES if features is None else features).items()
        )
        + tail
    )


VARIANTS = [
    (dict(), []),
    (dict(basic={"Kubikaža": None}), []),
    (dict(basic={"Kubikaža": "2 l"}), ["engine_capacity"]),
    (dict(basic={"Kubikaža": "1968"}), ["engine_capacity"]),
    (dict(basic={"Godi&scaron;te": "uskoro", "Gorivo": None}), ["year", "fuel_type"]),
    (dict(head="<span class='priceClassified x'>Po dogovoru</span>"), ["price"]),
    (dict(head="<span class='priceClassified'>8.500</span>"), ["price"]),
    (dict(info={"Pogon": None, "Pogon: ": "x"}), ["drive"]),
    (dict(info={"Domet sa punom baterijom (km)": "300"}), []),
    (dict(info={"Domet sa punom baterijom (km)": "tri"}), ["battery_range"]),
    (dict(tail=""), None),
    (dict(features={}), []),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, f"/auto-oglasi/{i}/x", ad_page(**v)) for i, (v, _) in enumerate(VARIANTS)]
    rows.append((99, "/", "<p>not an ad</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in E.ad_page_listings(pages).collect()}


def test_a_whole_record(parsed):
    r = parsed[0]
    assert (r.make, r.model, r.year, r.mileage, r.price) == ("Mercedes Benz", "A Klasa", 2015, 123456, 8500)
    assert (r.engine_capacity, r.engine_power, r.ad_number, r.condition) == (1968, 110, 123, "Polovno")
    assert (r.climate_control, r.seats, r.doors, r.battery_range) == ("Automatska", "5", None, None)
    assert (r.safety, r.options, r.details) == (["ABS", "Nepoznato"], [], ["Garažiran"])


def test_errors_are_data(parsed):
    for i, (_, expected) in enumerate(VARIANTS):
        if expected is not None:
            assert parsed[i].parse_error == expected, i
    # A content block that never closes ends with the page.
    assert parsed[10].parse_error == [] and parsed[10].details == ["Garažiran"]
    assert parsed[99].parse_error[0] == "content"


def test_a_label_without_a_block_is_no_missing_label(spark):
    html = ad_page(basic={"Kubikaža": None}).replace("</section>", "<p>Kubikaža</p></section>", 1)
    row = E.ad_page_listings(spark.createDataFrame([(1, "/", html)], "page_id long, url string, html string")).first()
    assert row.parse_error == ["engine_capacity"]


def test_optional_fields(parsed):
    assert parsed[1].engine_capacity == 0
    assert parsed[8].battery_range == 300
    assert (parsed[11].safety, parsed[11].details) == ([], [])


def test_condition_list_can_be_read_by_its_first_mention(spark):
    pages = spark.createDataFrame([(1, "/", ad_page())], "page_id long, url string, html string")
    assert E.ad_page_listings(pages, details_after_basics=False).first().details == []


RESULT_PAGE = """
<h1 class="a js-hide-on-filter">x</h1><div><small>Prikazano 1 do 25 od <b>1.234</b></small><small>9</small></div>
<article class="classified  ad-77 x"><a class="q" href="/no"></a>
  <a data-t="a > b" class="firstImage t" href="/auto-oglasi/77/abc?attp=1&amp;x=2"><img class="lazy lead" data-srcset="i.jpg 1x"></a></article>
<article class="classified ad-78 uk-hidden"><a class="firstImage" href="/auto-oglasi/78/abc"></a></article>
<article class="classified ad-79"><p>none</p></article>
<article class="other"><a class="firstImage" href="/auto-oglasi/80/abc"></a></article>
<article class="classified ad-81"><a href="/auto-oglasi/81/z" class=firstImage></a><img class="lazy lead" data-srcset="out"></article>
<article class="classified ad-82"><a class="firstImage" href="/other/82"></a>
"""


def test_result_page(spark):
    pages = spark.createDataFrame([(1, "u", RESULT_PAGE)], "page_id long, url string, html string")
    good, bad = E.split_quarantine(E.page_ads(pages))
    assert [tuple(r)[2:] for r in good.orderBy("seq").collect()] == [
        (0, 77, "/auto-oglasi/77/abc", "i.jpg 1x"), (4, 81, "/auto-oglasi/81/z", None),
    ]
    assert [(r.seq, r.parse_error) for r in bad.orderBy("seq").collect()] == [(2, ["link_tag"]), (5, ["ad_number"])]
    counter = E.page_counter(pages).first()
    assert (counter.from_ad, counter.to_ad, counter.raw_total, counter.total, counter.is_last) == (1, 25, 1, 1234, False)


def test_page_window(spark):
    rows = [("a", n, n == 3) for n in range(1, 6)] + [("b", n, None) for n in range(1, 4)] + [(None, n, n == 2) for n in (2, 3)]
    pages = spark.createDataFrame(rows, "run_id string, page_no int, is_last boolean")
    kept = PG.until_last_page(pages.where(PG.page_window(2)))
    assert sorted((str(r.run_id), r.page_no) for r in kept.collect()) == [("None", 2), ("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    assert pages.where(PG.page_window(2, 1)).count() == 3


def test_one_pass_over_the_pages(spark):
    pages = spark.createDataFrame([(1, "/", ad_page())], "page_id long, url string, html string")
    good, _ = E.split_quarantine(E.ad_page_listings(pages))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange" not in plan and plan.count("<script") == 1


def test_hostile_pages_are_read_or_set_aside(spark):
    many = " ".join(f'a{i}="v{i}"' for i in range(100_000))
    huge = "x " * 2_000_000
    pages = {
        0: f"<article class='classified ad-1'><a {many} class='firstImage' href='/auto-oglasi/5/x'></a></article>",
        1: f"<article class='classified ad-1'><a title='{huge}' class='firstImage' href='/auto-oglasi/6/x'></a></article>",
        2: "<!--" * 40_000,
        3: "<article " * 40_000,
        4: "<script>" * 40_000 + "<!" * 40_000,
        5: "<article class='classified ad-1'><a class='firstImage' " + "<a " * 40_000,
    }
    rows = spark.createDataFrame([(i, "u", h) for i, h in pages.items()], "page_id long, url string, html string")
    found = {r.page_id: r.ad_number for r in E.page_ads(rows).where("ad_number is not null").collect()}
    assert found == {0: 5, 1: 6}
    assert E.page_counter(rows).count() == len(pages)
    bad = E.ad_page_listings(rows).collect()
    assert all(r.parse_error[0] == "content" for r in bad)


def test_blocks_of_any_depth_and_open_ones(spark):
    deep = "<div>" * 5_000 + "Prednji" + "</div>" * 5_000
    open_feature = "<div class='uk-width-medium-1-4'>Deep" + "<div>" * 300 + "er" + "</div>" * 300
    rows = [
        (0, "/", ad_page(info={"Pogon": deep})),
        (1, "/", ad_page(features={"Stanje": ["<div>" * 300 + "Garažiran" + "</div>" * 300, "Nov"]})),
        (2, "/", ad_page(tail="<h2>Oprema</h2><div>" + open_feature)),
    ]
    got = {r.page_id: r for r in E.ad_page_listings(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].parse_error for i in range(3)] == [[], [], []]
    assert got[0].drive == "Prednji"
    assert got[1].details == ["Garažiran", "Nov"]
    assert got[2].options == ["Deeper"]


def test_a_deep_first_block_is_not_passed_over(spark):
    deep = "<div>" * 70 + "Prednji" + "</div>" * 70
    row = (0, "/", ad_page(info={"Pogon": deep}).replace("</body>", "<p>Pogon</p><div>Zadnji</div></body>"))
    again = (1, "/", ad_page(info={"Pogon": deep}) + "<p>Pogon</p><div>Zadnji</div>")
    got = E.ad_page_listings(spark.createDataFrame([row, again], "page_id long, url string, html string")).collect()
    assert [(r.drive, r.parse_error) for r in got] == [("Prednji", [])] * 2
