import time

import pytest
from pyspark.sql import functions as F

from lotgrain.functions import markup as M
from lotgrain.functions import text as X
from lotgrain.functions import urls as U
from lotgrain.plans.extraction import counter_numbers


def values(spark, inputs, expression):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, s string")
    return [r.v for r in df.select("i", expression(F.col("s")).alias("v")).orderBy("i").collect()]


CASES = [
    (
        X.normalize_name,
        {
            "mercedes-benz": "Mercedes Benz", "BMW": "Bmw", "3-series": "3 Series", "golf  gti": "Golf  Gti",
            "škoda": "Škoda", " bmw": " Bmw", "": "",
        },
    ),
    (X.dotted_int, {"8.500 €": 8500, "8.500 €": 8500, "  123.456 km": 123456, "Po dogovoru": None, "": None}),
    (X.year_number, {"2015.": 2015, " 2015 ": 2015, "x": None}),
    (X.capacity_number, {"1968 cm3": 1968, "2 l": None, "1968": None, " 1968 cm3 ": 1968, "a cm3": None}),
    (X.power_number, {"110/150 (kW/KS)": 110, " 77 / 1": 77, "x/1": None}),
    (X.optional_int_is_bad, {"300": False, " 300 ": False, "": False, "a": True}),
    (X.strip_text, {"\n a b  ": "a b".replace(" ", " "), "": ""}),
    (X.snake_case, {"appleCarPlay": "apple_car_play", "ABS": "a_b_s", "Foo_Bar": "Foo_Bar", "abs": "abs"}),
    (
        U.url_path,
        {
            "/auto-oglasi/123/abc?attp=1": "/auto-oglasi/123/abc", "https://h.x/p/a;v=1?q#f": "/p/a",
            "https://h.x": "", "?q=1": "", "a b/c": "a b/c",
        },
    ),
    (U.ad_number, {"/auto-oglasi/123/abc": 123, "/auto-oglasi/123": None, "/x/1/": None}),
    (
        lambda c: U.with_page_number(c, F.lit(9)),
        {
            "?page=2&ref=x": "?page=9&ref=x", "?tag=t&a=&b=1&b=2#top": "?b=1&b=2&page=9#top",
            "https://h/x": "https://h/x?page=9", "?b=1&c=2&b=3&page=": "?b=1&b=3&c=2&page=9",
            "?fuel%5B%5D=4&q=a+b~*": "?fuel%5B%5D=4&q=a+b~%2A&page=9",
        },
    ),
    (
        M.decode_entities,
        {
            "a &amp; b": "a & b", "&scaron;&#353;&#x161;": "ššš", "&nope; & &;": "&nope; & &;", "": "",
            "&#2;&#128512;": "&#2;😀",
        },
    ),
]


@pytest.mark.parametrize("expression, cases", CASES)
def test_cases(spark, expression, cases):
    assert values(spark, list(cases), expression) == list(cases.values())


def test_absent_capacity_is_zero(spark):
    assert values(spark, [None], X.capacity_number) == [0]


def test_normalize_name_is_idempotent(spark):
    names = ["mercedes-benz", "a--b", "ßa x", "ALFA romeo-GTV"]
    once = values(spark, names, X.normalize_name)
    assert values(spark, once, X.normalize_name) == once


def test_query_params(spark):
    url = "/s?price_from=&price_to=8000&fuel%5B%5D=45&fuel%5B%5D=2309&chassis%5B%5D=1&q=1&q=2&bad=%zz&novalue#f=1"
    (found,) = values(spark, [url], U.query_params)
    assert {k: (p.is_list, p["values"]) for k, p in found.items()} == {
        "price_to": (False, ["8000"]),
        "fuel[]": (True, ["45", "2309"]),
        "chassis[]": (True, ["1"]),
        "q": (True, ["1", "2"]),
        "bad": (False, ["%zz"]),
    }


def test_make_filters(spark):
    found = values(spark, ['{"bmw": ["x1"], "audi": null}', "{}", "no"], U.make_filters)
    assert found == [{"bmw": ["x1"], "audi": None}, {}, None]


def test_compact_strings(spark):
    df = spark.sql("select array('a', null, 'b') as v union all select null")
    assert sorted(r.v for r in df.select(X.compact_strings(F.col("v")).alias("v")).collect()) == [[], ["a", "b"]]


def test_counter_numbers(spark):
    first, last = values(spark, ["1 do 25 od 1.234", "26 do 30 od ukupno 30"], counter_numbers)
    assert first.asDict() == {"from_ad": 1, "to_ad": 25, "raw_total": 1, "total": 1234, "is_last": False}
    assert last.is_last


def test_blocks(spark):
    html = "<p>L</p><div a='>'>x<div>y</div>z</div><div>w</div><p>U</p><div>never closed"
    outlined = lambda c: M.outline(M.visible_markup(c))
    assert values(spark, [html], lambda c: M.plain_text(M.block_after(outlined(c), M.exact_text("L")))) == ["xyz"]
    assert values(spark, [html], lambda c: M.plain_text(M.block_after(outlined(c), M.exact_text("U")))) == ["never closed"]
    assert values(spark, [html], lambda c: M.block_after(outlined(c), M.exact_text("nope"))) == [None]
    deep = "<p>L</p>" + "<div>" * 1_500 + "x" + "</div>" * 1_500 + "<div>y</div>"
    assert values(spark, [deep], lambda c: M.plain_text(M.block_after(outlined(c), "L"))) == ["x"]


def test_attributes(spark):
    tags = ["<a href='x&amp;y' data-class=\"no\">", '<a class=" b  a ">', "<a CLASS=a>", "<a>"]
    assert values(spark, tags, lambda c: M.attribute(c, "href")) == ["x&y", None, None, None]
    assert values(spark, tags, M.class_text) == ["", "b a", "a", ""]


@pytest.mark.parametrize("depth", [1, 5, 59, 60, 61, 70, 5000])
@pytest.mark.parametrize("closed", [True, False])
def test_the_first_mention_of_a_label_wins(spark, depth, closed):
    first = "<div>" * depth + "FIRST" + "</div>" * (depth if closed else depth - 1)
    html = f"<p>L</p><b>x</b>{first}<p>L</p><div>SECOND</div>"
    want = "FIRST" if closed else "FIRSTLSECOND"
    for pattern in (M.exact_text("L"), M.text_with("L")):
        assert values(spark, [html], lambda c: M.plain_text(M.block_after(M.outline(c), pattern))) == [want]


@pytest.mark.parametrize("html", [
    "<p>L</p><div>x</div>", "<div>L</div><div>x", "<p>L y</p><p>L</p>z<div>a<div>b</div>c</div>d", "<p>L</p>", "", "no tag L", "L<div>x</div>", None,
    "<b>ž</b><p>L</p><div><b>š</b></div><p>L</p><div>y</div>", "<p>L</p><div>" + "<div>" * 80 + "x" + "</div>" * 80 + "w</div>v", "<p>L</p></div><div></div>",
])
def test_labels_found_by_comparison_as_by_expression(spark, html):
    def exact(c):
        o = M.outline(c)
        return F.struct(M.block_after(o, M.exact_text("L")), M.block_at(M.from_block(M.after_text(o, M.same_marks(o), "L"))))

    def part(c):
        o = M.outline(c)
        return F.struct(M.block_after(o, M.text_with("L")), M.block_at(M.from_block(M.after_text_with(o, "L"))))

    for look_up in (exact, part):
        (found,) = values(spark, [html], look_up)
        assert found[0] == found[1]


def test_dropped_markup_is_looked_for_where_it_can_begin(spark):
    html = "a<!-- <b> -->b<SCRIPT x>1</script >c<style>d</STYLE>e<!doctype h>f<scripts>g</b>h<!-- open"
    assert values(spark, [html, "x<", "<", None], M.visible_markup) == ["abcef<scripts>g</b>h", "x<", "<", None]
    assert M._DROPPED.startswith("(?is)(?=<[!s])")


def test_a_first_mention_without_a_block_gives_way(spark):
    assert values(spark, ["<p>L</p>"], lambda c: M.block_after(M.outline(c), M.exact_text("L"))) == [None]
    assert values(spark, ["<div><p>L</p></div><p>L</p><div>x</div>"], lambda c: M.plain_text(M.block_after(M.outline(c), M.exact_text("L")))) == ["x"]


@pytest.mark.parametrize("open_first", [True, False])
def test_many_marked_blocks_one_of_them_open(spark, open_first):
    mark = M.SPARE[0]
    open_one = "<div class='f'>open"
    each = "<div class='f'><div>a</div></div>" * 20_000
    html = open_one + each if open_first else each + open_one
    marked = {mark + M.OPEN: M.tag_pattern("div", M.needs_class("f"))}
    began = time.monotonic()
    found = values(spark, [html], lambda c: M.marked_blocks(M.outline(c, marked), mark))[0]
    assert time.monotonic() - began < 30
    assert len(found) == 20_001
    texts = [x.translate({ord(m): None for m in "\x01\x02\x03\x04"}) for x in found]
    assert sorted(set(texts), key=len) == (["a", "open" + "a" * 20_000] if open_first else ["a", "open"])
