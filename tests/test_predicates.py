import pytest

from lotgrain.operators import predicates as P
from lotgrain.operators.facets import FacetLookup, facet_conditions, facet_filter, search_params, snake_name

ROWS = [("A", "X"), ("A", "Y"), ("B", "X"), ("B", "Z"), (None, "X"), ("C", None)]


@pytest.fixture(scope="module")
def cars(spark):
    return spark.createDataFrame(ROWS, "make string, model string").cache()


def kept(df, condition):
    rows = df.where(condition).collect()
    return sorted([tuple(r) for r in rows], key=str)


def expect(*rows):
    return sorted(rows, key=str)


def test_exclude_with_models_drops_the_make_and_those_models(cars):
    assert kept(cars, P.exclude_makes({"a": ["x"]})) == expect(("B", "Z"), ("C", None))


def test_exclude_make_keeps_rows_without_make(cars):
    expected = expect(("B", "X"), ("B", "Z"), (None, "X"), ("C", None))
    assert kept(cars, P.exclude_makes({"a": None})) == expected


def test_include(cars):
    assert kept(cars, P.include_makes({"a": ["x"], "c": None})) == expect(("A", "X"), ("C", None))
    assert P.include_makes({"": ["x"], None: None}) is None


def test_ranges(spark):
    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "price int")
    assert kept(df, P.in_range("price", "5", " 9 ")) == [(5,), (9,)]
    assert kept(df, P.in_range("price", "+5")) == [(5,), (9,)]
    assert kept(df, P.in_range("price", 9, 5)) == []
    assert kept(df, P.in_range("price", "0")) == [(1,), (5,), (9,)]
    for bounds in [("abc", "9"), ("8000.5", None), (None, None), (0, None), ("", "")]:
        assert P.in_range("price", *bounds) is None
    with pytest.raises(ValueError, match="price"):
        P.in_range("price", ["1", "2"])


def test_one_of_with_none_matches_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert kept(df, P.one_of("v", ["a", None])) == expect(("a",), (None,))
    assert kept(df, P.one_of("v", [None])) == [(None,)]
    assert P.one_of("v", []) is None


def test_all_of(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, ["a", "b"]), (3, None), (4, [])], "i int, v array<string>")
    assert [r.i for r in df.where(P.all_of("v", ["a", "b"])).collect()] == [2]


def test_no_condition_keeps_all(cars):
    assert cars.where(P.all_active([None, None])).count() == len(ROWS)


def test_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("Bmw", "X1", 5)], "make string, model string, price int").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    wanted = P.all_active(
        [P.in_range("price", 1, 9), P.exclude_makes({"audi": ["a4"]}), P.include_makes({"bmw": ["x1"]})]
    )
    plan = spark.read.parquet(path).where(wanted)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1].split("\n")[0]
    for part in ("GreaterThanOrEqual(price,1)", "LessThanOrEqual(price,9)", "EqualTo(make,Bmw)"):
        assert part in pushed


# ------------------------------------------------------------------------ facets

# Invented rows: domain, key, value.
LOOKUPS = [
    ("fuel_type", "1", "Petrol"),
    ("fuel_type", "2", "Diesel"),
    ("damage", "7", "None"),
    ("steering_side", "3", "Left"),
    ("safety", "Anti-lock", "abs"),
    ("options", "Phone link", "apple_car_play"),
    ("options", "Phone link old", "apple_car_play"),
]


@pytest.fixture(scope="module")
def lookups(spark):
    return spark.createDataFrame(LOOKUPS, "domain string, key string, value string").cache()


@pytest.fixture(scope="module")
def listings(spark):
    rows = [
        (1, "Bmw", "X1", "Petrol", None, "Left", ["abs"], []),
        (2, "Bmw", "X5", "Diesel", "None", "Right", [None], ["apple_car_play"]),
        (3, "Audi", "A4", None, "Bad", None, None, None),
    ]
    return spark.createDataFrame(
        rows,
        "ad_number int, make string, model string, fuel_type string, damage string, steering_side string,"
        "safety array<string>, options array<string>",
    ).cache()


@pytest.mark.parametrize(
    "url, expected",
    [
        (None, [1, 2, 3]),
        ("?fuel%5B%5D=1&fuel%5B%5D=2", [1, 2]),
        ("?fuel%5B%5D=1&fuel%5B%5D=9999", [1, 3]),
        ("?damaged%5B%5D=9999", [1]),
        ("?wheel_side=3", [1]),
        ("?wheel_side=9999", [1, 2, 3]),
        ("?abs=0", [1]),
        ("?abs=", [1, 2, 3]),
        ("?appleCarPlay=1", [2]),
        ("?brand=bmw&brand2=bmw&model%5B%5D=x1&model2%5B%5D=x5", [2]),
        ("?brand=bmw&model%5B%5D=x1&brand2=audi", [1, 3]),
        ("?brand=bmw&city=9&doors=3", [1, 2]),
    ],
)
def test_search_addresses(listings, lookups, url, expected):
    rows = listings.where(facet_filter(url, lookups)).collect()
    assert sorted(r.ad_number for r in rows) == expected


def test_json_filters_and_precedence(listings, lookups):
    rows = listings.where(facet_filter("?brand=bmw&model%5B%5D=x1", lookups, '{"bmw": ["x5"]}', "{}")).collect()
    assert [r.ad_number for r in rows] == [1]
    rows = listings.where(facet_filter(None, lookups, exclude='{"bmw": []}')).collect()
    assert [r.ad_number for r in rows] == [3]


@pytest.mark.parametrize(
    "url, name",
    [("?fuel[]=x", "fuel_type"), ("?wheel_side=1&wheel_side=2", "steering_side"), ("?brand=a&brand=b", "brand"),
     ("?price_from=1&price_from=2", "price")],
)
def test_bad_codes_are_errors_that_name_the_facet(url, name):
    with pytest.raises(ValueError, match=name):
        facet_filter(url)


def test_seventeen_facets():
    # Make and model filters are one facet with an include and an exclude part.
    assert len(facet_conditions({}, FacetLookup.empty())) == 18


def test_params_and_names():
    url = "https://x/s?price_from=&price_to=8000&fuel%5B%5D=45&q=1&q=2#a"
    assert search_params(url) == {"price_to": "8000", "fuel[]": ["45"], "q": ["1", "2"]}
    assert [snake_name(n) for n in ("appleCarPlay", "ABS", "Foo_Bar")] == ["apple_car_play", "a_b_s", "Foo_Bar"]
