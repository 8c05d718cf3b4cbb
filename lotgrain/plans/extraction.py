"""Raw pages to rows: ads on a result page, its counter, and the typed record of an ad page.

Every page is read on its own, in JVM expressions; nothing is shuffled. What cannot be read
becomes an entry of ``parse_error`` instead of a failed task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrain.functions import markup as M
from lotgrain.functions import text as X
from lotgrain.functions import urls as U

# --- Fixed values: labels, class names and patterns as the pages carry them. ---
BASIC_LABELS = {
    "make": "Marka",
    "model": "Model",
    "condition": "Stanje:",
    "year": "Godište",
    "mileage": "Kilometraža",
    "body_type": "Karoserija",
    "fuel_type": "Gorivo",
    "engine_capacity": "Kubikaža",
    "engine_power": "Snaga motora",
    "fixed_price": "Fiksna cena",
    "exchange": "Zamena:",
    "ad_number": "Broj oglasa:",
}
INFO_LABELS = {
    "drive": "Pogon",
    "transmission": "Menjač",
    "seats": "Broj sedišta",
    "steering_side": "Strana volana",
    "climate_control": "Klima",
    "color": "Boja",
    "origin": "Poreklo vozila",
    "damage": "Oštećenje",
}
OPTIONAL_INFO_LABELS = {
    "emission_class": "Emisiona klasa motora",
    "doors": "Broj vrata",
    "interior_material": "Materijal enterijera",
    "interior_color": "Boja enterijera",
    "registered_until": "Registrovan do",
    "import_country": "Zemlja uvoza",
    "sale_method": "Način prodaje",
    "battery_range": "Domet sa punom baterijom (km)",
}
FEATURE_LABELS = {"safety": "Sigurnost", "options": "Oprema", "details": "Stanje"}
INFO_BLOCK_LABEL = "Dodatne informacije"
CONTENT_NAME = "classified-content"
BASIC_SECTION_CLASS = "js_fixedContetLoad"
FEATURE_CLASS = "uk-width-medium-1-4"
PRICE_ATTRIBUTE = r"""class\s*=\s*["'][^"'<>]*priceClassified\s+[^\s"'][^"'<>]*["']"""
AD_CLASS = r"classified ad-\d+"
HIDDEN_CLASS = "uk-hidden"
LINK_CLASS = "firstImage"
IMAGE_CLASS = r"lazy\s+lead"
COUNTER_ANCHOR_CLASS = "js-hide-on-filter"
# --- End of fixed values. ---

_CONTENT_TAG = M.tag_pattern("div", M.needs_id(CONTENT_NAME), M.needs_class(CONTENT_NAME))
_FEATURE, _SECTION, _SECTION_END = M.SPARE[:3]
_AD_PAGE_TAGS = {
    _FEATURE + M.OPEN: M.tag_pattern("div", M.needs_class(FEATURE_CLASS)),
    _SECTION: M.tag_pattern("section", M.needs_class(BASIC_SECTION_CLASS)),
    _SECTION_END: r"(?i)</section\s*>",
}




def settled(rows: DataFrame, kept: list[str], columns: dict[str, Column]) -> DataFrame:
    """Keep some columns and add computed ones behind a one-row generator.

    Without it the optimizer would push a later filter down by writing the whole parse into
    it once per reference.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return rows.select(*kept, F.inline(F.array(made)))


# ---------------------------------------------------------------- result pages


def page_ads(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per visible ad of every result page, in page order.

    Keeps the other columns of ``pages`` and adds ``seq``, ``ad_number``, ``ad_link``,
    ``img_link`` and ``parse_error`` (empty for a usable ad).
    """
    kept = [c for c in pages.columns if c != html]
    blocks = F.regexp_extract_all(
        M.visible_markup(F.col(html)),
        F.lit(rf"(?is){M.tag_pattern('article')}.*?(?=<article\b|</article\b|\z)"),
        0,
    )
    rows = pages.select(*kept, F.posexplode(blocks).alias("seq", "_block"))
    classes = M.class_text(F.regexp_extract(F.col("_block"), f"^{M.tag_pattern('article')}", 0))
    rows = settled(rows, [*kept, "seq", "_block"], {"_class": classes}).where(
        F.col("_class").rlike(AD_CLASS) & ~F.contains("_class", F.lit(HIDDEN_CLASS))
    )
    anchors = F.regexp_extract_all("_block", F.lit(M.tag_pattern("a", M.needs_class(LINK_CLASS))), 0)
    rows = settled(rows, [*kept, "seq", "_block"], {"_anchor": F.get(anchors, F.lit(0))})
    # Only images inside the first such link count.
    link_body = F.regexp_extract(
        F.expr("substring(_block, locate(_anchor, _block))"), r"(?is)^(.*?)(</a\b|\z)", 1
    )
    image = F.regexp_extract(link_body, M.tag_pattern("img", M.needs_whole_class(IMAGE_CLASS)), 0)
    rows = settled(
        rows,
        [*kept, "seq", "_anchor"],
        {
            "ad_link": U.url_path(M.attribute(F.col("_anchor"), "href")),
            "img_link": M.attribute(image, "data-srcset"),
        },
    )
    number = U.ad_number(F.col("ad_link"))
    errors = F.array_compact(
        F.array(
            F.when(F.col("_anchor").isNull(), F.lit("link_tag")),
            F.when(F.col("_anchor").isNotNull() & F.col("ad_link").isNull(), F.lit("ad_link")),
            F.when(F.col("ad_link").isNotNull() & number.isNull(), F.lit("ad_number")),
        )
    )
    return rows.select(
        *kept,
        F.col("seq").cast("bigint").alias("seq"),
        number.alias("ad_number"),
        "ad_link",
        "img_link",
        errors.alias("parse_error"),
    )


def counter_numbers(counter_text: Column) -> Column:
    """``struct<from_ad,to_ad,raw_total,total,is_last>`` from a counter text.

    ``raw_total`` is the third run of digits as written, so a total with a thousands dot is cut
    at the dot; ``total`` takes such dots out first. ``is_last`` goes by ``total``.
    """

    def number(text: Column, index: int) -> Column:
        return F.get(F.regexp_extract_all(text, F.lit(r"\d+"), 0), F.lit(index)).try_cast("int")

    undotted = F.regexp_replace(counter_text, r"(?<=\d)\.(?=\d{3}(?!\d))", "")
    to_ad, total = number(undotted, 1), number(undotted, 2)
    return F.struct(
        number(undotted, 0).alias("from_ad"),
        to_ad.alias("to_ad"),
        number(counter_text, 2).alias("raw_total"),
        total.alias("total"),
        (to_ad == total).alias("is_last"),
    )


def page_counter(pages: DataFrame, html: str = "html") -> DataFrame:
    """Counter of every result page: first ``small`` after the anchor element."""
    shown = M.visible_markup(F.col(html))
    text = F.regexp_extract(
        shown,
        rf"(?is){M.tag_pattern('[a-z][a-z0-9]*+', M.needs_class(COUNTER_ANCHOR_CLASS))}"
        rf".*?(?:{M.tag_pattern('small')}(.*?)(?:</small\s*>|\z)|\z)",
        1,
    )
    kept = [c for c in pages.columns if c != html]
    counted = pages.select(*kept, M.inner_text(text).alias("counter_text"))
    return counted.withColumn("_n", counter_numbers(F.col("counter_text"))).select(
        *kept, "counter_text", "_n.*"
    )


# -------------------------------------------------------------------- ad pages


def _content_parts(pages: DataFrame, html: str) -> DataFrame:
    """Outlines of the content block, its basic section, what follows that, and the info block."""
    kept = [c for c in pages.columns if c != html]
    shown = settled(pages, kept, {"_shown": M.visible_markup(F.col(html))})
    price = F.regexp_extract(
        F.col("_shown"),
        rf"(?is){M.tag_pattern('span', PRICE_ATTRIBUTE)}(.*?)(?:</span|\z)",
        1,
    )
    outlined = settled(
        shown,
        kept,
        {
            "price_text": M.inner_text(price),
            # Head, navigation and the like in front of the content are not looked at further.
            "_outline": M.outline(
                F.regexp_extract("_shown", f"(?s){_CONTENT_TAG}.*", 0), _AD_PAGE_TAGS
            ),
        },
    )
    content = M.decode_entities(M.block_after(F.col("_outline"), "^"))
    cut = settled(outlined, [*kept, "price_text"], {"_content": content})
    whole = F.col("_content")
    behind = F.regexp_extract(
        whole, f"(?s){_SECTION}[^{_SECTION_END}]*+{_SECTION_END}(.*)", 1
    )
    return settled(
        cut,
        [*kept, "price_text", "_content"],
        {
            "_basic": F.regexp_extract(whole, f"{_SECTION}[^{_SECTION_END}]*+", 0),
            "_behind": F.when(behind != "", behind).otherwise(whole),
            "_info": M.block_after(whole, M.text_with(INFO_BLOCK_LABEL)),
        },
    )


def ad_page_texts(pages: DataFrame, html: str = "html", details_after_basics: bool = True) -> DataFrame:
    """Raw label texts and feature lists of every ad page, before any typing.

    Adds ``price_text``, one string per label, ``array<string>`` per feature list, and
    ``has_content``. The word that heads the condition list also occurs in the basic block;
    with ``details_after_basics`` the list is looked for behind that block only.
    """
    kept = [c for c in pages.columns if c != html]
    parts = _content_parts(pages, html)
    # Labels are looked up by plain comparisons, one step for all of them at a time.
    marked = settled(
        parts,
        [*kept, "price_text", "_content", "_basic", "_behind", "_info"],
        {"_basic_same": M.same_marks(F.col("_basic")), "_info_same": M.same_marks(F.col("_info"))},
    )
    behind = {n: "_behind" if n == "details" and details_after_basics else "_content" for n in FEATURE_LABELS}
    after = {
        **{n: M.after_text(F.col("_basic"), F.col("_basic_same"), v) for n, v in BASIC_LABELS.items()},
        **{n: M.after_text(F.col("_info"), F.col("_info_same"), v) for n, v in INFO_LABELS.items()},
        **{n: M.after_text_with(F.col("_info"), v) for n, v in OPTIONAL_INFO_LABELS.items()},
        **{n: M.after_text_with(F.col(behind[n]), v) for n, v in FEATURE_LABELS.items()},
    }
    # An ad without this label has no capacity; one whose label has no block cannot be read.
    shows_capacity = M.has_text(F.col("_basic_same"), BASIC_LABELS["engine_capacity"])
    found = settled(
        marked,
        [*kept, "price_text"],
        {
            **{f"_{n}": c for n, c in after.items()},
            "_shows_capacity": shows_capacity,
            "has_content": F.col("_content").isNotNull(),
        },
    )
    still = [*kept, "price_text", "_shows_capacity", "has_content"]
    found = settled(found, still, {f"_{n}": M.from_block(F.col(f"_{n}")) for n in after})
    unread = {"engine_capacity": F.when(F.col("_shows_capacity"), F.lit(""))}

    def text(name: str) -> Column:
        shown = M.plain_text(M.block_at(F.col(f"_{name}")))
        return F.coalesce(shown, unread[name]) if name in unread else shown

    def features(name: str) -> Column:
        blocks = M.marked_blocks(M.block_at(F.col(f"_{name}")), _FEATURE)
        shown = F.transform(blocks, lambda b: X.strip_text(M.plain_text(b)))
        return F.coalesce(shown, F.array().cast("array<string>"))

    return found.select(
        *kept,
        "price_text",
        *[text(n).alias(f"{n}_text") for n in (*BASIC_LABELS, *INFO_LABELS, *OPTIONAL_INFO_LABELS)],
        *[features(n).alias(n) for n in FEATURE_LABELS],
        "has_content",
    )


_TRIMMED_BASIC = ("condition", "body_type", "fuel_type", "fixed_price", "exchange")


def typed_listings(texts: DataFrame) -> DataFrame:
    """Label texts to typed columns; ``parse_error`` names every required field that failed."""
    made_here = {f"{n}_text" for n in (*BASIC_LABELS, *INFO_LABELS, *OPTIONAL_INFO_LABELS, "price")}
    made_here |= {*FEATURE_LABELS, "has_content"}
    kept = [c for c in texts.columns if c not in made_here]

    def raw(name: str) -> Column:
        return F.col(f"{name}_text")

    columns: dict[str, Column] = {
        "ad_number": X.whole_number(X.strip_text(raw("ad_number")), "bigint"),
        "make": X.normalize_name(raw("make")),
        "model": X.normalize_name(raw("model")),
        "year": X.year_number(raw("year")),
        "mileage": X.dotted_int(raw("mileage")),
        "engine_capacity": X.capacity_number(raw("engine_capacity")),
        "engine_power": X.power_number(raw("engine_power")),
        "price": X.dotted_int(raw("price")),
        **{n: X.strip_text(raw(n)) for n in _TRIMMED_BASIC},
        **{n: X.strip_text(raw(n)) for n in INFO_LABELS},
    }
    required = list(columns)
    columns.update(
        {n: X.strip_text(raw(n)) for n in OPTIONAL_INFO_LABELS if n != "battery_range"}
    )
    columns["battery_range"] = X.plain_int(raw("battery_range"))
    columns.update({n: F.col(n) for n in FEATURE_LABELS})

    columns["_bad_range"] = X.optional_int_is_bad(raw("battery_range"))
    typed = settled(texts, [*kept, "has_content"], columns)
    errors = F.array_compact(
        F.array(
            F.when(~F.col("has_content"), F.lit("content")),
            *[F.when(F.col(n).isNull(), F.lit(n)) for n in required],
            F.when(F.col("_bad_range"), F.lit("battery_range")),
        )
    )
    return typed.withColumn("parse_error", errors).drop("_bad_range", "has_content")


def ad_page_listings(pages: DataFrame, html: str = "html", **options) -> DataFrame:
    """Typed record of every ad page, good and bad ones alike (see ``split_quarantine``)."""
    return typed_listings(ad_page_texts(pages, html, **options))


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows without ``parse_error``, and the failed ones."""
    failed = F.size("parse_error") > 0
    return rows.where(~failed).drop("parse_error"), rows.where(failed)
