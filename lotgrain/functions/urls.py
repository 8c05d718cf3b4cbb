"""URL parts, query parameters and link building as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotgrain.functions.text import whole_number

# Fixed value: the path segment that carries the ad number.
AD_NUMBER_PATTERN = r"/auto-oglasi/(\d+)/"

# Generic URI split of RFC 3986, appendix B; it takes relative links and never fails.
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_path(url: Column) -> Column:
    """Path only: scheme, host, ``;parameters`` of the last segment, query and fragment go."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")


def url_query(url: Column) -> Column:
    """Query text, empty when there is none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def ad_number(url: Column, pattern: str = AD_NUMBER_PATTERN) -> Column:
    return whole_number(F.regexp_extract(url, pattern, 1), "bigint")


def _decoded(part: Column) -> Column:
    """Percent-decoding that leaves a malformed escape as it is written."""
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def query_pairs(url: Column) -> Column:
    """``array<struct<k,v>>`` in the order written; pairs without a value are left out."""
    pairs = F.filter(F.split(url_query(url), "&"), lambda p: p.rlike(r"^[^=]*=[\s\S]"))
    return F.transform(
        pairs,
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            _decoded(F.regexp_extract(p, r"^[^=]*=([\s\S]*)$", 1)).alias("v"),
        ),
    )


def values_of(pairs: Column, key: Column | str) -> Column:
    """All values of one key, in order."""
    wanted = F.lit(key) if isinstance(key, str) else key
    return F.transform(F.filter(pairs, lambda p: p["k"] == wanted), lambda p: p["v"])


def param_names(pairs: Column) -> Column:
    """Distinct keys by first appearance."""
    return F.array_distinct(F.transform(pairs, lambda p: p["k"]))


def query_params(url: Column) -> Column:
    """Map from key to ``struct<is_list, values>``.

    A key is a list when it ends in ``[]`` or is repeated, otherwise it is a scalar.
    """
    pairs = query_pairs(url)

    def entry(key: Column) -> Column:
        values = values_of(pairs, key)
        is_list = F.endswith(key, F.lit("[]")) | (F.size(values) > 1)
        return F.struct(key, F.struct(is_list.alias("is_list"), values.alias("values")))

    return F.map_from_entries(F.transform(param_names(pairs), entry))


def _encoded(part: Column) -> Column:
    """Form encoding; ``*`` is escaped and ``~`` is not."""
    java = F.url_encode(part)
    return F.replace(F.replace(java, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def with_query_param(url: Column, name: str, value: Column, drop: tuple[str, ...] = ()) -> Column:
    """Set one parameter, leave some out, and write the query anew.

    An existing parameter keeps its place, a new one goes last; repeats of a key gather at
    its first place, blank ones vanish, and the fragment stays.
    """
    pairs = F.filter(query_pairs(url), lambda p: ~p["k"].isin(*drop)) if drop else query_pairs(url)
    names = param_names(pairs)
    names = F.when(F.array_contains(names, name), names).otherwise(
        F.concat(names, F.array(F.lit(name)))
    )
    new_value = F.array(value.cast("string"))

    def rewritten(key: Column) -> Column:
        values = F.when(key == name, new_value).otherwise(values_of(pairs, key))
        return F.array_join(
            F.transform(values, lambda v: F.concat(_encoded(key), F.lit("="), _encoded(v))), "&"
        )

    fragment = F.regexp_extract(url, r"#([\s\S]+)$", 1)
    return F.concat(
        F.regexp_extract(url, r"^([^?#]*)", 1),
        F.lit("?"),
        F.array_join(F.transform(names, rewritten), "&"),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def with_page_number(url: Column, page_no: Column) -> Column:
    """Address of a given result page; the ``tag`` parameter goes."""
    return with_query_param(url, "page", page_no, drop=("tag",))


def make_filters(json_text: Column) -> Column:
    """JSON object of arrays as a map; text that is not such an object gives null."""
    return F.from_json(json_text, "map<string,array<string>>")


def absolute_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base), path)
