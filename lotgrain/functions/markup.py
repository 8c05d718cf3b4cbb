"""HTML reading as string expressions, evaluated in the JVM.

A page is first written as an outline: every tag shrinks to one control character, so what is
left is text in document order with marks between the text nodes. Opening and closing ``div``
tags keep marks of their own, other tags a caller cares about get further ones. Looking up a
label and the block after it is then one linear regular expression per label.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK, OPEN, CLOSE = "\u0001", "\u0002", "\u0003"
# Marks that callers may give to tags of their own choice.
SPARE = ("\u0004", "\u0005", "\u0006", "\u0007")
_MARKS = BREAK + OPEN + CLOSE + "".join(SPARE)
# Blocks that nest up to this deep are found by one expression; deeper ones are counted out.
QUICK_DEPTH = 60

# What does not end runs to the end of the page, so every character is read once.
# The look ahead passes over characters that begin nothing without trying every kind.
_DROPPED = r"(?is)(?=<[!s])(?:<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<![^>]*+(?:>|\z))"
_QUOTED = r"""(?:"[^"]*+"|'[^']*+')"""
# A tag starts with a letter; quoted attribute values may hold '>'. Loops are possessive: the
# JVM walks them without recursion, whatever the number of attributes.
_QUOTED_REST = rf"""[^<>"']*+(?:{_QUOTED}[^<>"']*+)*+>"""


def visible_markup(html: Column) -> Column:
    """Page text without comments, declarations, scripts and styles."""
    return F.regexp_replace(html, _DROPPED, "")


def tag_texts(html: Column, name: str) -> Column:
    """All opening tags of one name, attributes included."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b{_QUOTED_REST}"), 0)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, null when it has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    raw = F.get(F.regexp_extract_all(tag, F.lit(pattern), 1), F.lit(0))
    return decode_entities(F.regexp_replace(raw, r"""^["']|["']$""", ""))


def class_text(tag: Column) -> Column:
    """Class attribute with single spaces, empty when there is none."""
    spaced = F.trim(F.regexp_replace(attribute(tag, "class"), r"\s+", " "))
    return F.coalesce(spaced, F.lit(""))


def _entity_map() -> Column:
    """The named references of HTML 4 and ``&apos;``, taken from the standard library."""
    points = {**name2codepoint, "apos": 39}
    listed = ",".join(f"&{name};={chr(points[name])}" for name in sorted(points))
    return F.str_to_map(F.lit(listed), F.lit(","), F.lit("="))


def _numeric_entity(piece: Column) -> Column:
    decimal = F.conv(F.regexp_extract(piece, r"^&#0*+(\d{1,7});$", 1), 10, 16)
    hexadecimal = F.regexp_extract(piece, r"^&#[xX]0*+([0-9A-Fa-f]{1,6});$", 1)
    digits = F.when(hexadecimal != "", hexadecimal).otherwise(decimal)
    # References to control characters stay as written: outlines use those as marks.
    usable = (F.length(digits) <= 6) & (F.conv(digits, 16, 10).cast("int") >= 32)
    return F.when(usable, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Named and numeric character references; unknown ones stay as written."""
    pieces = F.regexp_extract_all(text, F.lit(r"&#?[A-Za-z0-9]+;|[^&]+|&"), 0)
    decoded = F.transform(
        pieces,
        lambda p: F.when(
            F.startswith(p, F.lit("&")) & (F.length(p) > 2),
            F.coalesce(_entity_map()[p], _numeric_entity(p), p),
        ).otherwise(p),
    )
    return F.array_join(decoded, "")


def inner_text(markup: Column) -> Column:
    """Text of a piece of markup, tags left out."""
    return decode_entities(F.regexp_replace(markup, rf"</?[A-Za-z]{_QUOTED_REST}", ""))


def first_element_text(html: Column, name: str) -> Column:
    """Text of the first element of one name (that holds no other of that name)."""
    body = F.regexp_extract(html, rf"(?is)<{name}\b{_QUOTED_REST}(.*?)(?:</{name}\s*>|\z)", 1)
    return inner_text(body)


def tag_pattern(name: str, *needs: str) -> str:
    """Pattern of an opening tag; ``needs`` are attribute patterns it must have."""
    # Skips values and other characters up to where the needed attribute begins; it can begin at white space only.
    looks = "".join(rf"""(?=(?:[^<>"'\s]++|{_QUOTED}|(?!\s{need})\s)*+\s{need})""" for need in needs)
    return rf"(?i)<{name}\b{looks}{_QUOTED_REST}"


def needs_class(name: str) -> str:
    quoted = rf"""["'](?:[^"'<>]*\s)?{name}(?:\s[^"'<>]*)?["']"""
    return rf"""class\s*=\s*(?:{quoted}|{name}(?=[\s>]))"""


def needs_whole_class(pattern: str) -> str:
    """The class attribute is just this."""
    return rf"""class\s*=\s*(?:"\s*{pattern}\s*"|'\s*{pattern}\s*')"""


def needs_id(name: str) -> str:
    return rf"""id\s*=\s*["']?{name}(?=["'\s>])"""


def outline(markup: Column, marked: dict[str, str] | None = None) -> Column:
    """Markup with tags as control characters.

    ``marked`` maps a replacement, made of a spare mark and for ``div`` tags also ``OPEN``, to
    the pattern of the tags that get it.
    """
    text = F.regexp_replace(markup, f"[{_MARKS}]", "")
    for mark, pattern in (marked or {}).items():
        text = F.regexp_replace(text, pattern, mark)
    text = F.regexp_replace(text, tag_pattern("div"), OPEN)
    text = F.regexp_replace(text, r"(?i)</div\s*>", CLOSE)
    return F.regexp_replace(text, rf"</?[A-Za-z]{_QUOTED_REST}", BREAK)


def _balanced() -> str:
    """Pattern of text in which every opened block is closed again, up to QUICK_DEPTH; linear in its input."""
    flat = f"[^{OPEN}{CLOSE}]*+"
    pattern = flat
    for _ in range(QUICK_DEPTH):
        pattern = f"{flat}(?:{OPEN}{pattern}{CLOSE}{flat})*+"
    return pattern


BALANCED = _balanced()


def exact_text(label: str) -> str:
    """Pattern of a text node that is just this label."""
    return rf"[{_MARKS}]\Q{label}\E(?=[{_MARKS}])"


def text_with(label: str) -> str:
    """Pattern of a label somewhere in a text node."""
    return rf"\Q{label}\E"


def same_marks(outlined: Column) -> Column:
    """An outline with one and the same mark for all tags, character for character in the same places."""
    return F.translate(outlined, _MARKS, BREAK * len(_MARKS))


def has_text(same: Column, label: str) -> Column:
    """Whether an outline with the same marks has a text node that is just this label."""
    return F.contains(same, F.lit(f"{BREAK}{label}{BREAK}"))


def _from(text: Column, found: Column, offset: int) -> Column:
    """``text`` from ``offset`` characters behind the first place; empty where ``found`` (what is in front of it) is all."""
    return F.substring(text, F.length(found) + F.lit(offset + 1), F.lit(2**31 - 1))


def after_text(outlined: Column, same: Column, label: str) -> Column:
    """What follows the first text node that is just this label; empty without one.

    ``same`` is the outline with the same marks. Plain comparisons of bytes, no expression.
    """
    return _from(outlined, F.substring_index(same, f"{BREAK}{label}{BREAK}", 1), 1 + len(label))


def after_text_with(outlined: Column, label: str) -> Column:
    """What follows the first place of a label; empty without one."""
    return _from(outlined, F.substring_index(outlined, label, 1), len(label))


def from_block(outlined: Column) -> Column:
    """An outline from its first ``div`` on; empty without one."""
    return _from(outlined, F.substring_index(outlined, OPEN, 1), 0)


def block_at(opened: Column) -> Column:
    """The block that an outline starts with; null where it is empty. One that stays open ends with the text.

    Blocks without inner ones are cut at the first mark that closes; the others by one expression, or counted out.
    """
    head = F.substring_index(opened, CLOSE, 1)
    flat = (F.length(head) < F.length(opened)) & ~F.contains(F.substring(head, 2, 2**31 - 1), F.lit(OPEN))
    quick = F.regexp_extract(opened, f"(?s)\\A({OPEN}{BALANCED}{CLOSE})", 1)
    inner = F.coalesce(F.nullif(quick, F.lit("")), _first_block(opened))
    return F.when(opened != "", F.when(flat, F.concat(head, F.lit(CLOSE))).otherwise(inner))


def _first_block(opened: Column) -> Column:
    """The block that an outline starts with, by counting marks; one that stays open ends with the text."""
    pieces = F.regexp_extract_all(opened, F.lit(f"(?s)[{OPEN}{CLOSE}]|[^{OPEN}{CLOSE}]++"), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + F.when(piece == OPEN, 1).when(piece == CLOSE, -1).otherwise(0)
        after = F.struct(depth.alias("depth"), (s["size"] + F.length(piece)).alias("size"), (depth == 0).alias("done"))
        return F.when(s["done"], s).otherwise(after)

    return F.substring(opened, F.lit(1), F.aggregate(pieces, start, step, lambda s: s["size"]))


def block_after(outlined: Column, text: str) -> Column:
    """Outline of the next ``div`` after the first match of a pattern, its own marks included.

    A block that is never closed ends with the text. Null when there is no match or no block.
    """
    # The atomic group holds on to the first match, so a block that is deep or open is never
    # passed over for one behind a later match; its end is then counted out.
    first = f"(?s)\\A(?>.*?(?:{text})[^{OPEN}]*+(?={OPEN}))"
    quick = F.regexp_extract(outlined, f"{first}({OPEN}{BALANCED}{CLOSE})", 1)
    opened = F.regexp_extract(outlined, f"{first}(.*+)", 1)
    return F.coalesce(F.nullif(quick, F.lit("")), F.when(opened != "", _first_block(opened)))


def marked_blocks(outlined: Column, mark: str) -> Column:
    """Outlines of all blocks with a spare mark, nested ones too; open ones end with the text."""
    blocks = F.lit(f"(?s){mark}(?=({OPEN}{BALANCED}{CLOSE})|({OPEN}.*+))")
    quick, rest = (F.regexp_extract_all(outlined, blocks, group) for group in (1, 2))
    # Only blocks that are deep or open are counted out, from where they begin.
    counted = F.zip_with(quick, rest, lambda q, r: F.when(q != "", q).otherwise(_first_block(r)))
    return F.when(F.exists(quick, lambda q: q == ""), counted).otherwise(quick)


def plain_text(outlined: Column) -> Column:
    """Text of an outline: the marks go."""
    return F.translate(outlined, _MARKS, "")
