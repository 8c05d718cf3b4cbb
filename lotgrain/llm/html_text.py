"""Main text of web pages: flat blocks, shallow features of a block and its neighbours, a decision tree.

A page is cut into blocks at block-level tags. A block is described by its word count, its
link density, the same of the blocks before and behind it, and by what encloses it: marks of
page furniture (tag names and class, id or role words of the open elements) or of an article.
A small decision tree, fitted on the labelled pages below, tells text from boilerplate.

Words in class, id or role are weak marks: an element that is named after furniture but holds
most of the page's plain words, or its article, is a wrapper and no furniture.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lotgrain.llm.rows import with_text_columns

# Elements that end a block, that hold no text, and that have no end tag.
BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary
    table tbody td tfoot th thead title tr ul
    """.split()
)
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea head title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Elements and words in class, id or role that mark what is no part of the article, or the article.
FURNITURE_TAGS = frozenset("nav header footer aside form button select menu dialog fieldset label input".split())
COMMENT_WORDS = frozenset("comment comments comentarios commentaires kommentare reply replies respond disqus discussion reviews".split())
FURNITURE_WORDS = COMMENT_WORDS | frozenset(
    """
    ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager
    header masthead topbar footer foot bottom copyright colophon legal
    sidebar aside widget widgets related recommended recommendations trending popular teaser
    cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search
    share sharing social toolbar byline complementary contentinfo dialog
    """.split()
)
ARTICLE_WORDS = frozenset("article articlebody content entry post story main body text maincontent postbody".split())
#: Parts of a name that say nothing of their own, and such that turn a name into a property of what lies around it.
NEUTRAL_PARTS = frozenset(
    "list area section container wrapper wrap box block bar panel item items link links left right top inner outer slot unit buttons thread group column row".split()
)
TURNING_PARTS = frozenset("has with no without hide show is not".split())
CONTAINERS = frozenset("div section td main center".split())

FEATURES = ["furniture", "place", "words", "links", "words_before", "links_before", "words_behind", "links_behind", "heading"]

# The labelled pages: sequences of blocks (furniture, place, words, link density, heading, part of the main text).
# Place is 2 inside the page's article, 0 outside of it, 1 where a page marks none; link densities are shares of
# words. Neighbours are taken from the sequence.
LABELLED = [
    # An article element between menu, advert and footer.
    [(1, 0, 1, 1.0, 0, 0), (1, 0, 2, 1.0, 0, 0), (1, 0, 8, 0.0, 0, 0), (0, 2, 10, 0.0, 1, 1), (0, 2, 60, 0.0, 0, 1), (0, 2, 12, 0.0, 0, 1),
     (0, 2, 45, 0.1, 0, 1), (0, 2, 3, 0.0, 0, 1), (0, 2, 80, 0.0, 0, 1), (1, 0, 25, 0.0, 0, 0)],
    # Of short paragraphs, with an advert and a form inside.
    [(1, 0, 3, 1.0, 0, 0), (0, 2, 5, 0.0, 1, 1), (0, 2, 25, 0.0, 0, 1), (1, 2, 30, 0.1, 0, 0), (0, 2, 1, 0.0, 1, 1), (0, 2, 2, 0.0, 0, 1),
     (1, 2, 6, 0.0, 0, 0), (0, 2, 8, 0.0, 0, 1), (1, 0, 14, 0.2, 0, 0)],
    # With links and lists of links inside, related texts and comments behind.
    [(0, 0, 2, 1.0, 0, 0), (0, 0, 3, 1.0, 0, 0), (0, 2, 6, 0.0, 1, 1), (0, 2, 90, 0.3, 0, 1), (0, 2, 6, 1.0, 0, 1), (0, 2, 3, 1.0, 0, 1),
     (0, 2, 2, 0.6, 0, 1), (0, 2, 50, 0.0, 0, 1), (0, 0, 5, 0.0, 1, 0), (0, 0, 20, 0.5, 0, 0), (0, 0, 15, 0.6, 0, 0), (1, 0, 7, 0.0, 1, 0),
     (1, 0, 40, 0.0, 0, 0), (1, 0, 35, 0.0, 0, 0)],
    # Of a few words, and of links alone.
    [(1, 0, 1, 1.0, 0, 0), (0, 2, 2, 0.0, 0, 1), (1, 2, 3, 0.0, 0, 0), (0, 2, 1, 0.0, 0, 1)],
    [(1, 0, 1, 1.0, 0, 0), (0, 2, 3, 1.0, 0, 1), (0, 2, 2, 0.0, 0, 1), (0, 2, 3, 1.0, 0, 1), (1, 0, 9, 0.0, 0, 0)],
    [(0, 0, 1, 1.0, 0, 0), (0, 2, 1, 0.0, 1, 1), (0, 2, 2, 1.0, 0, 1), (0, 0, 2, 1.0, 0, 0)],
    # One block outside of it on either side.
    [(0, 0, 12, 0.0, 0, 0), (0, 2, 4, 0.0, 0, 1), (0, 2, 5, 0.0, 0, 1), (0, 0, 35, 0.0, 0, 0)],
    [(0, 0, 50, 0.0, 0, 0), (0, 2, 60, 0.0, 0, 1), (0, 0, 12, 0.0, 1, 0)],
    # No article marked: menu, title, paragraphs, a caption and links behind it.
    [(0, 1, 1, 1.0, 0, 0), (0, 1, 2, 1.0, 0, 0), (0, 1, 1, 1.0, 0, 0), (0, 1, 8, 0.0, 1, 1), (0, 1, 50, 0.0, 0, 1), (0, 1, 2, 0.0, 0, 1),
     (0, 1, 70, 0.1, 0, 1), (0, 1, 2, 0.0, 1, 0), (0, 1, 4, 1.0, 0, 0), (0, 1, 9, 1.0, 0, 0), (0, 1, 8, 1.0, 0, 0)],
    # Captions between lists of links, then a text of which one paragraph is a link.
    [(0, 1, 2, 0.0, 0, 0), (0, 1, 3, 1.0, 0, 0), (0, 1, 4, 1.0, 0, 0), (0, 1, 1, 0.0, 1, 0), (0, 1, 4, 1.0, 0, 0), (0, 1, 3, 0.0, 0, 0),
     (0, 1, 2, 1.0, 0, 0), (0, 1, 6, 0.0, 1, 1), (0, 1, 40, 0.0, 0, 1), (0, 1, 5, 0.8, 0, 1), (0, 1, 55, 0.0, 0, 1), (0, 1, 4, 0.0, 1, 1),
     (0, 1, 35, 0.0, 0, 1)],
    # A menu, a short first line, a long text, links, and a last caption.
    [(0, 1, 1, 1.0, 0, 0), (0, 1, 3, 1.0, 0, 0), (0, 1, 3, 0.0, 0, 1), (0, 1, 60, 0.0, 0, 1), (0, 1, 14, 0.0, 0, 1), (0, 1, 25, 0.0, 0, 1),
     (0, 1, 12, 0.6, 0, 0), (0, 1, 9, 0.7, 0, 0), (0, 1, 4, 0.0, 1, 0), (0, 1, 6, 1.0, 0, 0)],
    # Short last lines of a text before links; captions of the lists of links behind them.
    [(0, 1, 2, 1.0, 0, 0), (0, 1, 30, 0.0, 0, 1), (0, 1, 45, 0.0, 0, 1), (0, 1, 4, 0.0, 0, 1), (0, 1, 3, 1.0, 0, 0), (0, 1, 4, 0.0, 0, 0),
     (0, 1, 5, 1.0, 0, 0), (0, 1, 2, 0.0, 0, 0), (0, 1, 6, 1.0, 0, 0), (0, 1, 2, 1.0, 0, 0)],
    [(0, 1, 50, 0.0, 0, 1), (0, 1, 2, 0.0, 0, 1), (0, 1, 4, 1.0, 0, 0), (0, 1, 2, 0.0, 1, 0), (0, 1, 3, 1.0, 0, 0)],
    # Links alone and short plain lines around them: a page of links.
    [(0, 1, 2, 0.0, 0, 0), (0, 1, 2, 1.0, 0, 0), (0, 1, 3, 0.0, 0, 0), (0, 1, 4, 0.9, 0, 0), (0, 1, 2, 0.0, 0, 0)],
    # Marked furniture where no article is.
    [(1, 1, 1, 1.0, 0, 0), (1, 1, 3, 1.0, 0, 0), (1, 1, 40, 0.0, 0, 0), (0, 1, 6, 0.0, 1, 1), (0, 1, 14, 0.0, 0, 1), (0, 1, 11, 0.0, 0, 1),
     (1, 1, 1, 0.0, 1, 0), (1, 1, 35, 0.0, 0, 0), (1, 1, 60, 0.1, 0, 0)],
    # Texts alone.
    [(0, 1, 12, 0.0, 0, 1)], [(0, 1, 2, 0.0, 0, 1)], [(0, 1, 80, 0.25, 0, 1)], [(0, 1, 7, 0.0, 1, 1), (0, 1, 9, 0.0, 0, 1), (0, 1, 6, 0.0, 0, 1)],
    [(0, 1, 2, 0.0, 1, 1), (0, 1, 30, 0.0, 0, 1), (0, 1, 4, 0.0, 0, 1), (0, 1, 45, 0.0, 0, 1), (0, 1, 3, 0.0, 0, 1)],
]


def with_neighbours(blocks: list[tuple]) -> list[tuple]:
    """Rows of FEATURES for the blocks of a page, given as (furniture, place, words, links, heading)."""
    nothing = (0, 0, 0, 0.0, 0)
    around = [nothing, *blocks, nothing]
    return [(b[0], b[1], b[2], b[3], around[i][2], around[i][3], around[i + 2][2], around[i + 2][3], b[4]) for i, b in enumerate(blocks)]


def labelled_rows() -> list[tuple]:
    """FEATURES and label of every block of the labelled pages."""
    return [(*row, b[5]) for page in LABELLED for row, b in zip(with_neighbours([b[:5] for b in page]), page, strict=True)]


@dataclass
class Tree:
    """A binary decision tree in flat arrays; ``feature`` is -1 at a leaf."""

    feature: list[int]
    limit: list[float]
    left: list[int]
    right: list[int]
    value: list[bool]

    def __call__(self, row: tuple) -> bool:
        at = 0
        while self.feature[at] >= 0:
            at = self.left[at] if row[self.feature[at]] <= self.limit[at] else self.right[at]
        return self.value[at]


def fit_tree(table: list[tuple] | None = None, depth: int = 9) -> Tree:
    """Splits by the lowest Gini impurity, earlier features first among equals, until leaves are pure."""
    data = np.array(table or labelled_rows(), np.float64)
    tree = Tree([], [], [], [], [])

    def gini(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return len(y) * p * (1 - p)

    def grow(rows: np.ndarray, room: int) -> int:
        at = len(tree.feature)
        for field, empty in ((tree.feature, -1), (tree.limit, 0.0), (tree.left, -1), (tree.right, -1)):
            field.append(empty)
        y = rows[:, -1]
        tree.value.append(bool(y.mean() >= 0.5))
        best = (gini(y) - 1e-9, -1, 0.0)
        for f in range(rows.shape[1] - 1) if room else ():
            values = np.unique(rows[:, f])
            for limit in (values[1:] + values[:-1]) / 2:
                low = rows[:, f] <= limit
                score = gini(y[low]) + gini(y[~low])
                if score < best[0] - 1e-9:
                    best = (score, f, float(limit))
        if best[1] >= 0:
            low = rows[:, best[1]] <= best[2]
            tree.feature[at], tree.limit[at] = best[1], best[2]
            tree.left[at] = grow(rows[low], room - 1)
            tree.right[at] = grow(rows[~low], room - 1)
        return at

    grow(data, depth)
    return tree


@dataclass
class Block:
    text: str
    words: int
    links: float
    furniture: bool
    article: int
    heading: bool


_MARKUP = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)(>|(?=<)|\Z)|</[^>]*>?",
    re.DOTALL,
)
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.IGNORECASE)
_QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
#: ``hidden`` counts as an attribute's own name only, not within another name or a value.
_HIDDEN = re.compile(r"(?<![\w=:-])hidden(?![\w:-])", re.IGNORECASE)
_UNSEEN = re.compile(r"(?<![\w-])(?:aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?|\Z", re.IGNORECASE) for name in RAW}


def named(token: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role is one of the words, ends with one, or is one with parts that say nothing."""
    parts = [p.lower() for p in _PARTS.findall(token)]
    if not parts or parts[0] in TURNING_PARTS:
        return False
    return token.lower() in words or parts[-1] in words or (parts[0] in words and all(p in NEUTRAL_PARTS for p in parts[1:]))


def _marks(tag: str, attributes: str) -> tuple[bool, int, int, bool]:
    """Whether an element is furniture, named after it (1, after comments 2), an article (2: named so, 1: marked so), or silent."""
    furniture, article, silent, soft = tag in FURNITURE_TAGS, 2 * (tag == "article") or int(tag == "main"), tag in SILENT, 0
    if attributes:
        for name, *found in _NAMES.findall(attributes):
            if name.lower() == "id" and tag in HEADINGS:
                continue  # an anchor
            for token in next(filter(None, found), "").split():
                if tag not in ("article", "main", "body", "html") and named(token, FURNITURE_WORDS):
                    soft = max(soft, 2 if named(token, COMMENT_WORDS) else 1)
                elif tag in CONTAINERS and named(token, ARTICLE_WORDS):
                    article = max(article, 1)
        silent = silent or bool(_HIDDEN.search(_QUOTED.sub("", attributes)) or _UNSEEN.search(attributes))
    return furniture, soft, 0 if soft else article, silent


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, those without words left out.

    Markup may be broken: an end tag closes the nearest open element of its name, or nothing;
    comments, scripts and styles that do not end run to the end of the page; a tag that does
    not end runs to the next one.
    """
    out: list[Block] = []
    within: list[int] = []  # for each block the innermost open element that is named after furniture
    soft: list[tuple[int, int]] = [(0, 0)]  # of each such element the one around it and its kind; the first is the page
    holds = {0}  # those that hold an article
    stack: list[tuple[str, bool, int, bool, int]] = []
    inside = [0]
    open_names: dict[str, int] = {}
    pieces: list[tuple[str, bool]] = []
    furniture = silent = links = headings = 0
    article = [0, 0, 0]  # open elements of each kind

    def close() -> None:
        text = " ".join("".join(t for t, _ in pieces).split())
        if text:
            words = text.count(" ") + 1
            linked = sum(len(t.split()) for t, link in pieces if link)
            out.append(Block(text, words, min(1.0, linked / words), furniture > 0, 2 if article[2] else int(article[1] > 0), headings > 0))
            within.append(inside[-1])
        pieces.clear()

    def leave() -> str:
        nonlocal furniture, silent, links, headings
        name, is_furniture, kind, is_silent, is_soft = stack.pop()
        if is_soft:
            inside.pop()
        open_names[name] -= 1
        furniture, silent = furniture - is_furniture, silent - is_silent
        article[kind] -= 1
        links -= name == "a"
        headings -= name in HEADINGS
        return name

    at = 0
    while True:
        # A "<" that begins no tag is text.
        tag = _MARKUP.search(page, at)
        text = page[at : tag.start() if tag else len(page)]
        if text and not silent:
            pieces.append((html.unescape(text), links > 0))
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            close()
        elif name == "br":
            pieces.append(("\n", False))
        if tag[1]:
            while open_names.get(name) and leave() != name:
                pass
            continue
        if name in VOID:
            continue
        if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            leave()
        if name in RAW:
            end = _ENDS[name].search(page, at)
            at = end.end()
            continue
        if tag[3].endswith("/"):
            continue
        is_furniture, kind, article_kind, is_silent = _marks(name, tag[3])
        if kind:
            soft.append((inside[-1], kind))
            inside.append(len(soft) - 1)
        elif name in ("article", "main"):
            holds.add(inside[-1])
        stack.append((name, is_furniture, article_kind, is_silent, kind))
        open_names[name] = open_names.get(name, 0) + 1
        furniture, silent = furniture + is_furniture, silent + is_silent
        article[article_kind] += 1
        links += name == "a"
        headings += name in HEADINGS
    close()
    if len(soft) > 1:
        _settle(out, within, soft, holds)
    return out


def _settle(found: list[Block], within: list[int], soft: list[tuple[int, int]], holds: set[int]) -> None:
    """Which elements named after furniture are, by the words they hold; marks their blocks.

    One that holds more than half of the page's words, few of them links, or an article, is a
    wrapper. Comments may outgrow a text, so they are one only with nine tenths of all words.
    """
    words, linked = [0] * len(soft), [0.0] * len(soft)
    for block, at in zip(found, within, strict=True):
        if not block.furniture:
            words[at] += block.words
            linked[at] += block.words * block.links
    for at in range(len(soft) - 1, 0, -1):  # elements come behind those around them
        around, kind = soft[at]
        words[around] += words[at]
        linked[around] += linked[at]
        if at in holds and kind == 1:
            holds.add(around)
    marked = [False] * len(soft)
    for at in range(1, len(soft)):
        around, kind = soft[at]
        wraps = words[at] > (0.9 if kind == 2 else 0.5) * words[0] and linked[at] < 0.5 * words[at]
        marked[at] = marked[around] or not (wraps or (kind == 1 and at in holds))
    for block, at in zip(found, within, strict=True):
        block.furniture = block.furniture or marked[at]


def main_text(page: str, tree: Tree) -> str:
    """The blocks that the tree takes for text, joined by line ends."""
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if tree(row))


def features(found: list[Block]) -> list[tuple]:
    """Rows of FEATURES for the blocks of a page.

    The strongest mark of an article on the page says what lies inside; names of elements alone
    do so only if these hold a third of the words outside of furniture.
    """
    plain = [b for b in found if not b.furniture]
    strongest = max((b.article for b in plain), default=0)
    if strongest == 1 and 3 * sum(b.words for b in plain if b.article) < sum(b.words for b in plain):
        strongest = 0
    place = [1 if not strongest else 2 * (b.article == strongest) for b in found]
    return with_neighbours([(int(b.furniture), at, b.words, b.links, int(b.heading)) for b, at in zip(found, place, strict=True)])


def extract(pages: DataFrame, markup: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of the whole page, and ``n_chars``, its code points.

    A null or empty page has an empty text, and so has a page without blocks of text. Repeated
    rows get the same text.
    """
    tree = fit_tree()

    def make():
        def work(pages_html, _):
            texts = [main_text((p or b"").decode(), tree) for p in pages_html]
            return [texts, [len(t) for t in texts]]

        return work

    return with_text_columns(pages, [("text", T.StringType()), ("n_chars", T.LongType())], make, markup, keep)
