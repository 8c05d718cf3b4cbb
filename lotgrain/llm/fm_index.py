"""Benchmark decontamination: an FM-index per shard of training documents.

A shard is a bounded run of documents inside a task. Words that occur in no benchmark item
can be part of no occurrence, so a shard keeps the runs of benchmark words only, each behind
a separator of its own, and is indexed by

* its suffix array (prefix doubling), kept at sampled positions only,
* its Burrows-Wheeler transform as a wavelet matrix, which answers ``rank(symbol, i)``.

All distinct windows are searched backwards at once; occurrences are located by walking back
to a sampled position, and overlapping ones merge into removal spans.

Nothing is shuffled. The benchmark is read in blocks of ``BLOCK_ITEMS`` items, each a closure
of bounded size; every further block is one more pass inside the same map stage.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrain.llm.rows import LETTERS_AND_DIGITS, plain_words, run_lengths, with_text_columns

WINDOW = 10
#: Items in one block; their words and windows go to every task.
BLOCK_ITEMS = 20_000
#: Words of documents indexed together.
SHARD_WORDS = 1 << 20
#: Every so many positions the suffix array keeps its value; runs also keep their first one.
SAMPLE = 16

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class WaveletMatrix:
    """Ranks of symbols in a sequence, for arrays of queries."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        self.bits = max(1, int(n_symbols - 1).bit_length())
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            ones = (now >> level) & 1
            before = np.zeros(len(now) + 1, np.int64)
            np.cumsum(ones, out=before[1:])
            self.levels.append((level, before, len(now) - int(before[-1])))
            now = np.concatenate([now[ones == 0], now[ones == 1]])
        # Where each symbol's block starts in the last order, also for symbols that do not occur.
        every = np.arange(n_symbols)
        self.first = self._walk(every, np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        at = upto
        for level, before, zeros in self.levels:
            ones = before[at]
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the position given with it."""
        return self._walk(symbol, upto) - self.first[symbol]


class FMIndex:
    """Symbols above 0 are words; a 0 ends a run. No pattern holds a 0."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        breaks = text == 0
        n_breaks = int(breaks.sum())
        # Each separator is a symbol of its own, so suffixes differ within one run.
        rank = np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + n_breaks)
        step, order = 1, np.argsort(rank, kind="stable")
        while True:
            after = np.full(n, -1, np.int64)
            after[: n - step] = rank[step:] if step < n else []
            order = np.lexsort((after, rank))
            changed = (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(changed)])
            step *= 2
            if changed.all() or step >= n:
                break
        self.bwt = text[order - 1]
        counts = np.bincount(text, minlength=n_symbols)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.ranks = WaveletMatrix(self.bwt, n_symbols)
        starts = np.concatenate([[True], breaks[:-1]])
        kept = starts[order] | (order % SAMPLE == 0)
        self.sampled, self.place = kept, np.cumsum(kept) - 1
        self.values = order[kept]
        self.n = n

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns (one a row of the array, of equal lengths), by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, j]
            low = self.before[symbol] + self.ranks.rank(symbol, low)
            high = self.before[symbol] + self.ranks.rank(symbol, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the next sampled one, which lies in the same run."""
        found = np.zeros(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows, 0
        while len(open_):
            done = self.sampled[at]
            found[open_[done]] = self.values[self.place[at[done]]] + steps
            open_, at, steps = open_[~done], at[~done], steps + 1
            symbol = self.bwt[at]
            at = self.before[symbol] + self.ranks.rank(symbol, at)
        return found


class Windows:
    """The distinct windows of a block of items, by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, words in items:
            symbols = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            size = min(window, len(symbols))
            for i in range(len(symbols) - size + 1 if size else 0):
                by_length[size][tuple(symbols[i : i + size])].add(item)
        self.groups = [
            (size, np.array(list(found), np.int64), [sorted(x for x in v if x is not None) for v in found.values()])
            for size, found in sorted(by_length.items())
        ]
        self.least = min(by_length, default=0)

    def search(self, docs: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Merged spans of hit words, and the items found, of each document."""
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        items: list[set[str]] = [set() for _ in docs]
        if not self.groups:
            return spans, items
        get, none = self.ids.get, 0
        sizes = np.array([len(d) for d in docs], np.int64)
        total = int(sizes.sum())
        flat = np.fromiter((get(w, none) for d in docs for w in d), np.int64, total)
        owner = np.repeat(np.arange(len(docs)), sizes)
        inside = flat > 0
        # A run is a stretch of benchmark words within one document.
        first = inside & np.r_[True, ~inside[:-1] | (owner[1:] != owner[:-1])] if total else inside
        run_of = np.cumsum(first) - 1
        lengths = np.bincount(run_of[inside], minlength=int(first.sum()))
        long_ = lengths >= self.least
        chosen = inside & long_[run_of] if total and len(lengths) else inside
        picked = np.flatnonzero(chosen)
        if not len(picked):
            return spans, items
        # The shard's text: each run and a separator behind it; source is -1 there.
        last = np.flatnonzero(np.r_[run_of[picked][1:] != run_of[picked][:-1], True])
        source = np.insert(picked, last + 1, -1)
        text = np.where(source >= 0, flat[source], 0)
        index = FMIndex(text, len(self.ids) + 1)
        cover = np.zeros(len(text) + 1, np.int64)
        for size, patterns, names in self.groups:
            low, high = index.find(patterns)
            hits = high - low
            which = np.repeat(np.arange(len(patterns)), hits)
            places = index.locate(np.repeat(low, hits) + run_lengths(hits))
            np.add.at(cover, places, 1)
            np.add.at(cover, places + size, -1)
            docs_hit = owner[source[places]]
            for window, doc in set(zip(which.tolist(), docs_hit.tolist(), strict=True)):
                items[doc].update(names[window])
        hit = np.cumsum(cover[:-1]) > 0
        where = source[hit]
        ends = np.flatnonzero(np.r_[(np.diff(where) != 1) | (np.diff(owner[where]) != 0), True]) if len(where) else []
        begin = 0
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for end in ends:
            doc = owner[where[begin]]
            spans[doc].append((int(where[begin] - starts[doc]), int(where[end] - starts[doc]) + 1))
            begin = end + 1
        return spans, items


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, rows: int) -> list[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks; the benchmark is the stated query set and small beside the corpus."""
    read = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null")
    blocks: list[list] = [[]]
    for row in read.toLocalIterator():
        if len(blocks[-1]) >= rows:
            blocks.append([])
        blocks[-1].append((row["i"], plain_words(bytes(row["t"]))))
    return blocks


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Where documents hold windows of benchmark items.

    Adds ``n_words``, ``hit_spans`` (word positions from 0, end excluded, merged, in order) and
    ``hit_items`` (item ids as strings, sorted). A window is ``window`` consecutive words of an
    item; a shorter item is one window; an item without words has none. Null and empty texts
    have no words and no hits. A null item id marks words but is not listed; items that share
    an id are listed once. Repeated rows are scanned each by itself. An empty benchmark hits
    nothing.
    """
    find = _finder(_blocks(benchmark, item, item_text, block_items), window)
    fields = [("n_words", T.LongType()), ("hit_spans", SPANS), ("hit_items", T.ArrayType(T.StringType()))]

    def make():
        search = find()

        def work(texts, _):
            sizes, spans, items = search(texts)
            return [sizes, [[{"start": a, "end": b} for a, b in s] for s in spans], items]

        return work

    return with_text_columns(docs, fields, make, text, keep)


def _finder(blocks: list, window: int):
    """Makes, in a task, the search of a slice: word counts, merged spans and sorted item ids of its texts."""

    def find():
        tables = [Windows(block, window) for block in blocks]

        def search(texts: list[bytes | None]):
            docs_words = [plain_words(t) for t in texts]
            spans, items = [], []
            begin = size = 0
            for i, words in enumerate(docs_words):
                size += len(words)
                if size >= SHARD_WORDS or i + 1 == len(docs_words):
                    shard = docs_words[begin : i + 1]
                    found = [table.search(shard) for table in tables]
                    for k in range(len(shard)):
                        merged, named = [], set()
                        for s, n in found:
                            merged = _merged(merged, s[k])
                            named |= n[k]
                        spans.append(merged)
                        items.append(sorted(named))
                    begin, size = i + 1, 0
            return [len(w) for w in docs_words], spans, items

        return search

    return find


_WORD = re.compile(rb"[^ ]+")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(LETTERS_AND_DIGITS))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def remove_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The documents, same columns and rows, with every hit span cut out of the text; others are unchanged."""
    find = _finder(_blocks(benchmark, item, item_text, BLOCK_ITEMS), window)

    def make():
        search = find()

        def work(texts, _):
            cut = [cut_words(t, s) if s else t for t, s in zip(texts, search(texts)[1], strict=True)]
            return [pa.array(cut, pa.binary()).cast(pa.string())]

        return work

    return with_text_columns(docs, [(text, T.StringType())], make, text).select(*[f"`{c}`" for c in docs.columns])
