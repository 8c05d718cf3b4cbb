"""Substring removal: Rabin-Karp hashes of every window of words, counted in Spark.

Tasks hash the words of their documents, roll the hashes of all windows of a fixed number of
words over them, and do so for flushes of about ``FLUSH_WORDS`` words at a time. In a flush
each hash is kept once (so a window that half of all documents share counts once per flush),
sorted, and cut into blocks by ranges of the hash. A block travels as one row to the task of
its range, which counts the hashes of all blocks of that range and answers each block with the
positions of its repeated windows. Answers meet the flush's header again, cover words, and
merge into maximal removal intervals per text. Documents then join their intervals by two
64-bit hashes of the text: equal texts have equal intervals, so ids need not be unique.

No row or group grows with a hot key: flushes, blocks and ranges are bounded, and the last
join can be split on the side of the documents. A flush whose answers are not all there (a
task that was run again on rows dealt differently) raises an error instead of losing windows.

Windows are compared by 64-bit hashes: among n windows, two different ones are taken for equal
with probability n * n / 2**65.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrain.llm.rows import arrow_schema, give_back, run_lengths, slices, spaced_words, unused, with_text_columns

WINDOW = 35
FLUSH_WORDS = 1 << 19

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)

SPANS = "array<struct<start:bigint,end:bigint>>"
BLOCK = "bucket int, flush long, header boolean, payload binary, k1 array<bigint>, k2 array<bigint>, sizes array<bigint>, blocks int"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (np.uint64(BASE), np.uint64(INVERSE))
            )
        return self.up[:n], self.down[:n]


def window_hashes(words: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """Rolling polynomial hash of each ``size`` consecutive values, modulo 2**64, mixed."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    up, down = powers.upto(len(words))
    sums = np.r_[np.uint64(0), np.cumsum(words * up)]
    out = (sums[size:] - sums[:-size]) * down[:count]
    out ^= out >> np.uint64(31)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def _planes(values: np.ndarray, width: int) -> bytes:
    """Bytes of equal significance side by side: the high ones of small numbers then compress."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").ravel()


def _block(hashes: np.ndarray, places: np.ndarray, twice: np.ndarray) -> bytes:
    deltas = np.diff(hashes, prepend=np.uint64(0))
    return len(hashes).to_bytes(4, "little") + _planes(deltas, 8) + _planes(places, 4) + np.packbits(twice).tobytes()


def _unblock(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    hashes = np.cumsum(_unplanes(data[4 : 4 + 8 * n], n, 8), dtype=np.uint64)
    places = _unplanes(data[4 + 8 * n : 4 + 12 * n], n, 4)
    twice = np.unpackbits(np.frombuffer(data[4 + 12 * n :], np.uint8), count=n).astype(bool)
    return hashes, places, twice


def _hashed(size: int, buckets: int, text: str):
    """Rows of BLOCK for the texts of a task: the blocks of each flush and its header."""
    schema = arrow_schema(BLOCK)
    powers = Powers()

    def flush(number: int, words: list[np.ndarray], k1: list[int], k2: list[int]) -> Iterator[dict]:
        sizes = np.array([len(w) for w in words], np.int64)
        place = run_lengths(sizes)
        room = np.repeat(sizes, sizes) - place
        hashes = window_hashes(np.concatenate(words), size, powers)
        starts = np.flatnonzero(room[: len(hashes)] >= size)
        hashes = hashes[starts]
        order = np.argsort(hashes, kind="stable")
        hashes, starts = hashes[order], starts[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, np.int64)
        counts = np.diff(np.r_[first, len(hashes)])
        twice = counts > 1
        known = starts[np.repeat(twice, counts)]
        once, at = hashes[first], starts[first]
        bucket = ((once >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(once) else np.zeros(1, np.int64)
        task = TaskContext.get()
        name = f"{task.partitionId() if task else 0}:{number}:".encode() + np.array(k1, np.int64).tobytes() + np.array(k2, np.int64).tobytes()
        flush_id = xxhash.xxh3_64_intdigest(name) >> 1
        none = {"k1": None, "k2": None, "sizes": None, "blocks": None}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield {"bucket": int(bucket[a]), "flush": flush_id, "header": False, "payload": _block(once[a:b], at[a:b], twice[a:b])} | none
        yield {
            "bucket": flush_id % buckets, "flush": flush_id, "header": True, "payload": _planes(np.sort(known), 4),
            "k1": k1, "k2": k2, "sizes": sizes.tolist(), "blocks": len(cuts) - 1,
        }

    def sent(number: int, words: list, k1: list, k2: list) -> Iterator[pa.RecordBatch]:
        rows = flush(number, words, k1, k2)
        while some := list(islice(rows, 32)):
            yield pa.RecordBatch.from_pylist(some, schema)
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, k1, k2, total, number = [], [], [], 0, 0
        for part, texts in slices(batches, text):
            for value, a, b in zip(texts, part.column("k1").to_pylist(), part.column("k2").to_pylist(), strict=True):
                hashes = word_hashes(spaced_words(value))
                if len(hashes) < size:
                    continue
                words.append(hashes)
                k1.append(a)
                k2.append(b)
                total += len(hashes)
                if total >= FLUSH_WORDS:
                    yield from sent(number, words, k1, k2)
                    words, k1, k2, total, number = [], [], [], 0, number + 1
        if words:
            yield from sent(number, words, k1, k2)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by range come in; headers, and the answers to the blocks of each range, go out."""
    schema = None

    def answer(flushes: list[int], blocks: list[bytes]) -> list[dict]:
        parts = [_unblock(b) for b in blocks]
        hashes = np.concatenate([p[0] for p in parts])
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        same = ordered[1:] == ordered[:-1]
        repeated = np.zeros(len(hashes), bool)
        repeated[order] = np.r_[False, same] | np.r_[same, False]
        out, begin = [], 0
        none = {"k1": None, "k2": None, "sizes": None, "blocks": None}
        for flush_id, (own, places, twice) in zip(flushes, parts, strict=True):
            found = places[repeated[begin : begin + len(own)] & ~twice]
            begin += len(own)
            out.append({"bucket": 0, "flush": flush_id, "header": False, "payload": _planes(np.sort(found), 4)} | none)
        return out

    open_, flushes, blocks = None, [], []
    for batch in batches:
        schema = batch.schema
        headers = batch.filter(batch.column("header"))
        if headers.num_rows:
            yield headers
        for row in batch.filter(pc.invert(batch.column("header"))).select(["bucket", "flush", "payload"]).to_pylist():
            if row["bucket"] != open_ and blocks:
                yield pa.RecordBatch.from_pylist(answer(flushes, blocks), schema)
                flushes, blocks = [], []
            open_ = row["bucket"]
            flushes.append(row["flush"])
            blocks.append(row["payload"])
    if blocks:
        yield pa.RecordBatch.from_pylist(answer(flushes, blocks), schema)
        del flushes, blocks
    give_back()


def _covered(size: int, fields: str):
    """Per flush: its header, then its answers; out go the intervals of its texts."""
    schema = arrow_schema(fields)

    def finish(header: dict, answers: list[bytes]) -> list[dict]:
        if len(answers) != header["blocks"]:
            raise RuntimeError(f"{len(answers)} of {header['blocks']} answers to a flush of windows; its input was dealt anew meanwhile")
        sizes = np.array(header["sizes"], np.int64)
        cover = np.zeros(int(sizes.sum()) + 1, np.int32)
        for data in [header["payload"], *answers]:
            places = _unplanes(data, len(data) // 4, 4)
            np.add.at(cover, places, 1)
            np.add.at(cover, places.astype(np.int64) + size, -1)
        hit = np.cumsum(cover[:-1]) > 0
        ends = np.cumsum(sizes)
        starts = ends - sizes
        edge = np.zeros(len(hit), bool)
        edge[starts] = True
        opens = np.flatnonzero(hit & (edge | ~np.r_[False, hit[:-1]]))
        closes = np.flatnonzero(hit & np.r_[(edge | ~hit)[1:], True]) + 1
        owner = np.searchsorted(ends, opens, side="right")
        out = {}
        for doc, a, b in zip(owner.tolist(), opens.tolist(), closes.tolist(), strict=True):
            base = int(starts[doc])
            row = out.setdefault(doc, {"k1": header["k1"][doc], "k2": header["k2"][doc], "spans": []})
            row["spans"].append({"start": a - base, "end": b - base})
        return list(out.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, answers = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["header"]:
                    if header:
                        yield pa.RecordBatch.from_pylist(finish(header, answers), schema)
                    header, answers = row, []
                else:
                    if header is None or row["flush"] != header["flush"]:
                        raise RuntimeError("answers to a flush of windows without its header")
                    answers.append(row["payload"])
        if header:
            yield pa.RecordBatch.from_pylist(finish(header, answers), schema)

    return run


def _keyed(docs: DataFrame, text: str, k1: str = "k1", k2: str = "k2") -> DataFrame:
    return docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(1), F.col(text))})


def repeated_spans(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(k1, k2, spans): removal intervals of each distinct text that has any.

    ``spans`` are word positions, end excluded, maximal and in order: the words covered by a
    window of ``window`` words whose sequence also starts anywhere else, in the same text or in
    any other row. Shorter texts, empty ones and nulls have no window. A repeated row repeats
    all its windows.
    """
    spark = docs.sparkSession
    buckets = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = _keyed(docs.select(F.col(text).alias("text")), "text").mapInArrow(_hashed(window, buckets, "text"), BLOCK)
    answers = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted, BLOCK)
    fields = f"k1 long, k2 long, spans {SPANS}"
    by_flush = answers.repartition("flush").sortWithinPartitions("flush", F.desc("header"))
    return by_flush.mapInArrow(_covered(window, fields), fields).dropDuplicates(["k1", "k2"])


def with_spans(docs: DataFrame, window: int = WINDOW, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with their removal intervals in a new column ``spans``, null where there are none."""
    k1, k2 = unused(docs, "k1"), unused(docs, "k2")
    # Dealt anew, the intervals meet the documents in a join that can split a hot text.
    found = repeated_spans(docs, window, text).withColumnsRenamed({"spans": spans, "k1": k1, "k2": k2}).hint("rebalance")
    return _keyed(docs, text, k1, k2).join(found, [k1, k2], "left").drop(k1, k2)


_WORD = re.compile(rb"[^ \t-\r]+")


def cut_words(text: bytes, spans: list[dict]) -> bytes:
    """``text`` without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents, same columns and rows, without the words of repeated windows.

    What is kept of a text is unchanged, white space included; a text may become empty.
    """

    spans = unused(docs, "removal_spans")

    def make():
        def work(texts, part):
            found = part.column(spans).to_pylist()
            cut = [t if t is None or not s else cut_words(t, s) for t, s in zip(texts, found, strict=True)]
            return [pa.array(cut, pa.binary()).cast(pa.string())]

        return work

    spanned = with_spans(docs, window, text, spans)
    cut = with_text_columns(spanned, [(text, T.StringType())], make, text, [c for c in docs.columns if c != text], [spans])
    return cut.select(*[f"`{c}`" for c in docs.columns])
