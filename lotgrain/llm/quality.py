"""Quality of documents: histogram gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrain.llm import boosting
from lotgrain.llm.labelled import SAMPLE_ROWS, remainder, sample
from lotgrain.llm.rows import with_text_columns

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    """
    the of and to in a is that for it was on are as with be at by this from
    der die das und in zu den ist nicht von mit sich auf für im ein eine auch als bei
    de la le les et des en un une du que est pour qui dans sur pas au par avec
    el los las y que en un una del se por con no su para es al lo como más
    """.encode().split()
)

NAMES = [
    "log_chars", "log_words", "upper", "digits", "stops", "shouts", "bars", "symbols", "other_marks", "non_ascii",
    "mean_word", "spread_word", "short_words", "long_words", "distinct_words", "top_word", "same_neighbour",
    "distinct_pairs", "function_words", "log_lines", "mean_line", "distinct_lines", "marked_ends", "lower_starts",
]

_CLASSES = np.zeros((256, 9))
for _k, _chars in enumerate([
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()", b"!?", b"|", b"#$%&*@+=~^<>/\\_[]{}`",
]):
    _CLASSES[list(_chars), _k] = 1
_CLASSES[192:, 7] = 1  # first bytes of non-ASCII characters
_CLASSES[128:192, 8] = 1  # the other ones


def statistics(text: bytes | None) -> list[float]:
    """The values of NAMES; rates are per character, word or line. Null counts as empty."""
    text = text or b""
    upper, lower, digits, stops, shouts, bars, symbols, leads, trails = (
        np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    ).tolist()
    chars = len(text) - trails
    words = text.lower().split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x]
    per_char, per_word = 1.0 / max(chars, 1), 1.0 / max(n, 1)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(not w[-1:].isalnum() and w[-1] < 128 for w in counts)
    starts = sum(96 < x[0] < 123 for x in lines)
    return [
        np.log1p(chars), np.log1p(n), upper / max(upper + lower, 1), digits * per_char, stops * per_char, shouts * per_char,
        bars * per_word, symbols * per_char,
        (chars - upper - lower - digits - stops - shouts - bars - symbols - leads) * per_char, leads * per_char,
        float(lengths.mean()) if n else 0.0, float(lengths.std()) if n else 0.0, float((lengths <= 1).sum()) * per_word,
        float((lengths >= 15).sum()) * per_word, len(counts) * per_word, max(counts.values(), default=0) * per_word,
        sum(map(eq, words, words[1:])) * per_word, pairs / max(n - 1, 1),
        sum(c for w, c in counts.items() if w in FUNCTION_WORDS) * per_word,
        np.log1p(len(lines)), n / max(len(lines), 1), len(set(lines)) / max(len(lines), 1),
        ends / max(len(counts), 1), starts / max(len(lines), 1),
    ]


def _statistics():
    return lambda texts, _: [[statistics(t) for t in texts]]


def train(docs: DataFrame, labels: DataFrame, wanted, rows: int = SAMPLE_ROWS) -> boosting.Trees:
    """Trees from the statistics of at most ``rows`` labelled documents (see ``labelled.sample``)."""
    known = with_text_columns(
        sample(docs, labels, "quality", wanted, rows), [("x", T.ArrayType(T.DoubleType()))], _statistics, keep=["target"]
    ).toPandas()
    x = np.array(known["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    return boosting.fit(x, known["target"].to_numpy(np.float64))


def score(docs: DataFrame, trees: boosting.Trees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score``, 0 to 1, higher for better text; a null text scores as an empty one.

    Repeated rows score alike. Without labels all scores are one half.
    """

    def make():
        return lambda texts, _: [trees.probability(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES)))]

    return with_text_columns(docs, [("score", T.DoubleType())], make, text, keep)


def score_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows whose crc32 remainder is another one."""
    trees = train(docs, labels, remainder("doc_id", modulus) != held_out)
    scored = score(docs.select("doc_id", "text"), trees, keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )
