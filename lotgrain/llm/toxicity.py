"""Toxicity: gradient-boosted trees over dense features of a lexicon and of style, calibrated.

The lexicon has a fixed part (plain insults) and a learned one: word beginnings that occur in
far more toxic than other documents of the labelled sample. Spellings are undone before both
are looked up: digits and signs for letters, stretched letters, letters set apart. Trees are
fitted on features made with a lexicon of the other folds, so a learned entry earns the weight
it has on documents it was not learned from; scores of folds the trees have not seen are
calibrated by isotonic regression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrain.llm import boosting
from lotgrain.llm.labelled import SAMPLE_ROWS, remainder, sample
from lotgrain.llm.rows import arrow_schema, slices, unused, with_text_columns

# Insults and slurs in plain spelling, by their beginnings.
INSULTS = frozenset(
    """
    idiot stupid moron loser pathetic scum worthless trash clown disgusting
    imbecile dumbass retard bastard bitch asshole fuck shit cunt whore slut filth vermin
    dumm trottel arschloch scheiss hurensohn abschaum wichser miststück
    connard salope pute merde débile crétin enculé ordure
    estúpido idiota imbécil gilipollas mierda puta cabrón basura asqueroso
    """.encode().split()
)

# Words that address the reader.
SECOND_PERSON = frozenset(
    """
    you your yours yourself youre ur u
    du dich dir dein deine deinen ihr euch euer sie ihnen
    tu te toi ton ta tes vous votre vos
    tú tu ti te tus usted ustedes vosotros vuestra
    """.encode().split()
)

# Signs that stand for letters.
LOOKALIKES = bytes.maketrans(b"013457@$!|+", b"oieastasilt")

STEMS = (4, 5, 6)
NEAR = 6
#: A learned beginning is kept if chance gives its counts with a probability below this.
CHANCE = 1e-5
#: The strongest learned beginnings, at most.
LEXICON_ROWS = 1_000
FOLDS = 3

NAMES = [
    "fixed_rate", "fixed_count", "learned_rate", "learned_count", "learned_best", "near_you", "you_rate", "hidden_count",
    "obfuscated_rate", "upper", "shout_words", "exclaims", "marks", "repeated_marks",
]

_EDGES = b".,;:!?\"'()[]{}<>-_*~`/\\|"
_STRETCHED = re.compile(rb"(.)\1{2,}")
_INNER = re.compile(rb"[A-Za-z][*@$!|+0-9._-]+[A-Za-z]|[0-9@$!|+][A-Za-z]")
_REPEATED = re.compile(rb"[!?]{2,}")
_CLASSES = np.zeros((256, 4))
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"!?", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]):
    _CLASSES[list(_chars), _k] = 1


def bare(word: bytes) -> bytes:
    """A word in lower case without marks around it."""
    return word.strip(_EDGES).lower()


def plain(word: bytes) -> bytes:
    """A word with its spelling undone: letters for signs, no marks inside, no stretched letters."""
    letters = word.lower().strip(b".,;:?\"'()").translate(LOOKALIKES, b"*._-~'`")
    return _STRETCHED.sub(rb"\1", letters)


def beginnings(word: bytes) -> list[bytes]:
    return [word[:k] for k in STEMS if len(word) >= k]


def _fixed(word: bytes) -> bool:
    return word in INSULTS or (len(word) > 6 and (word[:-1] in INSULTS or word[:-2] in INSULTS))


class Words(dict):
    """Number of each word met in a task, and what is known of it; emptied when it grows large."""

    MOST = 200_000

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon
        self.kinds = np.zeros((1 << 14, 7), np.float32)  # a row for each word met

    def start(self) -> None:
        if len(self) > self.MOST:
            self.clear()

    def __missing__(self, word: bytes) -> int:
        open_, undone = bare(word), plain(word)
        fixed, hidden = _fixed(open_), False
        learned = max((self.lexicon.get(b, 0.0) for b in beginnings(open_)), default=0.0)
        if undone != open_:
            if not fixed and _fixed(undone):
                fixed = hidden = True
            other = max((self.lexicon.get(b, 0.0) for b in beginnings(undone)), default=0.0)
            if other > learned:
                learned, hidden = other, True
        odd = bool(_INNER.search(word.strip(_EDGES)))
        you = open_ in SECOND_PERSON
        shout = len(open_) > 3 and word.isupper()
        at = len(self)
        if at == len(self.kinds):
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
        self.kinds[at] = (fixed, learned, hidden, odd, you, shout, len(open_) == 1)
        self[word] = at
        return at


def features(text: bytes | None, words: Words) -> list[float]:
    """The values of NAMES for a whole text; null counts as empty."""
    text = text or b""
    words.start()
    tokens = text.split()
    ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    n = len(ids)
    per_word, per_char = 1.0 / max(n, 1), 1.0 / max(len(text), 1)
    fixed, learned, hidden, odd, you, shout, single = words.kinds[ids].T.astype(np.float64)
    hits = (fixed > 0) | (learned > 0)
    apart = 0
    if single.sum() >= 3:
        edges = np.flatnonzero(np.diff(np.r_[0, single, 0]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= 3:
                joined = b"".join(map(bare, tokens[a:b]))
                apart += _fixed(joined) or any(x in words.lexicon for x in beginnings(joined))
    near = 0
    if you.any():
        you_before = np.r_[0, np.cumsum(you)]
        for at in np.flatnonzero(hits).tolist():
            near += you_before[min(n, at + NEAR + 1)] > you_before[max(0, at - NEAR)]
    upper, lower, exclaims, marks = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES).tolist()
    count = float(fixed.sum()) + apart
    return [
        100 * count * per_word, count, 100 * float((learned > 0).sum()) * per_word, float((learned > 0).sum()),
        float(learned.max()) if n else 0.0, float(near), 100 * float(you.sum()) * per_word, float(hidden.sum()) + apart,
        100 * float(odd.sum()) * per_word, upper / max(upper + lower, 1), float(shout.sum()) * per_word,
        100 * exclaims * per_char, 100 * marks * per_char, float(len(_REPEATED.findall(text))) * per_word,
    ]


def _beginning_counts(known: DataFrame) -> DataFrame:
    """(stem, fold, toxic, docs): in how many sampled documents each word beginning occurs."""
    fields = "stem binary, fold int, target int, docs long"
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            counts: dict[tuple, int] = {}
            for text, fold, target in zip(texts, part.column("fold").to_pylist(), part.column("target").to_pylist(), strict=True):
                own = set()
                for word in set((text or b"").split()):
                    own.update(beginnings(plain(word)))
                for stem in own:
                    counts[stem, fold, target] = counts.get((stem, fold, target), 0) + 1
            rows = [{"stem": s, "fold": f, "target": t, "docs": c} for (s, f, t), c in counts.items()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    one, other = (F.sum(F.when(F.col("target") == k, F.col("docs")).otherwise(0)) for k in (1, 0))
    folds = [
        F.sum(F.when((F.col("target") == k) & (F.col("fold") == f), F.col("docs")).otherwise(0)).alias(f"n{k}_{f}")
        for k in (0, 1) for f in range(FOLDS)
    ]
    summed = known.select("text", "fold", "target").mapInArrow(run, fields).groupBy("stem")
    # Toxic documents at least; the strongest by the share of toxic ones, then by their number.
    return (
        summed.agg(one.alias("ones"), other.alias("zeros"), *folds)
        .where((F.col("ones") >= 3) & (F.col("ones") > F.col("zeros")))
        .orderBy(F.desc(F.col("ones") / (F.col("zeros") + 1)), "stem")
        .limit(4 * LEXICON_ROWS)
    )


def _lexicon(rows: list, fold: int | None, sizes: dict[tuple[int, int], int]) -> dict[bytes, float]:
    """Weights of the beginnings that chance does not explain, without the rows of ``fold``."""
    folds = [f for f in range(FOLDS) if f != fold]
    ones = sum(sizes.get((1, f), 0) for f in folds)
    zeros = sum(sizes.get((0, f), 0) for f in folds)
    share = (ones + 1) / (ones + zeros + 2)
    found = []
    for row in rows:
        a, b = (sum(row[f"n{k}_{f}"] for f in folds) for k in (1, 0))
        if a < 3 or a <= b:
            continue
        # Chernoff bound on a or more toxic documents among a + b.
        q = a / (a + b)
        spread = q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0)
        if q > share and math.exp(-(a + b) * spread) < CHANCE:
            found.append((math.log((a + 0.5) / (ones + 1)) - math.log((b + 0.5) / (zeros + 1)), bytes(row["stem"])))
    return {stem: weight for weight, stem in sorted(found, reverse=True)[:LEXICON_ROWS]}


@dataclass
class Model:
    lexicon: dict[bytes, float]
    trees: boosting.Trees
    curve: boosting.Isotonic

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.curve(self.trees.probability(rows))


def train(docs: DataFrame, labels: DataFrame, wanted, rows: int = SAMPLE_ROWS) -> Model:
    """A calibrated model from at most ``rows`` labelled documents (see ``labelled.sample``)."""
    known = sample(docs, labels, "toxic", wanted, rows)
    sizes = {(r["target"], r["fold"]): r["count"] for r in known.groupBy("target", "fold").count().collect()}
    stems = _beginning_counts(known).collect()
    lexicons = {f: _lexicon(stems, f, sizes) for f in range(FOLDS)}

    def make():
        tables = {f: Words(lexicon) for f, lexicon in lexicons.items()}
        return lambda texts, part: [[features(t, tables[f]) for t, f in zip(texts, part.column("fold").to_pylist(), strict=True)]]

    table = with_text_columns(known, [("x", T.ArrayType(T.DoubleType()))], make, keep=["target", "fold"]).toPandas()
    x = np.array(table["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    y, fold = table["target"].to_numpy(np.float64), table["fold"].to_numpy()
    unseen = np.zeros(len(y))
    for f in range(FOLDS):
        unseen[fold == f] = boosting.fit(x[fold != f], y[fold != f]).probability(x[fold == f])
    return Model(_lexicon(stems, None, sizes), boosting.fit(x, y), boosting.fit_isotonic(unseen, y))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out``, 0 to 1; a null text scores as an empty one, repeated rows alike.

    Without labels of both kinds every text gets the base rate.
    """

    def make():
        words = Words(model.lexicon)
        return lambda texts, _: [model.score(np.array([features(t, words) for t in texts]).reshape(-1, len(NAMES)))]

    return with_text_columns(docs, [(out, T.DoubleType())], make, text, keep)


def score_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows whose crc32 remainder is another one."""
    model = train(docs, labels, remainder("doc_id", modulus) != held_out)
    scored = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= limit).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, limit: float = 0.7, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """The documents, same columns, that score below ``limit``.

    Labels of one kind only, or none, tell nothing apart: all documents stay.
    """
    model = train(docs, labels, remainder("doc_id", modulus) != held_out)
    if not len(model.trees.feature):
        return docs
    out = unused(docs, "toxicity")
    return score(docs, model, out=out).where(F.col(out) < limit).select(*[f"`{c}`" for c in docs.columns])
