"""Language model scoring: a hidden Markov model over words, and the add-0.1 unigram beside it.

A word is one of ``SYMBOLS`` frequent words, which are symbols of their own, or belongs to one
of ``CLASSES`` classes by its ending; a document's end is a symbol too. States emit symbols; a
word of a class then has its add-0.1 share of the class. So the model gives every text a
probability, whatever the size of the vocabulary, and

    log10 P(text) = log10 of the forward sum over state paths + sum of log10 P(word | class).

Word counts are summed in Spark over all training documents. Baum-Welch goes through all
training documents once, in slices chosen by a hash of the id: each slice's expected counts
are summed across partitions in Spark, blended into the running ones (later slices are larger
and blend by a falling rate) and give the next parameters. Only sums as large as the model
come to the driver.

The counts of the ``HEAD_WORDS`` most frequent words go to the tasks; the rarer words of the
documents meet their counts in a join. No word in that join makes up more than one part in
``HEAD_WORDS`` of all tokens, so no key of it is hot.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrain.llm.labelled import remainder
from lotgrain.llm.rows import arrow_schema, run_lengths, slices, with_text_columns, written

STATES = 6
SYMBOLS = 2_000
CLASSES = 64
HEAD_WORDS = 200_000
ADDED = 0.1
#: Slices of sixteen parts that one step of Baum-Welch sees; together they are all documents.
STEPS = [(0, 1), (1, 2), (2, 3), (3, 5), (5, 7), (7, 10), (10, 16)]
#: Longer sequences are taken in pieces of this length; products of matrices carry the state across their borders,
#: so that scores and expected counts are those of the whole sequence.
PIECE = 2_048
STRETCH = 1_024
#: Tokens whose state probabilities a task holds at a time.
HELD = 1 << 18
COUNTED = 300_000

END = b""  # no word is empty


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words between white space, then the end."""
    return [*(text or b"").lower().split(), END]


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): how often each token occurs; the end is the empty word. Null texts count as empty."""
    fields = "word binary, c long"
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return rows

        for _, texts in slices(batches, text):
            for value in texts:
                counts.update(tokens(value))
                if len(counts) > COUNTED:
                    yield out()
        yield out()

    return docs.select(text).mapInArrow(run, fields).groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    head: dict[bytes, int]  # symbols first: number of a frequent word
    counts: np.ndarray  # of the head words
    symbols: int  # so many head words are symbols; the classes follow
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    def __post_init__(self):
        n = len(self.head)
        own = np.array([word_class(w) for w in self.head], np.int64).reshape(-1)
        self.symbol = np.where(np.arange(n) < self.symbols, np.arange(n), self.symbols + own).astype(np.int32)
        self.log_count = np.log10(self.counts + ADDED)
        self.log_class = np.log10(self.class_total + ADDED * (self.class_distinct + 1))
        self.n_symbols = self.symbols + CLASSES

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of head words; a rarer word has -1 minus its class."""
        found = np.fromiter(map(self.head.get, words, repeat(-1)), np.int32, len(words))
        for i in np.flatnonzero(found < 0).tolist():
            found[i] = -1 - word_class(words[i])
        return found

    def symbols_of(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.symbol):
            return np.int32(self.symbols - 1) - numbers
        return np.where(numbers >= 0, self.symbol[np.maximum(numbers, 0)], np.int32(self.symbols - 1) - numbers)


def vocabulary(counts: DataFrame, head_words: int = HEAD_WORDS, symbols: int = SYMBOLS) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Words of equal or nearly equal counts are in the head together or not at all: the least
    # count is settled on a histogram, and no task sends more than the head has.
    step = F.floor(F.log2("c") * 16)
    least, room = None, head_words - 1
    for row in sorted(counts.where(F.col("word") != F.lit(END)).groupBy(step.alias("s")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["s"]
    chosen = F.col("word") == F.lit(END)
    head = counts.where(chosen if least is None else chosen | (step >= F.lit(least))).toPandas()
    head["first"] = head["word"].map(lambda w: bytes(w) != END)
    head = head.sort_values(["first", "c", "word"], ascending=[True, False, True])
    words = [bytes(w) for w in head["word"]]
    symbols = min(symbols, len(words))
    kind = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(CLASSES))
    classes = {r["kind"]: (r["c"], r["n"]) for r in counts.groupBy(kind.alias("kind")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    class_total = np.array([classes.get(k, (0, 0))[0] for k in range(CLASSES)], np.int64)
    class_distinct = np.array([classes.get(k, (0, 0))[1] for k in range(CLASSES)], np.int64)
    c = head["c"].to_numpy(np.int64)
    for word, count in zip(words[:symbols], c[:symbols], strict=True):  # symbols are in no class
        class_total[word_class(word)] -= count
        class_distinct[word_class(word)] -= 1
    return Vocabulary({w: i for i, w in enumerate(words)}, c, symbols, int(total), int(distinct), class_total, class_distinct)


@dataclass
class Model:
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)

    def forward(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 likelihood of each of the sequences that lie one behind the other in ``symbols``."""
        out = np.zeros(len(sizes))
        begins = np.cumsum(sizes) - sizes
        # First symbols, then each sequence's pieces: short ones as vectors, long ones as matrices.
        alpha = self.start * self.emit[symbols[begins]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        out += np.log10(scale)
        long_ = sizes - 1 > PIECE
        short = np.flatnonzero(~long_)
        order = short[np.argsort(-sizes[short], kind="stable")]
        at, left = begins[order] + 1, sizes[order] - 1
        now, sums = alpha[order], np.zeros(len(order))
        alive = len(order)
        for t in range(int(left.max(initial=0))):
            alive = int(np.searchsorted(-left[:alive], -t, side="left"))
            now = (now[:alive] @ self.step) * self.emit[symbols[at[:alive] + t]]
            scale = now.sum(axis=1)
            now /= scale[:, None]
            sums[:alive] += np.log10(scale)
        out[order] += sums
        out[long_] += self._long(symbols, begins[long_] + 1, sizes[long_] - 1, alpha[long_])
        return out

    def _products(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the product of step and emission over its symbols, scaled, and log10 of the scale."""
        states = len(self.start)
        order = np.argsort(-sizes, kind="stable")
        at, left = begins[order], -sizes[order]
        now = np.broadcast_to(np.eye(states), (len(order), states, states)).copy()
        sums, alive = np.zeros(len(order)), len(order)
        for t in range(int(sizes.max(initial=0))):
            alive = int(np.searchsorted(left[:alive], -t, side="left"))
            part = (now[:alive] @ self.step) * self.emit[symbols[at[:alive] + t]][:, None, :]
            scale = part.max(axis=(1, 2))
            now[:alive] = part / scale[:, None, None]
            sums[:alive] += np.log10(scale)
        matrices, logs = np.empty_like(now), np.empty_like(sums)
        matrices[order], logs[order] = now, sums
        return matrices, logs

    def _long(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """Matrices of all pieces of all sequences at once, then each sequence's product from the left."""
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        place = run_lengths(pieces) * PIECE
        matrices, sums = self._products(symbols, begins[owner] + place, np.minimum(PIECE, sizes[owner] - place))
        logs = np.bincount(owner, sums, len(sizes))
        for doc, matrix in zip(owner.tolist(), matrices, strict=True):
            after = alpha[doc] @ matrix
            scale = after.sum()
            alpha[doc] = after / scale
            logs[doc] += np.log10(scale)
        return logs

    def expected(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts (starts, steps, emissions) of whole sequences that lie one behind the other.

        Sequences are cut into pieces of STRETCH. Products over the pieces give the forward
        vector before and the backward vector behind each of them; with these, pieces are
        taken in batches of HELD tokens, however long a sequence is.
        """
        states = len(self.start)
        pieces = -(-sizes // STRETCH)
        place = run_lengths(pieces) * STRETCH
        owner = np.repeat(np.arange(len(sizes)), pieces)
        begins = (np.cumsum(sizes) - sizes)[owner] + place
        lengths = np.minimum(STRETCH, sizes[owner] - place)
        first = place == 0
        # Before a piece: the state distribution at the token ahead of it. Behind it: the likelihood of the rest.
        ahead, behind = np.zeros((len(owner), states)), np.ones((len(owner), states))
        cut = np.flatnonzero(pieces[owner] > 1)
        if len(cut):
            # A sequence's first symbol is entered through the start, not through a step.
            skip = first[cut].astype(np.int64)
            matrices = dict(zip(cut.tolist(), self._products(symbols, begins[cut] + skip, lengths[cut] - skip)[0], strict=True))
            now = self.start
            for i in cut.tolist():
                if first[i]:
                    now = self.start * self.emit[symbols[begins[i]]]
                else:
                    ahead[i] = now
                now = now @ matrices[i]
                now = now / now.sum()
            for i in reversed(cut.tolist()):
                if not first[i]:
                    back = matrices[i] @ behind[i]
                    behind[i - 1] = back / back.max()
        out = [np.zeros(states), np.zeros((states, states)), np.zeros((len(self.emit), states))]
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths[order])
        low = 0
        while low < len(order):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + HELD, side="right")))
            some = order[low:high]
            for total, part in zip(out, self._batch(symbols, begins[some], lengths[some], first[some], ahead[some], behind[some]), strict=True):
                total += part
            low = high
        return out[0], out[1] * self.step, out[2]

    def _batch(self, symbols, begins, sizes, first, ahead, behind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, unscaled steps and emissions of pieces, longest first."""
        longest = int(sizes[0])
        alive = np.searchsorted(-sizes, -np.arange(longest), side="left")
        offset = np.r_[0, np.cumsum(alive)]
        sym = np.concatenate([symbols[begins[:n] + t] for t, n in enumerate(alive.tolist())])
        emit = self.emit[sym]
        alphas, scales = np.empty_like(emit), np.empty(len(sym))
        now = np.where(first[:, None], self.start, ahead @ self.step)
        for t, n in enumerate(alive.tolist()):
            a, b = offset[t], offset[t + 1]
            now = (now[:n] if t == 0 else now[:n] @ self.step) * emit[a:b]
            scales[a:b] = now.sum(axis=1)
            now /= scales[a:b, None]
            alphas[a:b] = now
        beta = behind / (alphas[offset[sizes - 1] + np.arange(len(sizes))] * behind).sum(axis=1, keepdims=True)
        steps = np.zeros_like(self.step)
        for t in range(longest - 1, -1, -1):
            a, b, n = offset[t], offset[t + 1], alive[t]
            weighted = emit[a:b] * beta[:n] / scales[a:b, None]
            emit[a:b] = alphas[a:b] * beta[:n]  # from here on the state probabilities
            if t:
                steps += alphas[offset[t - 1] : offset[t - 1] + n].T @ weighted
                beta[:n] = weighted @ self.step.T
            else:
                steps += ahead[~first].T @ weighted[~first]
        emit /= emit.sum(axis=1, keepdims=True)
        emissions = np.stack([np.bincount(sym, emit[:, k], len(self.emit)) for k in range(len(self.start))], axis=1)
        return emit[: len(sizes)][first].sum(axis=0), steps, emissions


def _expected_counts(docs: DataFrame, words: Vocabulary, model: Model) -> np.ndarray:
    """Starts, steps and emissions, flat and summed over all documents given."""
    fields = "at int, value double"
    schema = arrow_schema(fields)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = shared.value, 0.0
        parts: list[np.ndarray] = []
        held = 0

        def add() -> None:
            nonlocal total, held
            found = model.expected(np.concatenate(parts), np.array([len(p) for p in parts]))
            total = total + np.concatenate([x.ravel() for x in found])
            parts.clear()
            held = 0

        for _, texts in slices(batches, "text"):
            for value in texts:
                parts.append(words.symbols_of(words.numbers(tokens(value))))
                held += len(parts[-1])
                if held > HELD:
                    add()
        if parts:
            add()
        if not isinstance(total, float):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], schema=schema)

    summed = docs.select("text").mapInArrow(run, fields).groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    states = STATES
    out = np.zeros(states + states * states + words.n_symbols * states)
    out[summed["at"].to_numpy(np.int64)] = summed["value"].to_numpy()
    return out


def _parameters(counts: np.ndarray, base: np.ndarray, added: float) -> Model:
    """The M-step: counts per state, eased towards the plain frequencies of symbols; none is below ``added``."""
    k = STATES
    start, step, emit = counts[:k] + 0.01, counts[k : k + k * k].reshape(k, k) + 1e-3, counts[k + k * k :].reshape(-1, k)
    emit = emit + 1e-3 * emit.sum(axis=0) * base[:, None] + added
    return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(docs: DataFrame, words: Vocabulary, doc_id: str = "doc_id") -> Model:
    """Stepwise Baum-Welch over all documents given; the same documents give the same model."""
    symbol_counts = np.r_[words.counts[: words.symbols], words.class_total] + ADDED
    base = symbol_counts / symbol_counts.sum()
    rng = np.random.default_rng(7)
    emit = base[:, None] * rng.gamma(2.0, 0.5, (len(base), STATES))
    # States that tend to stay: they come to stand for kinds of text, such as languages.
    step = rng.gamma(1.0, 1.0, (STATES, STATES)) + 60 * np.eye(STATES)
    model = Model(np.full(STATES, 1 / STATES), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    part = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("slice")), F.lit(16))
    running = None
    for i, (low, high) in enumerate(STEPS):
        counts = _expected_counts(docs.where((part >= low) & (part < high)), words, model)
        size = counts[STATES + STATES * STATES :].sum()
        if not size:
            continue
        rate = (i + 1) ** -0.6
        running = counts / size if running is None else (1 - rate) * running + rate * counts / size
        model = _parameters(running, base, ADDED / (words.total + 1) / STATES)
    return model


def score(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    A null or empty text is its end alone. Repeated rows score alike. Without training
    documents nothing is known, and both scores rest on the added counts.
    """
    fields = [
        ("n_tokens", T.LongType()), ("head_known", T.LongType()), ("head_log", T.DoubleType()), ("head_class_log", T.DoubleType()),
        ("symbols_log", T.DoubleType()), ("rare", T.ArrayType(T.BinaryType())), ("rare_n", T.ArrayType(T.IntegerType())),
    ]

    shared = docs.sparkSession.sparkContext.broadcast(words)  # as large as HEAD_WORDS allows

    def make():
        words = shared.value

        def block(numbers: list[np.ndarray]) -> list[np.ndarray]:
            sizes = np.array([len(n) for n in numbers])
            flat = np.concatenate(numbers)
            owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            symbols = words.symbols_of(flat)
            scores = model.forward(symbols, sizes)
            is_head = flat >= 0
            logs = words.log_count[np.maximum(flat, 0)] * is_head if len(words.log_count) else np.zeros(len(flat))
            known, head_log = np.bincount(owner, is_head, len(sizes)), np.bincount(owner, logs, len(sizes))
            in_class = np.flatnonzero(symbols >= words.symbols)
            logs = logs[in_class] - words.log_class[symbols[in_class] - words.symbols]
            return [sizes, known.astype(np.int64), head_log, np.bincount(owner[in_class], logs, len(sizes)), scores]

        def work(texts, _):
            done, numbers, rare, held = [], [], [], 0
            for i, text in enumerate(texts):
                own = tokens(text)
                numbers.append(words.numbers(own))
                rare.append(Counter(own[i] for i in np.flatnonzero(numbers[-1] < 0).tolist()))
                held += len(own)
                del own
                if held > HELD or i + 1 == len(texts):
                    done.append(block(numbers))
                    numbers, held = [], 0
            return [*map(np.concatenate, zip(*done, strict=True)), [list(r) for r in rare], [list(r.values()) for r in rare]]

        return work

    parts = with_text_columns(docs.drop("row_number_"), fields, make, text, keep).withColumn("row_number_", F.monotonically_increasing_id())
    parts = written(parts, "hmm-documents")
    rare = parts.select("row_number_", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("row_number_", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("n"))
    met = rare.join(counts, "word", "left").groupBy("row_number_").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADDED)).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    all_log = float(np.log10(words.total + ADDED * (words.distinct + 1)))
    return (
        parts.drop("rare", "rare_n").join(met, "row_number_", "left")
        .withColumns({
            "n_known": F.col("head_known") + F.coalesce("rare_known", F.lit(0)),
            "train_tokens": F.lit(words.total).cast("long"),
            "base_score": F.col("head_log") + rare_log - F.col("n_tokens") * all_log,
            "score": F.col("symbols_log") + F.col("head_class_log") + rare_log,
        })
        .drop("row_number_", "head_known", "head_log", "head_class_log", "symbols_log", "rare_log", "rare_known")
    )


def score_held_out(docs: DataFrame, modulus: int = 10, held_out: int = 0) -> DataFrame:
    """doc_id, held_out and the scores of all documents; learns from those with another crc32 remainder."""
    docs = docs.select("doc_id", "text")
    is_held = F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False))
    known = docs.where(~is_held)
    counts = written(count_words(known), "hmm-counts")
    words = vocabulary(counts)
    scored = score(docs, counts, words, train(known, words), keep=["doc_id"])
    return scored.select("doc_id", is_held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
