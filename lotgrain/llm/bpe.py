"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

A merge list gives every byte string exactly one encoding. Every prefix of a string has one
too, and its last token alone says how it was reached: the encoding of a prefix is that of a
shorter prefix plus one token, and a neighbour pair of tokens may stand side by side if and
only if no merge that comes early enough runs across their border. So the transducer walks
over the bytes and keeps, for each of the last ``reach`` positions, the last token of the
prefix that ends there; ``reach`` is the length of the longest token and is computed from the
merge list. The encodings of all prefixes within reach share their older tokens: those can no
longer change and are emitted. Memory is bounded by ``reach``, however long a text is. A piece of few
bytes needs no such walk: it is tried from the longest token on, back and forth, until all
neighbours fit; the first way through is the encoding, since there is only one.

The decoder turns tokens to bytes and bytes to text by a state machine over UTF-8, piece by
piece; a malformed sequence becomes U+FFFD.

The vocabulary file is a parameter; it is read on the driver and sent to the tasks once.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, islice

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lotgrain.llm.rows import kept, with_text_columns

#: Words whose tokens a task remembers; it forgets all of them when there are more.
REMEMBERED = 400_000
#: Bytes of text that are encoded at a time, cut where a piece ends.
STRETCH = 1 << 16
#: Pieces of at most so many bytes are tried from the longest token on.
SHORT = 32

# The split pattern of this vocabulary.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the file: itself, or one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The merge list: tokens by bytes, the halves of each token, and which pairs may be neighbours."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.special = special
        self.ids = vocab
        # Tokens numbered by when they come to be: single bytes, then merges in order.
        singles = sorted((t for t in vocab if len(t) == 1), key=vocab.get)
        self.tokens: list[bytes] = list(singles)
        number = {t: i for i, t in enumerate(singles)}
        self.left, self.right = list(range(len(singles))), list(range(len(singles)))
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b in number:
                continue  # a second way to an older token
            at = number[a + b] = len(self.tokens)
            self.tokens.append(a + b)
            self.left.append(number[a])
            self.right.append(number[b])
            self.joined[number[a], number[b]] = at
        self.number = number
        self.out = [vocab[t] for t in self.tokens]
        self.singles = len(singles)
        #: Longest token: no token that is still open starts earlier than this before the end.
        self.reach = max(map(len, self.tokens))
        #: By one number for two tokens: a times the number of tokens, plus b.
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.endings = None
        #: Tokens that are encoded as themselves, and the length of the longest of them that begins with the same three bytes.
        self.usable: dict[bytes, int] = {}
        self.longest: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"fits": {}, "whole": {}, "endings": None, "usable": {}, "longest": {}}

    def automaton(self) -> ahocorasick.Automaton:
        """Finds, for each position, the tokens that end there, the longest first."""
        if self.endings is None:
            self.endings = ahocorasick.Automaton()
            for i, t in enumerate(self.tokens):
                if self._whole(i):
                    self.endings.add_word(t.decode("latin-1"), (i, len(t)))
            self.endings.make_automaton()
        return self.endings

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a then b is just these two tokens.

        Both are taken apart, the younger first, along their common border. The halves at the
        border existed until the token they make was merged; a merge across the border that
        comes before that would have taken place.
        """
        pair = a * len(self.tokens) + b
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) > 2 * REMEMBERED:
                self.fits.clear()
            found = self.fits[pair] = self._neighbours(a, b)
        return found

    def _neighbours(self, a: int, b: int) -> bool:
        a_until = b_until = len(self.tokens) + 1
        while True:
            across = self.joined.get((a, b))
            # Of two equal pairs that overlap the left one merges first, hence the tie with b.
            if across is not None and across < a_until and across <= b_until:
                return False
            if a >= self.singles and (a > b or b < self.singles):
                a_until, a = a, self.right[a]
            elif b >= self.singles:
                b_until, b = b, self.left[b]
            else:
                return True

    def encode_piece(self, data: bytes) -> Iterator[int]:
        """Tokens of a piece, each as soon as nothing that follows can change it."""
        if len(data) <= SHORT:
            yield from self.encode_short(data)
            return
        whole = self.number.get(data)
        if whole is not None and self._whole(whole):
            yield self.out[whole]
            return
        if len(data) <= 4 * self.reach:
            yield from self._tokens(self._lasts(data), 0, 0, len(data))
            return
        reach, neighbours = self.reach, self.neighbours
        last: list[int] = []  # the last token of the prefix that ends at base + i + 1
        base = emitted = done = 0
        for at, (token, size) in self.automaton().iter(data.decode("latin-1")):
            end = at + 1
            if end == done or (end > size and not neighbours(last[end - size - base - 1], token)):
                continue
            last.append(token)
            done = end
            if len(last) > 4 * reach:
                # All prefixes within reach descend from one position: emit up to it.
                stable = self._common(set(range(end - reach + 1, end + 1)), last, base, emitted)
                if stable > emitted:
                    yield from self._tokens(last, base, emitted, stable)
                    emitted = stable
                drop = min(emitted, end - reach) - base
                if drop > 0:
                    last, base = last[drop:], base + drop
        yield from self._tokens(last, base, emitted, len(data))

    def prepare(self) -> None:
        """The tables for short pieces, once per process."""
        self.usable = {t: i for i, t in enumerate(self.tokens) if self._whole(i)}
        for t in self.usable:
            self.longest[t[:3]] = max(len(t), self.longest.get(t[:3], 0))

    def encode_short(self, data: bytes) -> list[int]:
        """Tokens of a short piece: the longest that fits its left neighbour, one back where nothing fits.

        A position reached by neighbours that fit is reached by the encoding of the bytes before
        it, in this way only. So where nothing leads on from it, the piece's encoding avoids it.
        """
        if not self.usable:
            self.prepare()
        find, longest, known, n, end = self.usable.get, self.longest.get, self.fits.get, len(self.tokens), len(data)
        path: list[int] = []
        dead: list[int] = []
        at, left = 0, -1
        to = min(end, longest(data[:3], 2))
        while at < end:
            while to > at:
                token = find(data[at:to])
                if token is not None and to not in dead:
                    if left < 0:
                        break
                    fits = known(left * n + token)
                    if self.neighbours(left, token) if fits is None else fits:
                        break
                to -= 1
            else:
                dead.append(at)
                to = at - 1
                at -= len(self.tokens[path.pop()])
                left = path[-1] if path else -1
                continue
            path.append(token)
            at, left = to, token
            to = min(end, at + longest(data[at : at + 3], 2))
        return [self.out[token] for token in path]

    def _lasts(self, data: bytes) -> list[int]:
        """The last token of every prefix of a short piece, which needs no emitting on the way."""
        known, neighbours, n = self.fits.get, self.neighbours, len(self.tokens)
        last: list[int] = []
        done = -1
        for at, (token, size) in self.automaton().iter(data.decode("latin-1")):
            if at == done:
                continue
            if at >= size:
                left = last[at - size]
                fits = known(left * n + token)
                if fits is None:
                    fits = neighbours(left, token)
                if not fits:
                    continue
            last.append(token)
            done = at
        return last

    def _whole(self, token: int) -> bool:
        """Whether a token's bytes are encoded as itself (its halves are neighbours up to then)."""
        if token < self.singles:
            return True
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self._reached(token)
        return found

    def _reached(self, token: int) -> bool:
        parts = [self.number[self.tokens[token][i : i + 1]] for i in range(len(self.tokens[token]))]
        while len(parts) > 1:
            best = min((self.joined.get(p, len(self.tokens)) for p in zip(parts, parts[1:], strict=False)), default=len(self.tokens))
            if best == len(self.tokens):
                return False
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.joined.get((parts[i], parts[i + 1])) == best:
                    merged.append(best)
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts == [token]

    def _common(self, ends: set[int], last: list[int], base: int, emitted: int) -> int:
        """The last position that the encodings of all the given prefixes pass through."""
        while len(ends) > 1:
            far = max(ends)
            ends.discard(far)
            ends.add(max(far - len(self.tokens[last[far - base - 1]]), emitted))
        return ends.pop()

    def _tokens(self, last: list[int], base: int, start: int, end: int) -> list[int]:
        out = []
        while end > start:
            token = last[end - base - 1]
            out.append(self.out[token])
            end -= len(self.tokens[token])
        return out[::-1]


def load(path: str) -> Merges:
    """A byte-level BPE from a tokenizer file in JSON; its added tokens are kept whole."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    signs = byte_signs()

    def raw(token: str) -> bytes:
        return bytes(signs[c] for c in token)

    added = {t["content"]: t["id"] for t in data["added_tokens"]}
    vocab = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in added}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
    return Merges(vocab, [(raw(a), raw(b)) for a, b in pairs], added)


class Encoder:
    """Text to tokens: added tokens, pieces, then the transducer, with a bounded memory of words."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.piece = regex.compile(PIECE)
        # Letters up to U+024F by ranges: the same pieces, found faster in plainer texts.
        letters = "".join(c for c in map(chr, range(0x250)) if regex.match(r"\p{L}", c))
        numbers = "".join(c for c in map(chr, range(0x250)) if regex.match(r"\p{N}", c))
        spaces = "".join(c for c in map(chr, range(0x250)) if regex.match(r"\s", c))
        cls = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": spaces}
        plain = PIECE.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\S", f"[^{spaces}]")
        for name, chars in cls.items():
            plain = plain.replace(name, f"[{chars}]")
        self.plain = re.compile(plain)
        self.beyond = re.compile("[^\x00-ɏ]")
        self.odd_spaces = re.compile(f"[{spaces}] | [{spaces}]|^ | $")
        self.added = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _remember(self, table: str, key: str, found: tuple[int, ...]) -> None:
        """The older half of what is remembered goes when there is too much of it; the table stays the same object."""
        words = getattr(self, table)
        if len(key) < 64:
            if len(words) >= REMEMBERED:
                for old in list(islice(words, REMEMBERED // 2)):
                    del words[old]
            words[key] = found

    def _piece(self, piece: str) -> tuple[int, ...]:
        found = self.pieces.get(piece)
        if found is None:
            data = piece.encode()
            found = tuple(self.merges.encode_short(data) if len(data) <= SHORT else self.merges.encode_piece(data))
            self._remember("pieces", piece, found)
        return found

    def _split(self, text: str) -> list[str]:
        return (self.plain if text.isascii() or not self.beyond.search(text) else self.piece).findall(text)

    def _pieces(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._piece, self._split(text))))

    def _word(self, word: str) -> tuple[int, ...]:
        """Tokens of a space and the word behind it."""
        found = self.words.get(word)
        if found is None:
            spaced = " " + word
            pieces = [spaced] if word.isascii() and word.isalpha() else self._split(spaced)
            # A word of one piece shares its tokens with it.
            found = self._piece(pieces[0]) if len(pieces) == 1 else tuple(chain.from_iterable(map(self._piece, pieces)))
            self._remember("words", word, found)
        return found

    def _words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Tokens of each word and the space before it."""
        found = list(map(self.words.get, words))
        return [self._word(w) if ids is None else ids for w, ids in zip(words, found, strict=True)] if None in found else found

    def _plain_text(self, text: str) -> Iterator[list[int]]:
        """Tokens of text without added tokens, a stretch at a time; pieces begin at a space or end with one."""
        at = 0
        while at < len(text):
            end = at + STRETCH
            # Between a non-space and a single space that a non-space follows, a piece always ends.
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and not text[end + 1 : end + 2].isspace()):
                cut = text.find(" ", end + 1)
                end = len(text) if cut < 0 else cut
            stretch = text[at:end]
            lead = at > 0 and stretch[:1] == " "
            body = stretch[1:] if lead else stretch
            if body and self.odd_spaces.search(body) is None:
                first, *rest = body.split(" ")
                start = self._word(first) if lead else self._pieces(first)
                yield [*start, *chain.from_iterable(self._words(rest))]
            else:
                yield self._pieces(stretch)
            at = end

    def stream(self, text: str) -> Iterator[list[int]]:
        """Tokens of a text in order, in lists of bounded size for texts with spaces."""
        at = 0
        for found in self.added.finditer(text) if self.added else ():
            yield from self._plain_text(text[at : found.start()])
            yield [self.merges.special[found.group()]]
            at = found.end()
        yield from self._plain_text(text[at:])


class Utf8:
    """Bytes to text, any cut of the bytes: what is not yet a whole character waits."""

    def __init__(self):
        self.waiting = b""

    @staticmethod
    def _room(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0

    @staticmethod
    def _second(lead: int) -> tuple[int, int]:
        return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.waiting + data
        self.waiting = b""
        try:
            return data.decode()
        except UnicodeDecodeError as error:
            good, out = error.start, [data[: error.start].decode()]
        # From the first doubtful byte on, one state step at a time until the bytes are sound again.
        at = good
        while at < len(data):
            room = self._room(data[at])
            size = 1
            while 0 < size < room and at + size < len(data):
                low, high = self._second(data[at]) if size == 1 else (0x80, 0xBF)
                if not low <= data[at + size] <= high:
                    break
                size += 1
            if size == room:
                out.append(data[at : at + size].decode())
            elif room and at + size == len(data) and not final:
                self.waiting = data[at:]
                break
            else:
                out.append("�")
            at += size
        return "".join(out)


class Decoder:
    """Tokens to text, list by list."""

    def __init__(self, merges: Merges):
        self.bytes_of = {i: t for t, i in merges.ids.items()} | {i: s.encode() for s, i in merges.special.items()}

    def stream(self, lists: Iterable[list[int]]) -> Iterator[str]:
        state = Utf8()
        for ids in lists:
            yield state.feed(b"".join(map(self.bytes_of.__getitem__, ids)))
        yield state.feed(b"", final=True)


def digests(docs: DataFrame, merges: Merges, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes every text, decodes the tokens again, and adds n_tokens, ids_sha256, decoded_sha256.

    The hashes are of the decimal ids joined by commas and of the decoded text, both made while
    the tokens stream by. Null and empty texts have no tokens and the hash of no bytes.
    Repeated rows get the same result.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(merges)  # one vocabulary of fixed size

    number = shared._jbroadcast.id()

    def lasting() -> Encoder:
        encoder = Encoder(shared.value)
        encoder.merges.prepare()
        # Tables of words and tokens hold no cycles: the collector need not go through them again and again.
        gc.freeze()
        return encoder

    def make():
        # Tasks of one worker process share what they remember; those of other operators let go of it.
        encoder, decoder = kept(number, lasting), Decoder(shared.value)
        shown = {i: str(i).encode() for i in decoder.bytes_of}

        def one(value: bytes | None) -> tuple[int, str, str]:
            count, ids_hash, text_hash, comma = 0, sha256(), sha256(), b""

            def passing() -> Iterator[list[int]]:
                nonlocal count, comma
                for ids in encoder.stream((value or b"").decode()):
                    if ids:
                        ids_hash.update(comma + b",".join(map(shown.__getitem__, ids)))
                        comma = b","
                        count += len(ids)
                        yield ids

            for out in decoder.stream(passing()):
                text_hash.update(out.encode())
            return count, ids_hash.hexdigest(), text_hash.hexdigest()

        return lambda texts, _: [list(c) for c in zip(*map(one, texts), strict=True)]

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return with_text_columns(docs, fields, make, text, keep, keeps=number)
