"""Merkle manifests, archive conversion and conversation repair against brute force and on odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotgrain.llm import conversations, merkle, warc

SPACES = " \t\n\x0b\x0c\r"


def by_text(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


# ------------------------------------------------------------------ manifest


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(*values) -> str:
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels_of(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def path_of(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def proofs_by_brute_force(rows) -> list[tuple]:
    sources: dict = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    leaves, trees = {}, {}
    for s in names:
        hashed = [(r["doc_id"] is not None, r["doc_id"] or 0, digest(encoded(r["doc_id"], s, r["lang"], r["n_chars"], r["text"])), i) for i, r in enumerate(sources[s])]
        leaves[s] = [(sources[s][i], leaf) for _, _, leaf, i in sorted(hashed)]
        trees[s] = levels_of([leaf for _, leaf in leaves[s]])
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for i, (r, leaf) in enumerate(leaves[s]):
            path, text = path_of(trees[s], i) + path_of(top, n), r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = digest(encoded(r["doc_id"], s, r["lang"], r["n_chars"], text))
            for left, right in path:
                now = digest(left + now + right)
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return out


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long"


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab\né") for _ in range(rng.randint(0, 9))), "en", rng.choice(["hot", "hot", "x", "é", "y"]), 3, "t", 1) for i in range(120)]
    rows += [(None, None, None, None, None, None, None), (None, "", "", "", 0, "", 0), (2**60 + 1, "a\nb", "x", None, 3, "", 0), (7, "é" * 50_000, "x", "one", 1, "", 0)]
    return spark.createDataFrame(rows + rows[:9] + [(5, "a\nb", "x", "hot", 3, None, None)] * 4, DOCUMENTS)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_proofs_match_brute_force(documents, height):
    got = merkle.prove(documents, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_text(got.collect()) == by_text(proofs_by_brute_force(documents.collect()))


def test_proofs_of_one_row_and_of_none(spark, documents):
    one = merkle.prove(documents.where("doc_id = 11").limit(1)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest("")
    assert merkle.prove(documents.limit(0)).collect() == []


@pytest.mark.parametrize("height", range(8))
def test_addresses_are_those_of_the_recursive_layout(height):
    layout, out = merkle.Layout(height), []

    def put(depth, number, levels):  # the definition: the upper half, then each subtree below it
        if levels == 1:
            return out.append((depth, number))
        top = levels // 2
        put(depth, number, top)
        for i in range(3**top):
            put(depth + top, number * 3**top + i, levels - top)

    put(0, 0, height + 1)
    for address, (depth, number) in enumerate(out):
        assert layout.address(depth, np.array([number]))[0] == address


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26])
def test_blocks_hold_the_levels_and_give_siblings(n):
    leaves = [digest(str(i)) for i in range(n)]
    want = levels_of(leaves)
    store = merkle.build_block([x.encode() for x in leaves], len(want) - 1)
    assert store[: merkle.DIGEST].decode() == want[-1][0]
    for i, leaf in enumerate(leaves):
        path = list(merkle.siblings(store, n, len(want) - 1, i))
        assert [(a.decode(), b.decode()) for a, b in path] == path_of(want, i)
        assert merkle.fold(leaf.encode(), path).decode() == want[-1][0]


# ------------------------------------------------------------------ archives


def records_by_brute_force(rows, least: int = 0) -> list[tuple]:
    rank = lambda r: (r["page_id"] is None, r["page_id"] or 0)
    payload = lambda r: (r["html"] or "").encode()
    first: dict = {}
    for r in rows:
        first[payload(r)] = min(first.get(payload(r), rank(r)), rank(r))
    out, seen = [], set()
    for r in rows:
        data = payload(r)
        own = len(data) < least or first[data] == rank(r) and data not in seen
        seen |= {data} if own else set()
        to = None if own or first[data][0] else first[data][1]
        out.append((r["page_id"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", to))
    return out


PAGES = "page_id long, url string, html string, archive string, content string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(i, f"https://x.example/{i}", rng.choice(["<p>same", "", "HTTP/1.1 200 OK\r\n\r\nx", "é\n\n1 2 3\n", f"<p>{i}" * i]), "a", "b") for i in range(80)]
    rows += [(None, None, None, None, None), (None, "", "only here", "", ""), (None, "", "only here", "", ""), (3, "a b\nc", "<p>same", "", ""), (900, "y", "long " * 100_000, "", "")]
    return spark.createDataFrame(rows + rows[:5], PAGES)


@pytest.mark.parametrize(("least", "size"), [(0, 1 << 24), (5, 2_000)])
def test_records_match_brute_force(pages, least, size):
    path, rows = warc.convert_pages(pages, least, size)
    assert rows.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert by_text(rows.collect()) == by_text(records_by_brute_force(pages.collect(), least))
    # The files are plain gzip members of whole records.
    for file in Path(path).glob("part-*"):
        text = gzip.decompress(file.read_bytes())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")
        for r in warc.read_warc(text):
            assert r.fields.get(b"WARC-Block-Digest", b"").decode() in ("", "sha1:" + warc.digest(r.content))


def test_no_pages(spark):
    assert warc.convert_pages(spark.createDataFrame([], PAGES))[1].collect() == []


def arc(version: bytes, *records: bytes, packed: bool = True) -> bytes:
    parts = [warc.arc_start(version, b"x.arc"), *records]
    return b"".join(map(warc.member, parts)) if packed else b"".join(parts)


@pytest.mark.parametrize("packed", [True, False])
def test_header_lines_of_both_versions(packed):
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhttp://no.record 1.1.1.1 19990101000000 text/html 5\nx"
    first = arc(b"1", b"http://a.b/c d 1.2.3.4 199912312359 text/html %d\n%s\n" % (len(body), body), b"dns:a.b 1.2.3.4 1999 text/dns 3\nabc\n", packed=packed)
    second = arc(b"2", b"http://a.b/ 1.2.3.4 19991231235958 text/html 404 ABC - 77 x.arc %d\n%s\n" % (len(body), body), packed=packed)
    page, dns = warc.read_arc(first)
    assert (page.fields[b"URL"], page.fields[b"IP-address"], page.content, dns.content) == (b"http://a.b/c d", b"1.2.3.4", body, b"abc")
    (other,) = warc.read_arc(second)
    assert (other.fields[b"Result-code"], other.fields[b"Checksum"], other.fields[b"Filename"]) == (b"404", b"ABC", b"x.arc")

    (made,) = warc.read_warc(warc.to_warc(page, "x.arc"))
    assert made.fields[b"WARC-Type"] == b"response" and made.fields[b"WARC-Date"] == b"1999-12-31T23:59:00Z"
    assert made.fields[b"WARC-Payload-Digest"].decode() == "sha1:" + warc.digest(body.split(b"\r\n\r\n", 1)[1])
    assert made.fields[b"WARC-Record-ID"].decode() == warc.record_id("x.arc", page.offset) != warc.record_id("y.arc", page.offset)
    (made,) = warc.read_warc(warc.to_warc(dns, "x.arc"))
    assert (made.fields[b"WARC-Type"], made.fields[b"Content-Type"], made.content) == (b"resource", b"text/dns", b"abc")
    assert made.fields[b"WARC-Date"] == b"1999-01-01T00:00:00Z"
    (made,) = warc.read_warc(warc.to_warc(page, "x.arc", ("<urn:uuid:1>", "http://a.b/", "1999-12-31T23:59:00Z")))
    assert made.fields[b"WARC-Refers-To"] == b"<urn:uuid:1>" and made.content == b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n"


@pytest.mark.parametrize("bad", [b"no fields\n", b"http://a 1.1.1.1 1999 text/html 99\nshort\n", b"http://a 1.1.1.1 1999 text/html x\n", b"no line end"])
def test_broken_archives_are_errors(bad):
    with pytest.raises(ValueError, match="no ARC record at"):
        list(warc.read_arc(arc(b"1", bad)))
    with pytest.raises(ValueError, match="no ARC version block"):
        list(warc.read_arc(b"http://a 1.1.1.1 1999 text/html 1\nx\n"))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_arc(arc(b"1")[:-9]))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.read_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


# ------------------------------------------------------------------ conversations


def edits_by_brute_force(rows: list[tuple[str, str]], faults: list[str]) -> tuple[int, str, str]:
    """Cost, audit and repaired text: all cheapest ways to each state are kept, whatever their letters."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    made = {"u": "user:", "a": "assistant:"}

    def least(ways: dict) -> dict:
        return {s: {w for w in found if w[0] == min(x[0] for x in found)} for s, found in ways.items()}

    def inserted(ways: dict) -> dict:
        out = {s: set(found) for s, found in ways.items()}
        for _ in range(3):
            for s in list(out):
                for cost, audit, text in list(out[s]):
                    for e in follows[s].replace("s", ""):
                        out.setdefault(e, set()).add((cost + 2, audit + "I", (*text, made[e])))
        return least(out)

    ways = {"": {(0, "", ())}}
    for (role, text), fault in zip(rows, faults, strict=True):
        new: dict = {}
        for s, found in inserted(ways).items():
            for cost, audit, out in found:
                new.setdefault(s, set()).add((cost + 3, audit + "D", out))
                if fault in ("blank", "duplicate"):
                    continue
                extra = fault == "truncated"
                if role[:1] and role[:1] in follows[s]:
                    new.setdefault(role[:1], set()).add((cost + extra, audit + "K", (*out, f"{role}:{text}")))
                for e in follows[s].replace("s", ""):
                    new.setdefault(e, set()).add((cost + 2 + extra, audit + "R", (*out, made[e] + text)))
        ways = least(new)
    ways = inserted(ways)
    cost, audit, out = min((w for s in ("", "a") for w in ways.get(s, ())), key=lambda w: w[:2])
    return cost, audit, "\n".join(out)


def repairs_by_brute_force(table: list[tuple]) -> list[tuple]:
    found: dict = {}
    for conv, turn, role, text in table:
        rows = found.setdefault(conv, [])
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        rows += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    out = []
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(f"{len(r[1])}:{r[1]}{r[2]}")))
        turns = [t for t, _, _ in rows if t is not None]
        faults, seen = [], set()
        for _, role, text in rows:
            bare = text.strip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = edits_by_brute_force([r[1:] for r in rows], faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest(text)))
    return out


TURNS = "conv_id long, turn long, role string, text string, conv string, piece long"


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(["a.", "b", "c!", " \t", None, "d?\n", "é."]), "c", 1) for _ in range(300)]
    rows += [(50, i, "user" if i % 3 else "assistant", f"t{i % 60}.", "", 0) for i in range(90)]  # larger than a piece below
    rows += [(51, 5, "system", "x" * 100_000, None, None), (2**60 + 1, 0, "user", "q.", None, None), *rows[:10]]
    alone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return spark.createDataFrame([*rows, (alone, 0, "user", "gone.", "", 0)], TURNS)


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_repairs_match_brute_force(talks, bits):
    want = repairs_by_brute_force([tuple(r)[:4] for r in talks.collect()])
    got = conversations.repair(talks, bits)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert by_text(got.collect()) == by_text(want)


def test_no_conversations(spark):
    assert conversations.repair(spark.createDataFrame([], TURNS)).collect() == []


def test_every_short_conversation_in_runs_and_pieces():
    kinds = [("s", ""), ("u", ""), ("a", ""), ("x", ""), ("u", "truncated"), ("a", "blank")]
    code = {"": conversations.FINE, "truncated": conversations.CUT, "blank": conversations.BLANK}
    for n in range(5):
        for rows in product(kinds, repeat=n):
            symbols = [conversations.symbol(i, code[f]) for i, f in rows]
            cost, audit, _ = edits_by_brute_force([(i, "") for i, _ in rows], [f for _, f in rows])
            assert conversations.unroll(symbols, conversations.END, conversations.START, True)[:2] == (audit, cost)
            m = conversations.product(symbols)
            assert conversations.across(m, conversations.END)[conversations.START] == cost


def test_powers_of_long_runs():
    s = conversations.symbol("u", conversations.FINE)
    v = conversations.END
    for n in range(1, 70):
        v = conversations.across(conversations.power(s, 0), v)
        assert conversations.crossed(s, n, conversations.END) == v
        assert conversations.across(conversations.product([s] * n), conversations.END) == v
    audit, cost, _ = conversations.unroll([s] * 1000, conversations.END, conversations.START, True)
    assert (cost, audit) == (1000, "KR" * 500)


def test_damage_by_the_key(spark):
    rows = [(c, t, "assistant", "a.b!c?") for c in (None, 1, 2) for t in (None, *range(60))]
    got = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {}
    for r in got.withColumn("k", F.struct("conv_id", "turn")).collect():
        found.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: None, 1: [(role, "")], 2: [(role, "abc")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(lot, [(role, text)])
        assert found.get((c, t)) == want
