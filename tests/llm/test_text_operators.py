"""Operators of the text package on small tables, against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotgrain.llm import boosting, bpe, chosen_path, fm_index, hmm, html_text, labelled, licenses, mtree, quality, rows, toxicity, windows
from lotgrain.llm.queries import vocabulary

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "x"), (5, "é ß 中 \x00 \x1c"), (6, "word " * 5000)]


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def some_texts(n: int, seed: int, vocabulary_size: int = 30, longest: int = 120) -> list[str]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary_size)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, longest))) for _ in range(n)]


# ------------------------------------------------------------------ licenses


def test_license_base_places_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["MIT License", "the", "Apache  license,", "General", "Public", "License", "general-public-license", "mit", "x"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    for doc_id, text in rows:
        words = WORD.findall(lower(text))
        starts, labels = [], set()
        for phrase, label in licenses.BASE.items():
            want = phrase.split()
            for i in range(len(words) - len(want) + 1):
                if words[i : i + len(want)] == want:
                    starts.append(i)
                    labels.add(label)
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (len(words), len(starts))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted(labels))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not starts)


def test_license_wordings_survive_a_change(spark):
    text = "x y licensed under the new apache license version 2.0 z"
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], DOCS)).first()
    assert r.labels == "apache,apache-2.0" and r.n_base == 1 and r.first_word == 6


def test_license_wordings_are_told_apart(spark):
    gpl = "This work is licensed under the GNU {} License version {}"
    want = {
        gpl.format("General Public", 2): "gpl,gpl-2",
        gpl.format("General Public", 3): "gpl,gpl-3",
        gpl.format("Lesser General Public", 3): "gpl",
        "licensed under CC BY 4.0": "cc-by",
        "licensed under CC BY-SA 4.0": "cc-by-sa",
        "licensed under CC BY-NC 4.0": "cc-by-nc",
        "licensed under CC BY-NC-SA 4.0": "",
        "this source code form is subject to the terms of the eclipse public license": "",
    }
    docs = spark.createDataFrame(list(enumerate(want)), DOCS)
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_license_words_are_split_without_an_expression(spark, capsys):
    texts = [None, "", "  ", "A\x00b\x7fÄÖ x--Y z\u3000q 9.", "-a", "[a]`b{c}@d/e:f"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    split = docs.select("doc_id", licenses.words_of("text").alias("w"))
    assert [r.w for r in split.orderBy("doc_id").collect()] == [WORD.findall(lower(t or "")) for t in texts]
    split.explain()
    assert "regexp" not in capsys.readouterr().out


def test_license_odd_rows(spark):
    got = licenses.scan_licenses(spark.createDataFrame([*ODD, (4, "mit license"), (None, "mit license")], DOCS)).collect()
    assert len(got) == len(ODD) + 2
    assert sorted(r.n_words for r in got if r.doc_id == 4) == [1, 1, 2]
    assert sum(r.n_base for r in got) == 2
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------------- html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T &amp; U</h1><p>One  two\n three<br>four<p>Last &eacute;&#233;&#xe9;</article><footer>f</footer>", "T & U\nOne two three four\nLast ééé"),
        ("<nav><a href=x>Home</a></nav><article>Text here<div class='ad'>Buy this now</div>more</article>", "Text here\nmore"),
        ("<article><p>a</p><form><p>Your name</p><input></form><script>var x='</p>'</script><p>b</p>", "a\nb"),
        ("<article><p>text</p></article><section id='comments'><p>What a good article this is</p></section>", "text"),
        ("<article><p>never closed", "never closed"),
        ("<article><p>a < b</p><!-- open comment <p>x</p>", "a < b"),
        ("just a plain text of some more words", "just a plain text of some more words"),
        ("", ""),
        ("<div>" * 3000 + "<article>deep text</article>", "deep text"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page, html_text.fit_tree()) == text


LONG = "<p>" + "some words of a text that is long enough " * 4 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        "<div class='overflow-hidden'>{}</div>", "<div style='overflow:hidden'>{}</div>", "<div data-hidden='x' class='x'>{}</div>",
        "<div class='layout with-sidebar'>{}</div>", "<div class='has-sidebar'><article>{}</article></div>", "<div class=no-sidebar>{}</div>",
        "<div class='page-header-fixed'>{}</div>", "<div class='sidebar-wrapper'><main>{}</main></div>", "<body class='menu hidden-nav'>{}</body>",
        "<div id='comments-page'><div class='text-muted'>x</div>{}</div>",
    ],
)
def test_wrappers_are_no_furniture(page):
    text = "\n".join(["some words of a text that is long enough " * 4] * 3).replace(" \n", "\n").strip()
    found = html_text.main_text(page.format(LONG * 3), html_text.fit_tree())
    assert found.removeprefix("x\n") == text


@pytest.mark.parametrize("part", ["<h2 id='search'>Search</h2>", "<p class='social-story'>A story of ours</p>", "<ul class='tags-list'><li>one tag</li></ul>"])
def test_parts_of_an_article_stay(part):
    kept = html_text.main_text(f"<article>{LONG}{part}{LONG}</article>", html_text.fit_tree()).split("\n")
    assert len(kept) == 3 and kept[1] in part


@pytest.mark.parametrize(
    "part",
    [
        "<div hidden>x y</div>", "<div class='a' HIDDEN='until-found'>x</div>", "<div aria-hidden='true'>x</div>", "<p style='color:red;display: none'>x</p>",
        "<div class='sidebar'>x</div>", "<div class='main-sidebar left'>x</div>", "<div class='ad-container'>x</div>", "<div role='navigation'>x</div>",
        "<section class='comment-list'>" + LONG * 9 + "</section>", "<div id='comments'><article>" + LONG * 4 + "</article></div>", "<div class='cookieNotice'>x</div>",
    ],
)
def test_furniture_goes(part):
    want = html_text.main_text(f"<article>{LONG * 3}</article>", html_text.fit_tree())
    assert want.count("\n") == 2
    for page in (f"{part}<article>{LONG * 3}</article>", f"<article>{LONG * 3}</article>{part}"):
        assert html_text.main_text(page, html_text.fit_tree()) == want
    assert html_text.main_text(f"{LONG * 3}{part}", html_text.fit_tree()) == want


def test_tree_is_right_on_its_pages_and_asks_for_neighbours():
    tree = html_text.fit_tree()
    assert all(tree(row[:-1]) == bool(row[-1]) for row in html_text.labelled_rows())
    used = {html_text.FEATURES[f] for f in tree.feature if f >= 0}
    assert {"words", "links", "links_behind"} <= used and used & {"words_before", "links_before"}


def test_features_of_blocks_match_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        blocks = [(rng.choice("p h2 li div".split()), [(rng.random() < 0.3, rng.randint(0, 6)) for _ in range(rng.randint(1, 4))], rng.random() < 0.2) for _ in range(rng.randint(0, 8))]
        page, want = "", []
        for tag, runs, hidden in blocks:
            inner = " ".join(f"<a href=x>{'w ' * n}</a>" if link else "w " * n for link, n in runs)
            page += f"<nav>{inner}</nav>" if hidden else f"<{tag}>{inner}</{tag}>"
            words, linked = sum(n for _, n in runs), sum(n for link, n in runs if link)
            if words:
                want.append((int(hidden), words, linked / words, int(tag == "h2" and not hidden)))
        got = html_text.features(html_text.blocks(page))
        assert len(got) == len(want)
        for i, (f, words, links, heading) in enumerate(want):
            before, behind = want[i - 1] if i else (0, 0, 0.0, 0), want[i + 1] if i + 1 < len(want) else (0, 0, 0.0, 0)
            assert got[i] == pytest.approx((f, 1, words, links, before[1], before[2], behind[1], behind[2], heading))


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", "<article>x</article>"), (3, "u", "<a " + "b='c' " * 50_000 + ">" + "<!--" * 20_000)]
    rows += [(4, "u", "<article>" + "long text " * 200_000 + "</article>"), (5, "u", "<div class=ad>" * 3000 + "x" + "</div>" * 3000 + "<article>y</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages, keep=["page_id", "url"]).collect()
    assert sorted(r.text for r in got) == ["", "", "", "", ("long text " * 200_000).strip(), "x", "y"]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


# ----------------------------------------------------------------------- hmm


def test_forward_and_expected_counts_match_enumeration():
    model = hmm.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.3, 0.3], [0.2, 0.6]]))
    sequences = [np.array([0, 2, 1, 1]), np.array([1]), np.array([2, 2, 0])]
    starts, steps, emissions, logs = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), []
    for s in sequences:
        total, a, b, c = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
        for path in product(range(2), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for i in range(1, len(s)):
                p *= model.step[path[i - 1], path[i]] * model.emit[s[i], path[i]]
            total += p
            a[path[0]] += p
            for i, k in enumerate(path):
                c[s[i], k] += p
                if i:
                    b[path[i - 1], k] += p
        starts, steps, emissions = starts + a / total, steps + b / total, emissions + c / total
        logs.append(math.log10(total))
    flat, sizes = np.concatenate(sequences), np.array([len(s) for s in sequences])
    assert np.allclose(model.forward(flat, sizes), logs)
    for got, want in zip(model.expected(flat, sizes), (starts, steps, emissions), strict=True):
        assert np.allclose(got, want)


def test_long_sequences_in_pieces_match_steps():
    rng = np.random.default_rng(1)
    model = hmm.Model(np.array([0.5, 0.5]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([[0.5, 0.1], [0.5, 0.9]]))
    for n in (hmm.PIECE, hmm.PIECE + 1, hmm.PIECE + 2, 2 * hmm.PIECE + 1, 7000):
        s = rng.integers(0, 2, n)
        alpha, log = model.start * model.emit[s[0]], 0.0
        for x in s[1:]:
            total = alpha.sum()
            alpha, log = (alpha / total) @ model.step * model.emit[x], log + math.log10(total)
        assert math.isclose(model.forward(s, np.array([n]))[0], log + math.log10(alpha.sum()), rel_tol=1e-9)


def test_expected_counts_of_long_sequences_match_the_uncut_recursion(monkeypatch):
    rng = np.random.default_rng(4)
    model = hmm.Model(np.array([0.5, 0.3, 0.2]), rng.dirichlet([3, 1, 1], 3), rng.dirichlet([1] * 5, 3).T.copy())
    sequences = [rng.integers(0, 5, n) for n in (5000, 1, hmm.STRETCH, hmm.STRETCH + 1, 3 * hmm.STRETCH, 70, 2)]
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    for s in sequences:
        alphas, betas, scales = np.empty((len(s), 3)), np.ones((len(s), 3)), np.empty(len(s))
        for t, x in enumerate(s):
            now = (model.start if t == 0 else alphas[t - 1] @ model.step) * model.emit[x]
            scales[t] = now.sum()
            alphas[t] = now / scales[t]
        for t in range(len(s) - 2, -1, -1):
            betas[t] = model.step @ (model.emit[s[t + 1]] * betas[t + 1]) / scales[t + 1]
        gammas = alphas * betas
        want[0] += gammas[0]
        for t, x in enumerate(s):
            want[2][x] += gammas[t]
            if t:
                want[1] += np.outer(alphas[t - 1], model.emit[x] * betas[t]) * model.step / scales[t]
    for held in (hmm.HELD, 1500):
        monkeypatch.setattr(hmm, "HELD", held)
        got = model.expected(np.concatenate(sequences), np.array([len(s) for s in sequences]))
        for g, w in zip(got, want, strict=True):
            assert np.allclose(g, w)


def test_lm_base_scores_match_brute_force_and_model_learns(spark):
    rng = random.Random(5)
    kinds = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60)) + f" only{i} RARE") for i in range(300)] + ODD
    got = hmm.score_held_out(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    words = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), held(d), len(words(t)), sum(w in counts for w in words(t)), total,
         round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words(t)), 6))
        for d, t in rows
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_lm_empty_table(spark):
    assert hmm.score_held_out(spark.createDataFrame([], DOCS)).count() == 0


# --------------------------------------------------------------------- m-tree


def test_top_k_matches_brute_force_with_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(300, 8)), 1)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(i, [0.5] * 8) for i in range(300, 460)]
    bad = [(1000, None), (1020, [float("nan")] + [0.0] * 7), (1040, [None] + [0.0] * 7), (1060, [float("inf")] * 8), (None, [0.1] * 8)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in mtree.top_k(table, k=7, every=20, pivots=8, page_rows=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows}
    asked = [i for i in whole if i % 20 == 0]
    assert sorted(got) == asked
    for q in asked:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:7]
        assert got[q] == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_top_k_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (20, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in mtree.top_k(few).orderBy("query_id", "rank").collect()] == [(0, 1, 20), (0, 2, 20), (20, 1, 0)]
    assert mtree.top_k(few.limit(0)).count() == 0


def test_top_k_is_exact_for_large_components(spark):
    rows = [(0, [1.0, 0.0]), (1, [4e7, 1.0]), (20, [-1.5e7, 2.5]), (40, [1.2e7 + 1 / 64, 3e7]), (41, [1.2e7, 3e7 + 1 / 64]), (60, [0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, score long, pivot string")
    got = {(r.query_id, r.vec_id): r.score for r in mtree.top_k(table).collect()}
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    assert got == {(q, i): sum(a * b for a, b in zip(whole[q], whole[i])) for q in (0, 20, 40, 60) for i in whole if i != q}
    assert got[0, 1] == 163_840_000_000


def test_top_k_refuses_what_it_cannot_answer_exactly(spark):
    schema = "vec_id long, embedding array<double>"
    with pytest.raises(ValueError, match="different lengths"):
        mtree.top_k(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], schema))
    with pytest.raises(ValueError, match="too long"):
        mtree.top_k(spark.createDataFrame([(0, [1.0]), (1, [1e9])], schema))


# ------------------------------------------------------------------------ bpe


@pytest.fixture(scope="module")
def merges():
    return bpe.load(vocabulary())


def test_encoding_and_decoding_match_the_library(merges):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    encoder, decoder = bpe.Encoder(merges), bpe.Decoder(merges)
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "the", "ing", "'s", "'", "É", "ß", "1", "23", "½", "!", "<|endoftext|>", "\xa0", "\x1c", "　", "中", "😀", "́", "aaaa", "==", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["=" * 5000 + "a" * 3000 + " " * 4000 + "x", "".join(rng.choice("abcdein") for _ in range(20_000)), " a" * 100_000]
    for text in texts:
        ids = [i for part in encoder.stream(text) for i in part]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert "".join(decoder.stream([[i] for i in ids])) == library.decode(ids, skip_special_tokens=False)


def test_decoder_on_any_ids(merges):
    from tokenizers import Tokenizer

    library, decoder = Tokenizer.from_file(vocabulary()), bpe.Decoder(merges)
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 6))]
        assert "".join(decoder.stream([[i] for i in ids])) == library.decode(ids, skip_special_tokens=False)


def test_lookahead_bounds_what_is_held(merges):
    piece = ("abcdefghij" * 2000).encode()
    tokens = merges.encode_piece(piece)
    next(tokens)
    frame = tokens.gi_frame
    assert len(frame.f_locals["last"]) <= 4 * merges.reach + 1
    assert merges.reach == 128


def test_bpe_words_of_one_piece_share_their_tokens(merges):
    encoder = bpe.Encoder(merges)
    list(encoder.stream("some words stand here some 12ab"))
    assert encoder.words["words"] is encoder.pieces[" words"]
    assert all(isinstance(pair, int) for pair in merges.fits)


def test_what_a_worker_keeps_goes_with_the_next_operator():
    first = rows.kept(1, lambda: [1])
    assert rows.kept(1, lambda: [2]) is first
    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    list(rows.slices(iter([batch]), "text", keeps=1))
    assert rows.kept(1, lambda: [2]) is first
    list(rows.slices(iter([batch]), "text"))
    assert rows.kept(1, lambda: [2]) == [2]
    rows.let_go()


def test_bpe_short_pieces_are_tried_without_the_walk(merges):
    fresh = pickle.loads(pickle.dumps(merges))
    rng = random.Random(8)
    pieces = [b"".join(rng.choices([t for t in merges.tokens[:3000]], k=rng.randint(1, 6)))[: bpe.SHORT] for _ in range(3000)]
    pieces += [bytes(rng.choices(range(256), k=rng.randint(1, bpe.SHORT))) for _ in range(500)]
    got = [list(fresh.encode_piece(p)) for p in pieces]
    assert fresh.endings is None
    assert got == [merges._tokens(merges._lasts(p), 0, 0, len(p)) for p in pieces]


def test_bpe_tables_of_words_stay_the_same_objects(merges, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder(merges)
    words, pieces = encoder.words, encoder.pieces
    text = " ".join(f"word{i}x" for i in range(50))
    once = [i for ids in encoder.stream(text) for i in ids]
    assert encoder.words is words and encoder.pieces is pieces and max(len(words), len(pieces)) <= 10
    assert once == [i for ids in bpe.Encoder(merges).stream(text) for i in ids]


def test_bpe_odd_rows(spark, merges):
    got = bpe.digests(spark.createDataFrame(ODD, DOCS), merges, keep=["doc_id"]).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert {r.ids_sha256 for r in got if r.doc_id in (1, 2)} == {nothing}
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    assert sorted(r.decoded_sha256 for r in got) == want
    assert bpe.digests(spark.createDataFrame([], DOCS), merges).count() == 0


# -------------------------------------------------------------------- windows


def spans_by_brute_force(texts: list[str], size: int) -> list[set[int]]:
    places = defaultdict(list)
    words = [SPACED.findall(t or "") for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - size + 1):
            places[tuple(w[i : i + size])].append((d, i))
    out = [set() for _ in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                out[d].update(range(i, i + size))
    return out


@pytest.mark.parametrize("flush", [50, 1 << 20])
def test_repeated_spans_match_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(windows, "FLUSH_WORDS", flush)
    texts = some_texts(80, 1, 6, 60) + ["a b c d e f"] * 20 + ["z " * 400, None, "", " \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)
    want = spans_by_brute_force(texts, 5)
    for r in windows.with_spans(docs, 5).collect():
        got = [i for s in r.spans or [] for i in range(s["start"], s["end"])]
        assert got == sorted(want[r.doc_id])
        assert all(a["end"] < b["start"] for a, b in zip(r.spans or [], (r.spans or [])[1:], strict=False))


def test_remove_repeats_keeps_the_rest_as_it_is(spark):
    same = " ".join(f"s{i}" for i in range(40))
    rows = [(1, f"One  two\n{same}\tthree ", 9), (2, f"{same} x", 9), (None, "\tleft  alone\n", 9), (3, None, 9), (4, same, 9), (4, same, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int").withColumns({"k1": F.lit(1), "removal_spans": F.lit(2)})
    got = {(r.doc_id, r.text, r.spans) for r in windows.remove_repeats(docs).collect()}
    assert got == {(1, "One  two\n\tthree ", 9), (2, " x", 9), (None, "\tleft  alone\n", 9), (3, None, 9), (4, "", 9)}
    assert windows.remove_repeats(docs).columns == docs.columns
    assert windows.remove_repeats(docs.limit(0)).count() == 0


def test_lost_answers_raise(spark):
    finish = windows._covered(5, f"k1 long, k2 long, spans {windows.SPANS}")
    import pyarrow as pa

    from lotgrain.llm.rows import arrow_schema

    row = {"bucket": 0, "flush": 1, "header": True, "payload": b"", "k1": [1], "k2": [1], "sizes": [9], "blocks": 2}
    with pytest.raises(RuntimeError, match="0 of 2 answers"):
        list(finish(iter([pa.RecordBatch.from_pylist([row], arrow_schema(windows.BLOCK))])))


# ------------------------------------------------------------------- boosting


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    p = trees.probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95
    curve = boosting.fit_isotonic(p, y[2000:])
    assert (np.diff(curve(np.linspace(0, 1, 50))) >= 0).all()
    assert abs(curve(p).mean() - y[2000:].mean()) < 0.02
    one_by_one = []
    for row in x[2000:2020]:
        total = trees.start
        for f, limit, value in zip(trees.feature, trees.limit, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > limit[node])
            total += value[node - len(f)]
        one_by_one.append(total)
    assert np.allclose(one_by_one, trees.margin(x[2000:2020]))


def test_fit_without_rows_or_with_one_class():
    assert np.allclose(boosting.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))), 0.5)
    assert (boosting.fit(np.zeros((4, 3)), np.ones(4)).probability(np.zeros((2, 3))) > 0.8).all()


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(["alpha", "beta", "gamma", "the", "of", "delta"]) for _ in range(40)]
        toxic, good = i % 7 == 0, i % 5 != 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["idiot", "zorkus", "zorkan", "1d10t"])
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (7, 1, 1), (10**6, 0, 1)]
    return spark.createDataFrame(rows + ODD, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, judged):
    got = quality.score_held_out(*judged)
    truth = got.join(judged[1], "doc_id").where("held_out and quality is not null").collect()
    assert sum(r.predicted == r.quality for r in truth) > 0.95 * len(truth)
    assert got.where("score is null or score < 0 or score > 1").count() == 0 and got.count() == judged[0].count()


def test_toxicity_on_held_out_rows(spark, judged):
    got = toxicity.score_held_out(*judged)
    truth = got.join(judged[1], "doc_id").where("held_out and toxic is not null").collect()
    assert sum(r.predicted == r.toxic for r in truth) > 0.95 * len(truth)
    assert got.where("score is null or score < 0 or score > 1").count() == 0 and got.count() == judged[0].count()
    clash = judged[0].withColumn("toxicity", F.lit("as it was"))
    stay = toxicity.reject(clash, judged[1])
    assert stay.columns == clash.columns and 0 < stay.count() < clash.count()
    assert stay.where("toxicity != 'as it was'").count() == 0


def test_sample_holds_one_row_for_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (None, "x"), (3, "c")] + [(4, f"t{i}") for i in range(50)], DOCS)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", F.lit(True)).collect()
    assert sorted((r.doc_id, r.text, r.target) for r in got) == [(1, "a", 1), (2, None, 1), (4, "t0", 0)]


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_kind_reject_nothing(spark, toxic):
    rows = [(i, f"text {i}") for i in range(30)] + [(None, None), (31, "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, toxic) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.reject(docs, labels).count() == len(rows)


def test_classifiers_without_labels_or_documents(spark, judged):
    docs, labels = judged
    for scored in (quality.score_held_out, toxicity.score_held_out):
        assert scored(docs, labels.limit(0)).where("score is null").count() == 0
        assert scored(docs.limit(0), labels).count() == 0


# ---------------------------------------------------------------- chosen path


def near_by_brute_force(rows: list[tuple], size: int, percent: int) -> dict[int, tuple]:
    sets = {}
    for d, t in rows:
        w = SPACED.findall(lower(t))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(9)
    rows = []
    for base in some_texts(60, 2, 400, 90):
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = base.split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = f"n{rng.random()}"
            rows.append(" ".join(words))
    hub = " ".join(f"h{i}" for i in range(100)).split()
    for i in range(60):  # a large group of near copies
        copy = list(hub)
        copy[i] = f"c{i}"
        rows.append(" ".join(copy))
    base = [f"b{i}" for i in range(100)]
    rows.append(" ".join(base))
    for i in range(0, 90, 2):  # a large group whose members are linked with their common source alone
        copy = list(base)
        copy[i], copy[i + 1] = f"d{i}", f"e{i}"
        rows.append(" ".join(copy))
    rows += ["exact copy of a text"] * 40 + ["Exact  COPY of a text", "two words", "two  words", "", " ", None]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, near_rows, size, percent):
    docs = spark.createDataFrame(near_rows, DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(docs, size, percent).collect()}
    assert got == near_by_brute_force(near_rows, size, percent)


@pytest.mark.parametrize("depths", [(1,), (1, 3, 12)])
def test_groups_larger_than_a_leaf(spark, monkeypatch, depths):
    # Tiny leaves: groups have to be found through their popular classes.
    monkeypatch.setattr(chosen_path, "LEAF", 2)
    monkeypatch.setattr(chosen_path, "ROUNDS", [(d, 1e-4) for d in depths])
    rng = random.Random(1)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)] if g else [f"g1w{i}" for i in range(45)] + [f"x{i}" for i in range(15)]
        for _ in range(12):
            copy = list(base)
            copy[rng.randrange(60)] = f"n{rng.random()}"
            rows.append(" ".join(copy))
    docs = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(spark.createDataFrame(docs, DOCS), 3, 80).collect()}
    assert got == near_by_brute_force(docs, 3, 80)


@pytest.mark.parametrize("depths", [None, (1,)])
def test_a_large_group_without_a_hub(spark, monkeypatch, depths):
    # 400 edits of a text that is not there: each is linked with one other at most, and close to all of them.
    if depths:
        monkeypatch.setattr(chosen_path, "ROUNDS", [(d, 1e-4) for d in depths])
    monkeypatch.setattr(chosen_path, "BLOCK", 32)
    rng = random.Random(12)
    rows = []
    for i in range(200):
        places = rng.sample(range(5, 195, 6), 7)
        for edited in (places[:3], places):
            words = [f"w{n}" for n in range(200)]
            for n in edited:
                words[n] = f"e{i}x{n}"
            rows.append(" ".join(words))
    docs = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(spark.createDataFrame(docs, DOCS), 5, 80).collect()}
    assert got == near_by_brute_force(docs, 5, 80)


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_keep_pairs_at_the_threshold(percent):
    rng = np.random.default_rng(3)
    for depth, loss in chosen_path.ROUNDS[:5]:
        n = chosen_path.trees(percent, depth, loss)
        assert (1 - (percent / 100) ** depth) ** n <= loss
        paths, met = chosen_path.Paths(depth, n), 0
        for _ in range(150):
            words = rng.integers(0, 1 << 63, 200, np.uint64)
            alone = 100 - percent
            met += (paths.of(words[: 200 - alone]) == paths.of(np.r_[words[: 200 - 2 * alone], words[200 - alone :]])).any()
        # Of 150 pairs just at the threshold none is expected to miss, or one or two in the deep rounds.
        assert met >= (150 if loss < 1e-3 else 145)


def test_every_size_band_of_a_node_has_a_pivot(spark):
    # The most popular class is far too long for the others, which differ in size as well.
    sizes = {0: 5000, **{i: 100 for i in range(1, 20)}, **{i: 115 for i in range(20, 40)}}
    nodes = spark.createDataFrame([(7, c, n, 40, c) for c, n in sizes.items()], "path long, cls long, n_shingles long, members long, root long")
    popular = spark.createDataFrame([(c, 900 if c == 0 else 40) for c in sizes], "cls long, popular long")
    pairs = [(r.a, r.b) for r in chosen_path._stars(nodes, popular, 80).collect()]
    assert all(100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b]) for a, b in pairs)
    links = spark.createDataFrame(pairs, "a long, b long")
    assert {r.cls: r.root for r in chosen_path.components(links).collect()} == {c: 1 for c in sizes if c}


def test_near_duplicates_odd_rows(spark):
    rows = [*ODD, (9, "same text as null id here"), (None, "same text as null id here"), (None, "alone with no id at all")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(7))
    got = chosen_path.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles == 2 and r.component_id) == [(9, False)]
    stay = chosen_path.drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    # One of the two equal rows with id 4, and one of the two texts that are the same, goes.
    assert stay.count() == len(rows) - 2
    assert chosen_path.drop_near_duplicates(docs.limit(0)).count() == 0


def test_recall_within_a_large_group_of_almost_alike_texts(spark, monkeypatch):
    # Copies of a text that change more or less of it, most pairs below the threshold, and copies of copies that are
    # near them alone. Small leaves and dear pairs send what is open through all rounds.
    monkeypatch.setattr(chosen_path, "LEAF", 4)
    monkeypatch.setattr(chosen_path, "PAIR_ROWS", 1000)
    monkeypatch.setattr(chosen_path, "ROUNDS", chosen_path.ROUNDS[:4])
    rng = random.Random(6)
    rows = []
    for i in range(350):
        words = [f"w{n}" for n in range(150)]
        for n in rng.sample(range(150), rng.randint(3, 14)):
            words[n] = f"e{i}x{n}"
        rows.append(" ".join(words))
        if i % 3 == 0:
            for n in rng.sample(range(150), 2):
                words[n] = f"f{i}x{n}"
            rows.append(" ".join(words))
    docs = list(enumerate(rows))
    want = near_by_brute_force(docs, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(spark.createDataFrame(docs, DOCS), 3, 85).collect()}
    assert len({w[1] for w in want.values()}) > 50
    same = sum(got[d] == want[d] for d in want)
    assert same >= 0.99 * len(want)
    # Links are confirmed, so components can only be too small.
    assert all(want[got[d][1]][1] == want[d][1] for d in want)


def test_unlinked_copies_of_a_text_need_no_deeper_trees(spark, monkeypatch):
    # Copies of one text with words of their own, all too far from it and from one another, and twins that share theirs.
    def never(*_):
        raise AssertionError("shared rare shingles settle this")

    monkeypatch.setattr(chosen_path, "_deeper", never)
    monkeypatch.setattr(chosen_path, "_open_pairs", never)
    rng = random.Random(21)
    rows = [" ".join(f"w{n}" for n in range(150))]
    for i in range(200):
        words = [f"w{n}" for n in range(150)]
        for n in rng.sample(range(150), rng.randint(8, 10)):
            words[n] = f"e{i}x{n}"
        rows.append(" ".join(words))
        if i % 20 == 0:
            words[rng.randrange(150)] = f"f{i}"
            rows.append(" ".join(words))
    docs = list(enumerate(rows))
    want = near_by_brute_force(docs, 3, 85)
    assert sum(not w[2] for w in want.values()) == 10
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(spark.createDataFrame(docs, DOCS), 3, 85).collect()}
    assert got == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.cls: r.root for r in chosen_path.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ------------------------------------------------------------------- fm-index


def hits_by_brute_force(words: list[str], items: list[tuple], window: int) -> tuple[set[int], set[str]]:
    hit, named = set(), set()
    for item, text in items:
        own = WORD.findall(lower(text))
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    named |= {str(item)} if item is not None else set()
    return hit, named


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 20_000), (40, 3)])
def test_scan_matches_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(fm_index, "SHARD_WORDS", shard)
    items = list(enumerate(some_texts(12, 3, 5, 9))) + [(None, "w1 w2 w3 w4 w0"), (20, None), (21, ""), (22, "W1!"), (22, "w2 w2 w2 w2")]
    rows = [(i, t.replace(" ", ", ")) for i, t in enumerate(some_texts(60, 4, 6, 60))] + [(100, None), (101, ""), (102, "w1 " * 300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in fm_index.scan(docs, bench, 4, block_items=block).collect():
        words = WORD.findall(lower(dict(rows)[r.doc_id]))
        hit, named = hits_by_brute_force(words, items, 4)
        assert r.n_words == len(words)
        assert [i for s in r.hit_spans for i in range(s["start"], s["end"])] == sorted(hit)
        assert r.hit_items == sorted(named)


def test_index_finds_all_places():
    rng = np.random.default_rng(5)
    text = np.r_[rng.integers(1, 4, 200), 0, rng.integers(1, 4, 50), 0, [2, 2, 2], 0]
    index = fm_index.FMIndex(text, 4)
    patterns = np.array(list(product([1, 2, 3], repeat=3)))
    low, high = index.find(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_remove_hits(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"Keep, this. {passage.upper()}! And this", 3), (2, None, 3), (3, "clean  text\n", 3), (3, "clean  text\n", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_words) for r in fm_index.remove_hits(docs, bench).collect())
    assert got == [(1, "Keep, this. ! And this", 3), (2, None, 3), (3, "clean  text\n", 3), (3, "clean  text\n", 3)]
    assert fm_index.remove_hits(docs.limit(0), bench).count() == 0
    assert fm_index.remove_hits(docs, bench.limit(0)).count() == 4
