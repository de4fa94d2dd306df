"""Counts, perplexity, language, quality, toxicity and page rendering."""

import collections
import random
import time
import re

import numpy as np
import pyarrow as pa
import pytest
from docloom.llm import language, perplexity, rff_quality, toxicity
from docloom.llm.html_text import extract, page_text
from docloom.llm.textstats import base_counts, features
from docloom.llm.textvec import slices

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    spans = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if spans[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_base_counts(size):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["a", "b", " ", "\n", "#", "é", "ab ", "\t", ""]) for _ in range(draw.randint(0, 40))) for _ in range(2000)] + [None, "", "a\na\na", "a a a a a a a"]
    for piece in slices(pa.array(texts), size):
        got, x = base_counts(piece), features(piece)
        assert np.isfinite(x).all() and len(x) == piece.n
        for k in range(piece.n):
            assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(texts[piece.first + k] or "")


def test_kneser_ney_sums_to_one():
    draw = np.random.default_rng(1)
    code, n = np.unique(draw.integers(0, 40, 3000) ** 2 % 40 + 40 * (draw.integers(0, 6, 3000) + 40 * (draw.integers(0, 5, 3000) + 40 * draw.integers(0, 4, 3000))), return_counts=True)
    model = perplexity.KneserNey(code, n)
    for context in [*np.unique(code // 40)[:20].tolist(), 39 * 40 * 40 + 7, 0]:
        p = np.exp(model.log_probability(context * 40 + np.arange(40)).astype(float))
        assert p.sum() == pytest.approx(1, abs=2e-4) and (p > 0).all()
    seen, unseen = model.log_probability(code[n == n.max()]), model.log_probability(np.array([39 * 40**3 + 39 * 1600 + 39 * 40 + 38]))
    assert seen.min() > unseen[0]


def test_tables_of_ranges(spark, monkeypatch):
    draw = np.random.default_rng(5)
    code, n = np.unique((draw.zipf(1.3, 6000) * 7919) % 40**4, return_counts=True)
    memory = perplexity.KneserNey(code, n)
    monkeypatch.setattr(perplexity, "_RANGE_ROWS", 300)
    model = perplexity.tables(spark.createDataFrame(list(zip(code.tolist(), n.tolist(), strict=True)), "code long, n long"), 40, 4)
    assert [len(ranges) > 1 for ranges in model.orders] == [False, True, True, True]
    asked = np.unique(np.concatenate([code, draw.integers(0, 40**4, 3000)]))
    assert np.allclose(model.log_probability(asked), memory.log_probability(asked), atol=1e-4)


def test_model_reads_all_bytes(spark):
    draw = random.Random(9)
    texts = [" ".join(draw.choice("река течёт среди старых камней много деревьев вода поёт".split()) for _ in range(60)) for _ in range(200)]
    # each letter replaced by another of the same lead byte whose second byte differs by a multiple of 3
    letters = [chr(x) for x in range(0x410, 0x450)]
    alike = lambda c, x: x != c and x.encode()[0] == c.encode()[0] and (x.encode()[1] - c.encode()[1]) % 3 == 0
    odd = "".join(c if c == " " else draw.choice([x for x in letters if alike(c, x)]) for c in texts[0])
    rows = [*enumerate(texts), (900, odd)]
    got = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame([(i, t, "ru") for i, t in rows], "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(200)) and not got[900].base_failed and not got[900].kept


def test_bands_reject_junk_of_any_length(spark):
    draw = random.Random(12)
    parts = "th er ing on at an in re ed ou ha wh le st nd".split()
    words = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(400)]
    clean = [" ".join(draw.choice(words) for _ in range(draw.choice([40, 80, 160, 320]))) for _ in range(1200)]
    junk = [" ".join(draw.choice(words) + (" |" if k % 4 == 0 else "") for k in range(draw.choice([160, 320]))) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(clean + junk)]
    got = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[i].kept for i in range(1200)) and not any(got[i].kept for i in range(1200, 1230))


def test_quality_rules(spark):
    draw = random.Random(2)
    vocabulary = [["the", "river", "runs", "over", "old", "stones", "and", "water", "sings", "with", "many", "trees", "near"], ["der", "alte", "fluss", "geht", "durch", "das", "tal", "wo", "viele", "steine", "liegen", "und"]]
    rows = [(i, " ".join(draw.choice(vocabulary[i % 2]) for _ in range(60)), ["en", "de"][i % 2]) for i in range(200)]
    rows += [(900, "".join(draw.choice("qxzjkvw") + draw.choice(" qxz") for _ in range(400)), "en"), (901, None, None), (902, "few words", "en"), (903, "a b c d e " * 9, "de")]
    got = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and all(got[i].kept for i in range(200)) and not got[900].kept and not got[900].base_failed
    assert [got[i].base_failed for i in (901, 902, 903)] == [True] * 3 and not any(got[i].kept for i in (901, 902, 903))
    assert (got[901].n_words, got[901].log_perplexity) == (0, None)
    assert perplexity.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, n_words int")).count() == 0


def test_language(spark):
    draw = random.Random(4)
    words = {"en": "the and house with water that tree over".split(), "fr": "les dans maison avec été eau arbre où".split(), "de": "der und haus mit wasser dass baum über".split()}
    rows = [(i, " ".join(draw.choice(words[x]) for _ in range(40)), x, "a") for i, x in enumerate(["en", "fr", "de"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(df.where("doc_id % 4 != 2"))
    tests = [(1000, None, "en", ""), (1001, "12 . !", "en", ""), (1002, "", None, ""), (1003, "日本", None, ""), (1004, "a", None, ""), (None, "LES ÉTÉ DANS MAISON AVEC", "en", "")]
    got = {r.doc_id: r for r in language.identify(df.union(spark.createDataFrame(tests, df.schema)), model).collect()}
    assert all(got[i].lang_pred == x for i, _, x, _ in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred != "und" != got[1004].lang_pred and got[None].lang_pred == "fr"
    nothing = language.fit(df.where("false"))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"} and language.identify(df.where("false"), model).count() == 0


def plain_hash(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % (1 << 64)
    return x ^ x >> 31


@pytest.mark.parametrize("count", [1, 3, 8, 9, 66])
@pytest.mark.parametrize("size", [30, 1 << 16])
def test_shares_are_those_of_plain_python(count, size):
    """Looked up n-grams, per-language popcounts and their correction, one n-gram at a time."""
    texts = ["", "a", "The  cat, 12 sat", "ÀB é", "日本語 текст", "x" * 300, None, "über alles   in der Welt " * 9, "ab"]
    slot_bits, hashes, words = 10, 3, -(-count // 64)
    draw = np.random.default_rng(count)
    masks = draw.integers(0, 1 << 63, (1 << slot_bits, words)).astype(np.uint64) << np.uint64(1) | draw.integers(0, 2, (1 << slot_bits, words)).astype(np.uint64)
    masks[:, -1] &= np.uint64((1 << (count - 64 * (words - 1))) - 1)
    model = language.BloomMasks([f"l{k:02d}" for k in range(count)], [1] * count, masks, hashes)
    whole = [sum(int(m) << 64 * w for w, m in enumerate(row)) for row in masks]
    got = [(row, n) for piece in slices(pa.array(texts), size) for row, n in zip(*model.shares(piece), strict=True)]
    for text, (row, n) in zip(texts, got, strict=True):
        letters = "".join(c if c.isascii() and c.isalpha() or ord(c) > 0x7F else " " for c in (text or "").lower()).encode()
        grams = [letters[i : i + w] for w in language.WIDTHS for i in range(len(letters) - w + 1) if b"  " not in letters[i : i + w]]
        found = [0] * count
        for g in grams:
            value = plain_hash(int.from_bytes(bytes([len(g)]) + g))
            mask = -1
            for k in range(hashes):
                mask &= whole[(value + k * (value >> 32 | 1)) % (1 << slot_bits)]
            for k in range(count):
                found[k] += mask >> k & 1
        assert n == len(grams)
        for k in range(count):
            false = min(0.95, (sum(m >> k & 1 for m in whole) / len(whole)) ** hashes)
            assert row[k] == pytest.approx(max(0, (found[k] / max(1, len(grams)) - false) / (1 - false)), abs=1e-12)


def test_many_languages_and_filter_slots(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}qz" * 20, f"l{i:02d}") for i in range(70) for _ in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, bits=16)
    assert model.masks.shape[1] == 2 and all(r.lang_pred == r.lang for r in language.identify(df, model, keep=["doc_id", "lang"]).collect())


def test_isotonic():
    draw = np.random.default_rng(0)
    value, weight = draw.normal(size=50) + np.arange(50) / 20, draw.integers(1, 9, 50).astype(float)
    fit = rff_quality.isotonic(value, weight)
    assert (np.diff(fit) >= -1e-12).all() and fit @ weight == pytest.approx(value @ weight)
    for level in np.unique(fit):
        assert level == pytest.approx(np.average(value[fit == level], weights=weight[fit == level]))


def test_quality_scores(spark):
    draw = random.Random(6)
    good = lambda: ". ".join(" ".join(draw.choice(["plain", "words", "in", "a", "row", "again", "here"]) for _ in range(9)).capitalize() for _ in range(6))
    bad = lambda: " ".join(draw.choice(["BUY!!", "$$$", "NOW!!", "| |", "***"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, None), (9999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, quality int")
    stats = rff_quality.statistics(docs)
    got = {r.doc_id: r for r in rff_quality.score(stats, rff_quality.fit(stats, labels, dimensions=64)).collect()}
    assert all(got[i].predicted == (i % 3 > 0) for i in range(600)) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and len(got) == 602
    assert {r.score for r in rff_quality.score(stats, rff_quality.fit(stats, labels.where("false"))).collect()} == {0.5}


def test_toxicity(spark):
    draw = random.Random(8)
    words = [f"w{c}{d}ord" for c in "abcdefgh" for d in "klmn"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(30)) + (" Insult " + draw.choice(["insulting", "vile"]) if i % 4 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, None), (9999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), i % 2) for i in range(300)] + [(2, None, 1)], "doc_id long, toxic int, quality int")
    chain = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.predict(docs, chain).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(600)) and len(got) == 602 and got[9999].predicted == got[None].predicted == 0
    assert len(chain.weights[2]) == len(chain.weights[0]) + 2  # the last model sees both earlier categories
    alone = {"toxic": "toxic = 1"}
    assert {r.predicted for r in toxicity.predict(docs, toxicity.fit(docs, labels.where("toxic = 0").drop("quality"), categories=alone)).collect()} == {0}
    empty = docs.where("doc_id = -1")
    assert toxicity.predict(empty, chain).count() == 0 and toxicity.predict(docs, toxicity.fit(empty, labels)).count() == 602


def test_chain_is_sequential():
    """Against a chain in plain loops: each model is trained on out-of-fold, and applied to actual, earlier probabilities."""
    draw = np.random.default_rng(3)
    x = (draw.random((240, 6)) < 0.4).astype(np.float32)
    y = np.column_stack([x[:, 0], (x[:, 1] + x[:, 0] > 1) | (draw.random(240) < 0.1), x[:, 2]]).astype(float)
    fold, used = draw.integers(0, 3, 240), draw.random((4, 6)) < 0.8
    weights = toxicity.fit_chain(x, y, fold, used)
    earlier = []
    for k in range(3):
        mine = [np.array([[*row[u], *[e[i] for e in earlier]] for i, row in enumerate(x)], np.float32) for u in used]
        assert np.allclose(weights[k], toxicity.logistic(mine[3], y[:, k]))
        out = np.zeros(240)
        for j in range(3):
            w = toxicity.logistic(mine[j][fold != j], y[fold != j, k])
            for i in np.flatnonzero(fold == j):
                out[i] = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(mine[j][i], w[:-1], strict=True)) + w[-1])))
        earlier.append(out)
    chain = toxicity.Chain(toxicity.Terms(np.arange(used[3].sum(), dtype=np.uint64)), ["a", "b", "c"], weights)
    p = chain.probabilities(x[:, used[3]])
    for i in range(0, 240, 40):
        seen = []
        for w in weights:
            seen.append(1 / (1 + np.exp(-(sum(a * b for a, b in zip([*x[i, used[3]], *seen], w[:-1], strict=True)) + w[-1]))))
        assert np.allclose(p[i], seen)


def test_terms_are_whole_words():
    piece = next(slices(pa.array(["Straightforwardly straightforwardness", "доброжелательный", "", "很好的东西"])))
    gram, text = toxicity.terms_of(piece)
    by_text = [set(gram[text == i].tolist()) for i in range(4)]
    assert [len(s) for s in by_text] == [2, 1 + 14, 0, 1 + 4]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b<br>c", "a\n\nb\nc"),
        ("<title>t</title><script>if (a < b) x('</p>')</script><style>p{}</style><noscript>n</noscript>x<!-- c -->y", "xy"),
        ("<div hidden>a</div><p style='color:red; display : none'>b</p><span aria-hidden=true>c</span><i style='visibility:hidden'>d</i>e", "e"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
        ("<table><tr><th>Name<th>N<tr><td>long cell<td>1</table>", "Name      | N\nlong cell | 1"),
        ("<table><td>a<br>b<td>c</table>", "a | c\nb |"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>aa<td>bb<td>y</table>", "wide    | x\naa | bb | y"),
        ("a<pre> x\n  y</pre>b", "a\n\n x\n  y\n\nb"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<h1>T</h1>x<b>y</i>z</b>", "T\n\nxyz"),
        ("a  \n b<span> c</span>", "a b c"),
        ("<a href='x>y'>l</a><p", "l<p"),
        ("1 < 2 <3", "1 < 2 <3"),
    ],
)
def test_pages(html, text):
    assert page_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<ol start="--1"><li value="--5">a<li value="-3">b<li value="9999999999">c</ol>', "1. a\n-3. b\n-2. c"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C<td>D</table>", "A | B\n  | C | D"),
        ('<p style="visibility:hidden">x<b style="visibility: visible">y</b>z', "y"),
        ('<p style="display:none">x<b style="visibility: visible">y</b>z', ""),
        ("<head><title>t</title>Hello<p>w", "Hello\n\nw"),
        ("<dialog>no</dialog><dialog open>yes</dialog><svg><title>t</title><text>a</text></svg> <math><mi>m</mi></math>", "yes\na m"),
        ("a < b <c", "a < b <c"),
        ('<a x="y>z', "z"),
    ],
)
def test_odd_markup(html, text):
    assert page_text(html) == text


def test_long_broken_pages():
    """Pages of about 1 MB that once were scanned again and again, or grew: time and size stay in proportion."""
    pages = ["<a " * 300_000, "<a " * 300_000 + ">", '<a x="' * 150_000 + '>"', "<" * 900_000, "<b><table><td>" + "<i>" * 100_000 + "</b>" * 100_000, "<p><button>" + "<div>" * 100_000]
    pages += ["<ul><li>" * 100_000 + "x", "<dl><dd>" * 60_000 + "<br>x" * 60_000, "<table><tr><td>" * 50_000 + "<br>x" * 50_000]
    pages += ["<table>" + "<tr><td>a<td>b" * 60_000 + "<tr><td>" + "x" * 4000 + "<td>c</table>", "<table>" + "<tr><td colspan=1000>a<td>b" * 20_000]
    started = time.process_time()
    assert all(len(page_text(p)) < 20 * len(p) for p in pages)
    assert time.process_time() - started < 60


def test_odd_pages(spark):
    assert page_text("<div>" * 30000 + "deep" + "<table><tr><td>" * 1000 + "x").startswith("deep")
    draw = random.Random(0)
    bits = ["<p>", "</p>", "<li>", "<table>", "<td>", "</tr>", "<tr", "'", '"', ">", "<!--", "&#x", "x", "</table>", "<ol>", "</ul>", "<script>", "\x00"]
    for _ in range(400):
        page_text("".join(draw.choice(bits) for _ in range(40)))
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string")
    out = extract(pages)
    assert out.columns == ["page_id", "url", "text"] and sorted(str(r.text) for r in out.collect()) == ["", "a", "a"] and extract(pages.where("false")).count() == 0


def test_language_stage_with_clashing_columns(spark):
    rows = [(1, "some words here", "en", 1, "a", 0.5), (2, "des mots ici", "fr", 2, None, None), (3, "123", "en", 3, "b", 0.1), (None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text int, lang_pred string, score double")
    model = language.fit(docs)
    kept = language.of_a_language(docs, model)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[:2] * 2)
    with pytest.raises(ValueError):
        language.identify(docs, model, keep=docs.columns)
