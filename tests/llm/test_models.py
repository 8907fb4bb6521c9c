"""Operators that learn, align or extract: held-out accuracy, plain versions and odd rows."""

import html
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontam, html_extract, importance, langid, licenses, quality_rules, queries, toxicity
from quillspark.llm._text import LETTER, hashed_words

from . import plain
from .conftest import words


@pytest.mark.parametrize("name", ["op5_quality_rules", "op8_license_scan"])
def test_against_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())


def test_binomial_tail_is_exact(spark):
    import math

    rows = [(0, 50), (3, 200), (9, 400), (20, 400), (0, 3)]
    df = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality_rules.binomial_tail("k", "n", 0.03).alias("p"))
    for k, n, p in map(tuple, df.collect()):
        want = 1.0 if k >= 0.03 * n else sum(math.comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(k + 1))
        assert p == pytest.approx(want, rel=1e-9)


def test_rules_bound_false_rejections(spark):
    r = random.Random(1)
    rows = [(i, words(i, 80) + (" ***" * 60 if i % 4 == 0 else "") + (" #" * r.randint(0, 5)), "en") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 1600)], "doc_id long, quality int")
    judged = quality_rules.judge(docs, labels, alpha=0.1).select("_id", "_kept", "_base_failed").collect()
    good = [r._kept or r._base_failed for r in judged if r._id % 4]
    assert good.count(False) <= 0.1 * len(good)
    assert not any(r._kept for r in judged if r._id % 4 == 0)


def test_rules_odd_rows(odd, none, labels):
    rows = quality_rules.judge(odd, labels).select("_row.doc_id", "_row.kept", "_kept", "_n_words", "_n_repeat_words").collect()
    assert len(rows) == odd.count()
    assert all(not r._kept and r._n_words == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert {r._n_repeat_words for r in rows if r.doc_id == 11} == {300}
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(odd, labels.where("false")).where("_kept").count() > 0


def test_language_accuracy_on_held_out_rows(spark, sf, docs):
    found = queries.op7_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = found.agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert n > 20 and right >= 0.95 * n


def plain_phrases(parser: langid.Parser, lang: str, learnt: list[str], text: str) -> int:
    """Phrases of a text by search in the learnt symbols."""
    joined = "".join(map(chr, np.concatenate(parser.symbols(learnt)) + 0x4E00))
    coded = "".join(map(chr, parser.symbols([text])[0] + 0x4E00)).replace(chr(0x4E00), "?")
    n = i = 0
    while i < len(coded):
        k = 1
        while i + k < len(coded) and coded[i : i + k + 1] in joined:
            k += 1
        i, n = i + k, n + 1
    return n


def alphabet_words(letters: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    known = ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(60)]
    return " ".join(r.choice(known) for _ in range(n))


@pytest.mark.parametrize("lane", [7, 64, 512])
def test_parses_equal_a_plain_search(monkeypatch, lane):
    monkeypatch.setattr(langid, "LANE", lane)
    learnt = {"a": [words(1, 300), words(2, 60)], "b": ["der hund und die katze " * 9], "zh": ["".join(random.Random(5).choices([chr(0x4E00 + i) for i in range(200)], k=900))]}
    parser = langid.Parser(learnt)
    texts = ["the hund sat und on", "zz the", "c", "", "12 34", words(1, 300), words(1, 300) + words(9, 500), words(3, 400) + "der hund und die katze " * 40]
    texts += [learnt["zh"][0][200:700] + "\u4e00\u9fa5" * 9, "\u9fa5" * 700, "an" * 1500, learnt["b"][0] * 9]
    phrases, size = parser.parse(texts)
    assert max(size) > 2000 and parser.automata[2].kinds > parser.automata[2].width
    for t, p, n in zip(texts, phrases, size, strict=True):
        assert n == len(parser.symbols([t])[0])
        assert p.tolist() == [plain_phrases(parser, lang, learnt[lang], t) for lang in parser.langs]


def test_twelve_languages_of_several_scripts(spark):
    scripts = ["abcdefgh", "ijklmnop", "qrstuvwx", "aeiouyzt", "абвгдежз", "ийклмноп", "αβγδεζηθ", "אבגדהוזח", "ابتثجحخد", "कखगघचछजझ", "あいうえおかきく", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))]
    rows = [(100 * k + i, alphabet_words(letters, k, 150 if i else 3000), f"l{k:02}") for k, letters in enumerate(scripts) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = langid.learn(df, F.col("_id") % 4 != 2)
    assert len(parser.langs) == 12
    found = {r.doc_id: r.lang_pred for r in langid.predict(df, parser).collect()}
    assert found == {i: lang for i, _, lang in rows}


def test_sampled_texts_are_whole(spark):
    rows = [(i, alphabet_words("abc", i, 1200) + " zqzq", "x") for i in range(12)] + [(99, "short one", "x"), (100, None, "x"), (101, "...", "y")]
    parser = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert parser.langs == ["x"]
    (phrases,), _ = parser.parse(["zqzq"])
    assert phrases[0] == 1 and parser.automata[0].size >= langid.SAMPLE_CHARS * 0.9


def test_language_odd_rows(odd, none):
    parser = langid.learn(odd, F.lit(True))
    rows = langid.predict(odd, parser).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 10, 11)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.predict(none, parser).collect() == []
    assert {r.lang_pred for r in langid.predict(odd, langid.learn(none, F.lit(True))).collect()} == {"und"}


def test_toxic_words_are_learnt(spark):
    rows = [(i, words(i, 60) + (" you awful fool " + words(-i, 9) if i % 8 == 0 else "")) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(800)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.col("_id") % 3 != 1)
    found = toxicity.score(docs, model).where("doc_id % 3 = 1").collect()
    assert all((r.score >= 0.7) == (r.doc_id % 8 == 0) for r in found)


@pytest.mark.parametrize("max_table", [300_000, 1])
def test_toxicity_equals_plain_version(spark, max_table):
    r = random.Random(3)
    rows = []
    for i in range(900):
        body = words(i, r.randint(5, 60)).split()
        if i % 4 == 0:
            body += [f"vile{i % 30}", "you", f"foul{i % 7}"] * r.randint(1, 2)
        if i % 9 == 0:
            body = ["foul1", "can", "the", *body]
        if i % 12 < 3:  # a pair as often toxic as any, of words that both are toxic in most texts
            body += ["grim", "tale"] if i % 5 == 0 else []
        body += ["grim"] * (i % 4 == 0) + ["and", "tale"] * (i % 8 == 0)
        rows.append((i, " ".join(body)))
    rows += [(2000 + i, rows[4][1]) for i in range(50)] + [(5000, None), (5001, "")]  # copies teach once
    label = {i: int(i % 4 == 0) for i, _ in rows if i < 5000}
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True), max_table=max_table)
    assert (model.table is not None) == (max_table == 1)
    want = plain.toxic_evidence([(t, label.get(i)) for i, t in rows], toxicity.DISCOUNT)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    for (i, t), (evidence, n) in zip(rows, want, strict=True):
        assert got[i].evidence == pytest.approx(evidence, abs=1e-9) and got[i].n_words == n
        link = model.weights @ [1, np.arcsinh(100 * evidence / max(n, 1)), np.log1p(n)]
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-np.clip(link, -30, 30))))


def test_a_text_leaves_its_own_counts_out():
    odds = (np.log(0.25), np.log(0.25))
    lone = toxicity.log_ratio(np.array([30.0]), np.array([2.0]), odds[0])
    for label, n in ((None, (30, 2)), (1, (29, 2)), (0, (30, 1))):
        own = None if label is None else np.array([label])
        none = np.zeros(0)
        value = toxicity.evidence_of(1, odds, np.array([0]), np.array([30.0]), np.array([2.0]), none.astype(int), none.astype(int), none, none, own)
        assert value[0] == pytest.approx(toxicity.log_ratio(np.array([float(n[0])]), np.array([float(n[1])]), odds[0])[0])
    assert lone[0] > 1


def test_toxicity_odd_rows(odd, none, labels):
    model = toxicity.learn(odd, labels, F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, model).collect() == []
    assert {r.score for r in toxicity.score(odd, toxicity.learn(odd, labels.where("false"), F.lit(True))).collect()} == {0.0}


def test_alignment_equals_plain_version():
    r = random.Random(8)
    items = [[r.randint(0, 5) for _ in range(r.randint(1, 12))] for _ in range(40)]
    windows = [[r.randint(0, 5) for _ in range(r.randint(1, 20))] for _ in range(40)]
    score, start, stop = decontam.align([np.array(x, np.uint64) + 7 for x in items], [np.array(x, np.uint64) + 7 for x in windows])
    for a, b, s, x, y in zip(items, windows, score, start, stop, strict=True):
        assert s == plain.smith_waterman(a, b) == plain.smith_waterman(a, b[x:y])


def test_a_passage_far_into_a_long_text():
    import pyarrow as pa

    text = "filler " * 1_080_000 + "one two three four five six seven eight nine ten " + "filler " * 1000
    items = decontam.Items([1], ["one two three four five six seven eight nine ten"])
    keys = items.keys()
    seeds = items.seeds(keys, np.ones(len(keys), int))
    ((row, item, score, start, stop, n),) = decontam.scan(pa.array([text]), items, seeds, decontam.filter_bits(seeds[0]), 0.5)
    assert (row, item, score, n) == (0, 0, 1.0, 8) and text[start:stop] == "one two three four five six seven eight nine ten"


def test_a_window_over_a_whole_long_text_is_aligned_in_pieces(spark, monkeypatch):
    item = words(3, 12)
    body = " ".join([item] * 400 + [words(5, 30)] + [item])  # seeds all along: one passage of thousands of words
    docs = spark.createDataFrame([(1, body), (2, edited(item, 4, 0.2) + " " + body[:4000])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = [tuple(r) for r in decontam.matches(docs, bench).collect()]
    column, items = docs.toArrow()["text"].combine_chunks(), decontam.Items([1], [item])
    seeds = items.seeds(items.keys(), np.ones(len(items.keys()), int))
    monkeypatch.setattr(decontam, "PIECE", 64)
    monkeypatch.setattr(decontam, "CELLS", 256)
    got = {}
    for row, _, *rest in decontam.scan(column, items, seeds, decontam.filter_bits(seeds[0]), 0.5):
        got[row] = max(got.get(row, rest), rest, key=lambda x: (x[0], -x[1]))
    assert len(want) == 2
    for r, (_, _, score, start, stop, _) in enumerate(want):
        assert (score, start, stop) == tuple(got[r][:3])


def edited(text: str, seed: int, rate: float) -> str:
    r = random.Random(seed)
    return " ".join("changed" if r.random() < rate else w for w in text.split())


def test_leaks_are_found_exact_and_edited(spark):
    items = [(i, words(1000 + i, 30)) for i in range(20)]
    rows = []
    for i in range(200):
        body = words(i, 150)
        if i % 5 == 0:
            item = items[i // 5 % 20][1]
            body = body[:300] + " " + (item if i % 10 else edited(item, i, 0.12)) + " " + body[300:]
        rows.append((i, body))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontam.matches(docs, bench).collect()}
    assert set(found) == {(i, i // 5 % 20) for i in range(0, 200, 5)}
    bodies = dict(rows)
    for (i, k), r in found.items():
        if i % 10:
            assert bodies[i].encode()[r.start : r.stop].decode() == items[k][1] and r.score == 1.0
    small = {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench, block_words=70).collect()}
    assert small == set(found)
    left = decontam.without_matches(docs, bench, block_words=70)
    assert {r.doc_id for r in left.collect()} == {i for i in range(200) if i % 5} and left.columns == docs.columns


def test_every_fifth_word_replaced(spark):
    item = [f"w{i}" for i in range(40)]
    copy = [w if i % 5 != 4 else f"x{i}" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, words(1, 60) + " " + " ".join(copy) + " " + words(2, 60))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    (r,) = decontam.matches(docs, bench).collect()
    assert r.score == pytest.approx(plain.smith_waterman(item, copy) / 80) and r.n_seeds == 16
    assert decontam.without_matches(docs, bench).count() == 0


@pytest.mark.parametrize("also_exact", [False, True])
def test_all_edited_copies_with_a_common_trigram(spark, also_exact):
    r = random.Random(12)
    items, rows, wanted = [], [], set()
    for i in range(60):
        item = [f"v{i}x{r.randint(0, 30)}" for _ in range(r.randint(15, 59))]
        copy = []
        for w in item:
            copy += [f"new{r.randint(0, 10**9)}"] if r.random() < 0.3 else [w, "more"] if r.random() < 0.1 else [] if r.random() < 0.05 else [w]
        body = words(i, 40).split() + copy + words(i + 100, 40).split()
        items.append((i, " ".join(item)))
        rows += [(i, " ".join(body))] + [(i + 1000, " ".join(item))] * also_exact
        common = {*zip(item, item[1:], item[2:], strict=False)} & {*zip(body, body[1:], body[2:], strict=False)}
        wanted |= {(i, i)} if common and plain.smith_waterman(item, re.findall("[a-z0-9]+", " ".join(body).lower())) >= len(item) else set()
        wanted |= {(i + 1000, i)} if also_exact else set()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.matches(docs, bench).collect()} == wanted


def test_an_item_in_most_texts_keeps_its_seeds(spark):
    item = words(77, 30)
    docs = spark.createDataFrame([(i, words(i, 50) + (" " + item if i % 4 else "")) for i in range(200)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontam.matches(docs, bench).collect()} == {i for i in range(200) if i % 4}


def test_decontamination_query_equals_plain_version(spark, sf, pairs):
    """All pairs of a text and an item with a common trigram, aligned cell by cell over the whole text."""
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    where = {}
    for k, w in items.items():
        for g in zip(w, w[1:], w[2:], strict=False):
            where.setdefault(g, set()).add(k)
    want = {}
    for i, t in pairs:
        w = split(t)
        for k in {k for g in set(zip(w, w[1:], w[2:], strict=False)) for k in where.get(g, ())}:
            score = plain.smith_waterman(items[k], w) / (2 * len(items[k]))
            if score >= decontam.THRESHOLD:
                want[i, k] = score
    got = {(r.doc_id, r.item_id): r.score for r in queries.op2_decontamination(spark, sf).collect()}
    assert got == pytest.approx(want) and want


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, words(1, 400)), (2, None), (3, ""), (4, "a b"), (None, words(1, 400)[40:300])], "item_id long, text string")
    found = decontam.matches(odd, bench).collect()
    assert {r.doc_id for r in found if r.item_id == 1} == {4, 6, None}
    assert decontam.matches(none, bench).collect() == []
    assert decontam.matches(odd, bench.where("false")).collect() == []
    assert decontam.without_matches(odd, bench.where("false")).count() == odd.count()
    assert decontam.without_matches(odd, bench).columns == odd.columns


def test_pages_of_the_test_tables(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op6_html_extraction(spark, sf).collect():
        page = pages[r.page_id]
        inner = re.sub("</?b>", "", page[page.index("<article>") + 9 : page.index("</article>")])
        parts = [" ".join(html.unescape(re.sub("<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style></head><body>
<header class="site"><a href="/">Home</a> Site</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies on this site and so on and so on and so on and so on.</div>
<div id="content"><h2>Heading &amp; more</h2><p>First   paragraph with enough text to count as a body of text, &eacute;t&#233;.<br>Next line.
<p>Second one with <a href="/x">a link</a> and <b>bold<p>Third, unclosed, still long enough to be a part of the text &amp copy.
<ul><li>One item of a list that belongs to the text<li>Another item of it</ul><form><input><button>Send</button> Your name</form>
<aside>Related things that do not belong here at all, not even a bit.</aside>
<script>var a = "<p>not text</p>";</script><!-- <p>a comment</p> --></div>
<div class="comments"><p>A reader says something long about the text, long enough to be a text by itself.</p></div>
<footer>&copy; Somebody</footer></body></html>"""


def test_page_without_article():
    assert html_extract.main_text(PAGE).split("\n\n") == [
        "Heading & more",
        "First paragraph with enough text to count as a body of text, été. Next line.",
        "Second one with a link and bold",
        "Third, unclosed, still long enough to be a part of the text & copy.",
        "One item of a list that belongs to the text",
        "Another item of it",
    ]


def test_short_page_and_class_headers():
    assert html_extract.main_text("<body><div class=page-header>Site</div><div class='entry-header'><h1>Title</h1></div><p>Short.</body>") == "Title\n\nShort."
    assert html_extract.main_text("<article><header><h1>T</h1></header><p>x<div class=ad>y</div><section id=comments><article><p>c</article></section></article>") == "T\n\nx"


BODY = "This paragraph is long enough to be a part of the article that the page is about."


@pytest.mark.parametrize("inside", ["article", "main", "div"])
@pytest.mark.parametrize(
    "parts",
    [
        [BODY, '<a href="/x">A paragraph that is one link</a>', BODY + " Two."],
        [BODY, *[f'<a href="/{i}">Link {i} of the text</a>' for i in range(4)], BODY + " Second half.", BODY + " End."],
        [BODY, "x + y = <math><mi>x</mi><mo>+</mo><mi>y</mi></math> and so on", BODY],
    ],
)
def test_links_and_formulas_in_the_article_stay(inside, parts):
    page = f"<body><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul><{inside}><h1>T</h1>{''.join(f'<p>{p}</p>' for p in parts)}</{inside}><footer>F</footer>"
    assert html_extract.main_text(page).split("\n\n") == ["T", *(" ".join(re.sub("<[^>]*>", "", p).split()) for p in parts)]


def test_names_that_only_sound_like_boilerplate():
    page = f"<article><h1>T</h1><div class='legal-text'><p>One.</div><section class=related-work><p>Two.</section><p>{BODY}<div class='ad-slot'>no</div><div class='cookie-notice'>no</div></article>"
    assert html_extract.main_text(page) == f"T\n\nOne.\n\nTwo.\n\n{BODY}"
    assert html_extract.main_text(f"<div class='wrapper social'><article><p>{BODY}</article></div>") == BODY
    assert html_extract.main_text(f"<div class='comments'><article><p>{BODY}</article></div>") == ""


def test_surge_and_dive_decide():
    card = "<article><p>A card of another article.</article>"
    side = "<p><a href=/>more</a>" * 3
    article = "".join(f"<p>{BODY} {i}.</p>" for i in range(8))
    want = [f"{BODY} {i}." for i in range(8)]
    assert html_extract.main_text(f"{card}{side}<article>{article}</article>{side}{card}").split("\n\n") == want
    assert html_extract.main_text(f"<p>Tagline of the site, short.</p>{side}{article}{side}<p>Somebody made this in 2020.</p>").split("\n\n") == want
    assert html_extract.extent([0, 0, 90, 0, 0, 5, 100, 0, 0, 0, 7, 0]) == (2, 6)
    assert html_extract.extent([]) == (0, -1) and html_extract.extent([0, 0]) == (0, -1) and html_extract.extent([3]) == (0, 0)


@pytest.mark.parametrize(
    "page",
    ["<p " + "a" * 60 + '">x', "<p a='" * 30_000, '<p a="' * 30_000, "<p " + "=\"' " * 30_000, "<!--" * 30_000, "<" * 200_000, "<b>" * 20_000 + "<i></i>" * 20_000 + "text " * 20_000,
     "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<p>" + "<a>x" * 20_000 + "</p>" * 20_000, "<script>" * 20_000, "<li><ul>" + "<b>" * 20_000 + "<li>x" * 20_000, "&" * 200_000],
)
def test_no_page_takes_long(page):
    import time

    began = time.process_time()
    assert isinstance(html_extract.main_text(page), str)
    assert time.process_time() - began < 2


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "</p>", "<p class='", "&amp", "<nav>x", "<article></article>", "\x00<p>\x00"])
def test_broken_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_every_cut_of_a_page_is_read():
    for n in range(0, len(PAGE), 7):
        html_extract.main_text(PAGE[:n])
        html_extract.main_text(PAGE[n:])


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<article>a<p>b", "t"), (None, "u", "x" * 200_000, None)], "page_id long, url string, html string, text string")
    assert sorted(len(r.text) for r in html_extract.extract(df).collect()) == [0, 4, 200_000]
    assert html_extract.extract(df.where("false")).collect() == []


def test_licences(spark, odd, none):
    rows = [(1, "x\nReleased under the MIT Licence, see the file.\n"), (2, "Licensed under CC BY-NC 4.0."), (3, "licensed under the apache license version 2.0"), (4, "no licence here at all"), (5, licenses.TEMPLATES[-2][1].replace(". ", ".\n"))]
    whole = {n: max((b for m, b in licenses.TEMPLATES if m == n), key=len) for n in ("BSD-2-Clause", "ISC", "MIT")}
    rows += [(10 + i, words(i, 80) + f"\n\nCopyright (c) 20{i} Somebody\n{b}\n\n" + words(-i, 80)) for i, b in enumerate(whole.values())]
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(2, "CC-BY-NC-4.0"), (3, "Apache-2.0"), (5, "MIT")} | {(10 + i, n) for i, n in enumerate(whole)}
    assert licenses.scan(odd).collect() == [] and licenses.scan(none).collect() == []


def test_importance_prefers_the_target(spark, sf):
    found = queries.op1_importance_resampling(spark, sf).collect()
    assert sum(r.kept for r in found) == round(importance.SHARE * len(found))
    rows = [(i, words(i, 50) if i % 5 else " ".join("junk" + w for w in words(i, 50).split())) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    assert all(r.kept == (r.doc_id % 5 > 0) for r in importance.resample(docs, labels, share=0.8).collect())


def test_importance_equals_plain_version(spark):
    import math

    import pyarrow as pa
    from quillspark.llm._text import WORD_BYTES

    def bucket_of(*ws: str) -> int:
        """The bucket of a word, or of a word after a word, on its own."""
        _, _, h, rows, *_ = next(hashed_words(pa.array([" ".join(ws)]), WORD_BYTES))
        return int(importance.buckets(h, rows)[0][-1])

    r = random.Random(4)
    rows = [(i, words(i, r.randint(0, 40))) for i in range(150)] + [(7, "again Again again"), (200, None), (201, ""), (None, "no id"), (None, "no id"), (300, "same same"), (300, "same same")]
    good = {i for i in range(0, 150, 3)} | {7}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, quality int")
    raw, target, own = [0] * importance.BUCKETS, [0] * importance.BUCKETS, []
    for i, t in rows:
        w = (t or "").split()
        own.append([bucket_of(x) for x in w] + [bucket_of(a, b) for a, b in zip(w, w[1:], strict=False)])
        for b in own[-1]:
            raw[b] += 1
            target[b] += i in good
    log = lambda n, b: math.log((n[b] + 1) / (sum(n) + importance.BUCKETS))
    weights = [sum(log(target, b) - log(raw, b) for b in bs) for bs in own]
    found = importance.resample(docs, labels, share=0.4).collect()
    key = lambda r: (r[0] is None, r[0] or 0, round(r[1], 6))
    assert sorted([(i, w) for (i, _), w in zip(rows, weights, strict=True)], key=key) == [(i, pytest.approx(w)) for i, w in sorted([(x.doc_id, x.log_weight) for x in found], key=key)]
    order = sorted((x.score for x in found), reverse=True)
    cut = order[round(0.4 * len(rows)) - 1]
    assert [x.kept for x in found] == [x.score >= cut for x in found]  # ties at the cut stay
    assert len({x.score for x in found if x.doc_id == 300}) == 1 == len({x.score for x in found if x.doc_id is None})


def test_rows_tied_at_the_cut_stay_together(spark, labels):
    docs = spark.createDataFrame([(1, "a b")] * 5 + [(2, "a b")] * 5, "doc_id long, text string")
    kept = [x.doc_id for x in importance.resample(docs, labels, share=0.2).collect() if x.kept]
    assert len(kept) == 5 and len(set(kept)) == 1


@pytest.mark.parametrize("k", [0, 1, 7, 50, 100, 101])
def test_kth_largest(spark, k):
    r = random.Random(k)
    values = [r.choice([r.randint(-(2**63), 2**63 - 1), r.randint(-3, 3)]) for _ in range(100)]
    want = sorted(values, reverse=True)[k - 1] if 0 < k <= 100 else None
    assert importance.kth_largest(spark.createDataFrame([(v,) for v in values], "_key long"), k) == want


def test_importance_odd_rows(odd, none, labels):
    rows = importance.resample(odd, labels).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r.score) for r in rows)
    assert {r.log_weight for r in rows if r.doc_id in (0, 1, 2)} == {0.0}
    assert importance.resample(none, labels).collect() == []
    assert {r.log_weight for r in importance.resample(odd, labels.where("false")).collect()} == {0.0}


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa

    texts = ["The cat, the Cat", None, "", "the", "a" * 50 + " cat"]
    by = {}
    for i, _, h, rows, starts, ends, own in hashed_words(pa.array(texts), LETTER):
        for x, r, s, e in zip(h.tolist(), rows, starts, ends, strict=True):
            by.setdefault((texts[i + r] or "")[s - own[r] : e - own[r]].lower(), set()).add(x)
    assert set(by) == {"the", "cat", "a" * 50} and all(len(v) == 1 for v in by.values())
