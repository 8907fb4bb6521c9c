"""Worked cases, and rules that hold on any input."""

import json
import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import models, numeric, splits, stats, telemetry, texts, tokens, windows
from quillspark.operators.pages import canonical, cleaned
from quillspark.plans import registry
from quillspark.sources import sinks, tables, traces


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_average_ranks_and_spearman(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10, 20, 20, 5])], "i int, v int")
    assert {r.i: r.r for r in stats.average_ranks(df, "v", [], "r").collect()} == {0: 2.0, 1: 3.5, 2: 3.5, 3: 1.0}
    pairs = spark.createDataFrame([(1, x, y) for x, y in zip([1, 2, 3, 4], [1, 3, 2, 4], strict=True)], "g int, x int, y int")
    assert stats.spearman_of(pairs, "x", "y", ["g"]).first().rho == pytest.approx(0.8)
    flat = pairs.withColumn("x", F.lit(1))
    assert stats.spearman_of(flat, "x", "y", ["g"]).first().rho is None


def test_drift_weights_documents(spark):
    rows = [("N", 1, 1.0), ("N", 1, 1.0), ("F", 2, 2.0), ("F", 3, 3.5), ("F", 3, 3.5)]
    df = spark.createDataFrame(rows, "stratum string, cluster long, x double")
    assert stats.drift(df, "t", 20).first().point == pytest.approx(2.0)


def test_labels(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.5, 0.1), (0.0, 0.0)], "p double, l double")
    assert column(df, stats.delta_label(F.col("p"), F.col("l"))) == ["inconclusive", "supported", "contradicted"]


def test_witten_bell_worked_example(spark):
    full = models.grams(spark.createDataFrame([("abab",)], "body string"), [], 2)
    counts = models.ngram_counts_of(full, 2)
    wanted = spark.createDataFrame([("", "a"), ("a", "b"), ("a", "a"), ("b", "a")], "ctx string, ch string")
    p = {(r.ctx, r.ch): r.p for r in models.witten_bell(wanted, counts, 2, 2).collect()}
    assert p == pytest.approx({("", "a"): 3 / 6, ("a", "b"): 2.5 / 3, ("a", "a"): 0.5 / 3, ("b", "a"): 1.5 / 2})


def test_grams_in_pieces_and_in_any_alphabet(spark, monkeypatch):
    texts = ["", "a", "abcab\x00c😀" * 9, None, "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))]
    want = Counter((t[max(0, i - 4) : i], t[i]) for t in texts if t for i in range(len(t)))
    docs = spark.createDataFrame([(t,) for t in texts], "body string")
    for size in (models.PIECE, 3, 7):
        monkeypatch.setattr(models, "PIECE", size)
        found = Counter()
        for held in models.pieces([t for t in texts if t], 5):
            for g, n in zip(*models.counted(held, 5), strict=True):
                found[g[:-1], g[-1]] += int(n)
        assert found == want
    assert {(r.ctx, r.ch): r.n for r in models.grams(docs, []).collect()} == want


def test_scores_by_sent_and_by_joined_grams(spark, monkeypatch):
    texts = ["", "a", "abcab\x00c" * 9, None, "a😀"]
    docs = spark.createDataFrame([(i, "N", t) for i, t in enumerate(texts)], "doc_id long, split string, body string")
    grams = sorted({(t[max(0, i - 4) : i], t[i]) for t in texts if t for i in range(len(t))})
    value = {g: (i + 1) / (len(grams) + 1) for i, g in enumerate(grams)}
    p = spark.createDataFrame([(*g, v) for g, v in value.items()], "ctx string, ch string, p double")
    want = {k: (-sum(math.log(value[t[max(0, i - 4) : i], t[i]]) for i in range(len(t))), len(t)) for k, t in enumerate(texts) if t}
    for send, size in ((models.SEND_GRAMS, models.PIECE), (0, models.PIECE), (models.SEND_GRAMS, 4)):
        monkeypatch.setattr(models, "PIECE", size)
        found = {r.doc_id: (r.total_nll, r.body_tokens) for r in models.text_scores(docs, p, send=send).collect()}
        assert found.keys() == want.keys()
        for k, v in want.items():
            assert found[k] == pytest.approx(v)
    assert models.text_scores(docs.where("false"), p.where("false")).count() == 0


def test_windows_are_scored_together_as_alone(spark):
    """Batched windows give what one window at a time gives, odd lengths and unknown characters included."""
    r = random.Random(5)
    texts = [None, "", "a", "".join(r.choice("abcdeé😀") for _ in range(700)), *("ab" * k for k in (15, 16, 17, 31, 32, 40, 48, 64))]
    vocab = {"<BOS>": 0, "<stmt>": 1, "<min>": 2, **{c: i for i, c in enumerate("abcd😀", 3)}}
    model = models.CharTransformer(len(vocab))
    docs = spark.createDataFrame([(i, ("statement", "minutes")[i % 2], t) for i, t in enumerate(texts)], "doc_id long, genre string, body string")
    found = {x.doc_id: x for x in models.transformer_scores(docs, vocab, model).collect()}
    for i, t in enumerate(texts):
        ids = models.np.array([0, 1 + i % 2, *(vocab.get(c, 0) for c in t or "")])
        want = 0.0
        for ctx, start, stop in models.scored_windows(len(ids), 64):
            logs = model.log_probs(ids[ctx : stop - 1])
            want -= sum(logs[k - 1 - ctx, ids[k]] for k in range(start, stop))
        assert found[i].total_nll == pytest.approx(want, rel=1e-12) and found[i].body_tokens == len(t or "")
    part = models.np.array([[0, 1, 3, 4, 5], [0, 2, 6, 7, 3]])
    assert models.np.allclose(model.target_logs(part, part[:, 2:4]), [[model.log_probs(x)[3 + j, x[2 + j]] for j in (0, 1)] for x in part])


def test_ids_of_characters(spark):
    df = spark.createDataFrame([(1, "aé😀a?"), (2, ""), (3, None), (4, "\x00")], "i long, body string")
    vocab = {"<BOS>": 0, "a": 3, "é": 4, "😀": 5, "\x00": 6}
    got = {r.i: r.ids for r in df.select("i", tokens.char_ids(F.col("body"), vocab).alias("ids")).collect()}
    assert got == {1: [3, 4, 5, 3, None], 2: [], 3: None, 4: [6]}
    assert {r.token for r in tokens.char_vocabulary(df).collect()} == {*tokens.SPECIALS, *"aé😀?\x00"}


@pytest.mark.parametrize("name", ["char_encode", "serialize_ids"])
def test_odd_texts_are_encoded_as_in_sql(name, spark, tmp_path):
    """No text, empty texts, texts of unknown characters only, ids that occur again, no id."""
    rows = [(0, "abc é"), (1, "a😀b"), (160, "日本"), (161, "a日"), (162, ""), (163, None), (164, "日"), (164, "ab"), (164, None), (166, None), (166, ""), (168, "日"), (168, "本"), (None, "ab"), (-3, "b\x00")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(registry.oracle_sql()[name].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'"))
    got = registry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_coverage_inside_rows(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 34), (4, 35), (5, 500), (6, 90), (6, 90)], "doc_id long, n int")
    plan = windows.coverage(df, "doc_id", "n", 64)
    got = {r.doc_id: tuple(r)[1:] for r in plan.collect()}
    assert got == {2: (1, 3, 2, 3, True), 3: (32, 34, 2, 34, True), 4: (33, 35, 2, 35, True), 5: (498, 500, 2, 500, True), 6: (176, 90, 2, 90, False)}
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()  # a row a document, not one a window


def test_split_of_boundary_dates(spark):
    df = spark.createDataFrame([("2019-11-30",), ("2019-12-01",), ("2020-01-30",), ("2020-01-31",), ("2022-02-01",), ("2019-11-29",)], "d string")
    assert column(df, splits.assign(F.col("d").cast("date"))) == ["T", "excluded", "excluded", "N", "F", "T"]
    late = spark.createDataFrame([("2019-11-15",)], "d string").select(splits.available(F.lit(True), F.col("d").cast("date")).alias("a"))
    assert str(late.first().a) == "2019-12-06"


def test_guard_names_the_leaked_split(spark):
    df = spark.createDataFrame([("T",), ("F",)], "split string")
    with pytest.raises(Exception, match="found F"):
        splits.require(df, "T").collect()


def test_normalization(spark):
    df = spark.createDataFrame([("Vissing-Jørgensen ®",), ("café",), ("é​",), (None,)], "t string")
    assert column(df, texts.normalized(F.col("t"))) == ["Vissing-Jorgensen ", "cafe", "e", None]
    layout = spark.createDataFrame([("a\r\nb – c\t d  \n\n\n\n1 — 2 ",)], "t string")
    assert column(layout, texts.plain_layout(F.col("t"))) == ["a\nb -- c d\n\n1-2"]
    assert column(layout, texts.plain_layout(texts.plain_layout(F.col("t")))) == ["a\nb -- c d\n\n1-2"]


def test_parser_reports_violations(spark):
    text = "<|statement|>\ndocument_id: 1\ndate: d\n\nbody\n<|end_statement|>\n<|minutes|>\ndate: d\n\nx\n<|end_minutes|>\n"
    rows = texts.parsed(spark.createDataFrame([(text,)], "t string"), "t").collect()
    assert [(r.genre, r.document_id, r.body, r.violation) for r in rows] == [("statement", "1", "body", None), ("minutes", "", "x", "missing_header")]


def test_urls_and_paragraphs(spark):
    df = spark.createDataFrame([("https://A.org//x//y?z#q",), ("http://a.org/x",)], "u string")
    assert column(df, canonical(F.col("u"))) == ["https://a.org/x/y", None]
    p = spark.createDataFrame([("1. The <b>text</b> <sup>2</sup> Return to text",)], "t string")
    assert column(p, cleaned(F.col("t"))) == ["The text"]


@pytest.mark.parametrize("n", [3, 4, 17, 64, 65, 200])
@pytest.mark.parametrize("block", [1, 2, 7, 16, 64])
def test_windows_score_every_target_once(spark, n, block):
    rows = windows.plan(spark.createDataFrame([(n,)], "n int"), "n", block).collect()
    assert [t for r in rows for t in range(r.start, r.stop)] == list(range(2, n))
    assert all(r.stop - 1 - r.context <= block and r.context < r.start for r in rows)


def test_schedule_guard(spark):
    with pytest.raises(ValueError):
        windows.schedule(spark, 10, 9, 1.0, 0.1)


def test_bpe_is_lossless_and_prefix_stable():
    words = {"low": 5, "lower": 2, "newest": 6, "widest": 3}
    few, many = plain_fit(words, 14), plain_fit(words, 20)
    assert many[: len(few)] == few
    ranks = {(a, b): i for i, (a, b, _) in enumerate(many)}
    for w in ("lowest", "new", "x", ""):
        assert "".join(tokens.encoded(w, ranks)).replace(tokens.END, "") == w


def joined_all(text: str, left: str, right: str) -> str:
    """A word as symbols between bars, a pair joined wherever it stands, in one replacement."""
    return re.sub(rf"(?<=\|){re.escape(left)}\|{re.escape(right)}(?=\|)", lambda m: m[0].replace("|", ""), text)


def barred(word: str) -> str:
    return "|" + "|".join([*word, tokens.END]) + "|"


def plain_fit(counted, size):
    """Merges with all pairs read off the barred words before each."""
    texts = {barred(w): n for w, n in counted.items()}
    known, merges = set("".join(texts)) - {"|"} | {tokens.END}, []
    while len(known) < size:
        pairs = Counter()
        for t, n in texts.items():
            parts = t.strip("|").split("|")
            for k in range(1, len(parts)):
                pairs[parts[k - 1], parts[k]] += n
        order = sorted((-n, p) for p, n in pairs.items() if n >= 2)
        if not order:
            return merges
        (left, right), n_before = order[0][1], len(known)
        known.add(left + right)
        merges.append((left, right, len(known) > n_before))
        texts = {joined_all(t, left, right): n for t, n in texts.items()}
    return merges


@pytest.mark.parametrize("seed", range(30))
def test_encoding_joins_a_rank_everywhere_before_the_next(seed):
    """Ranks in any order, symbols made in several ways: as if each rank were replaced in the whole word."""
    r = random.Random(seed)
    made, merges = ["a", "b", "c"], []
    while len(merges) < 14:
        pair = (r.choice(made), r.choice([*made, tokens.END]))
        if pair not in merges and len("".join(pair)) < 7:
            merges.append(pair)
            made.append("".join(pair)) if tokens.END not in pair else None
    r.shuffle(merges)
    ranks = {p: i for i, p in enumerate(merges)}
    for _ in range(40):
        word = "".join(r.choice("aabc") for _ in range(r.randint(0, 24)))
        text = barred(word)
        while True:
            parts = text.strip("|").split("|")
            best = min((ranks[p] for p in zip(parts, parts[1:], strict=False) if p in ranks), default=None)
            if best is None:
                break
            text = joined_all(text, *merges[best])
        assert tokens.encoded(word, ranks) == parts


@pytest.mark.parametrize("table_symbols", [0, 1 << 13])
def test_words_are_encoded_together_as_one_by_one(monkeypatch, table_symbols):
    monkeypatch.setattr(tokens, "TABLE_SYMBOLS", table_symbols)
    monkeypatch.setattr(tokens, "ROUNDS_LENGTH", 30)
    r = random.Random(6)
    found = ["".join(r.choice("aaab") for _ in range(r.randint(1, 40))) for _ in range(300)] + ["", "x", "axa", "😀a", "a" * 99]
    made, merges = ["a", "b"], {}
    while len(merges) < 60:  # equal strings from different pairs, and pairs out of order, are among them
        pair = r.choice(made), r.choice([*made, tokens.END])
        if pair not in merges and len("".join(pair)) < 9:
            merges[pair] = True
            made += ["".join(pair)] if tokens.END not in pair else []
    order = [(*p, True) for p in r.sample(list(merges), 60)]
    ranks = {(a, b): i for i, (a, b, _) in enumerate(order)}
    want = [tokens.encoded(w, ranks) for w in found]
    assert tokens.Encoder(order)(pa.array([*found, None])).to_pylist() == [*want, None]
    known = [x if set("ab").issuperset(w) else None for w, x in zip(found, want, strict=True)]
    assert tokens.Encoder(order, set("ab"))(pa.array(found)).to_pylist() == known
    assert tokens.Encoder(order)(pa.array([], pa.string())).to_pylist() == []
    assert tokens.Encoder([], set("a"))(pa.array(["aa", "b"])).to_pylist() == [["a", "a", tokens.END], None]


def test_words_are_runs_of_space_and_others(spark):
    texts = [None, "", " a\x0bb\xa0c\u2003d 😀  e\t\r\n", "z ", " z", "\x0c\x1f\x1c z"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")
    want = docs.select(F.explode(tokens.words(F.col("body"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    assert sorted(tokens.word_counts(docs).collect()) == sorted(want.collect())
    own = {r.word: (r.n, r.own) for r in tokens.word_counts(docs, own=F.col("id") < 6).collect()}
    assert own == {r.word: (r.n, r.n // 3) for r in want.collect()}


@pytest.mark.parametrize("name", ["bpe_roundtrip", "bpe_encode"])
def test_texts_are_counted_once(spark, sf, monkeypatch, name):
    """The fit, its alphabet and the encoding see one table of counted words."""
    calls = []
    monkeypatch.setattr(tokens, "word_counts", lambda *a, f=tokens.word_counts, **k: calls.append(1) or f(*a, **k))
    getattr(tokens, name)(spark, sf)
    assert len(calls) == 1


def test_a_long_word_is_encoded_in_time():
    ranks = {("a", "a"): 0, ("aa", "aa"): 1, ("aaaa", "aaaa"): 2}
    assert len(tokens.encoded("a" * 200_000, ranks)) == 25_001


@pytest.mark.parametrize("driver_words", [10, 100, 10_000])
def test_fit_takes_every_word(spark, driver_words):
    r = random.Random(4)
    found = ["".join(r.choice("aab😀é") for _ in range(r.randint(1, 7))) for _ in range(900)] + ["zq"] * 2 + ["aaaa"] * 50
    docs = spark.createDataFrame([(" ".join(found[i : i + 50]),) for i in range(0, len(found), 50)], "body string").repartition(4)
    counted = Counter(re.findall(r"\S+|\s+", "\n".join(" ".join(found[i : i + 50]) for i in range(0, len(found), 50))))
    counted.pop("\n")
    assert tokens.merges_of(docs, 150, driver_words) == plain_fit(dict(counted), 150)


def test_fit_takes_few_passes(spark, monkeypatch):
    """More words than the driver merges at once, and merges whose counts are close: a pass makes many of them all the same."""
    r = random.Random(5)
    found = ["".join(r.choice(["an", "er", "the", "ou", "st", "re", "ly"]) for _ in range(r.randint(1, 6))) for _ in range(12_000)]
    docs = spark.createDataFrame([(" ".join(found[i : i + 50]),) for i in range(0, len(found), 50)], "body string")
    passes, frame = [], type(docs)
    monkeypatch.setattr(frame, "toPandas", lambda self, f=frame.toPandas: passes.append(1) or f(self))  # a pass collects its pairs
    many = tokens.merges_of(docs, 1500, 2000)
    assert len(passes) <= 15
    assert len(many) > 1400 and many == tokens.merges_of(docs, 1500, 1_000_000)


def test_rare_words_count_as_well(spark):
    docs = spark.range(50_100).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("body")).union(spark.createDataFrame([("~~~",)], "body string"))
    merges = tokens.merges_of(docs, 20)
    assert sum(fresh for *_, fresh in merges) == 20 - len({*"0123456789~", tokens.END})


def test_descent_overshoots_as_known(spark):
    rows = numeric.descents(spark.createDataFrame([(0.5, 0.15)], "x0 double, eta double"), "x0", F.col("eta"), 60).orderBy("k").collect()
    assert rows[-1].x == pytest.approx(numeric.OPTIMUM, abs=1e-9)


def test_backward_worked_example(spark):
    df = spark.createDataFrame([(1.0, -1.0, 2.0)], "x1 double, x2 double, y double")
    rows = numeric.forward(df, ((1.0, 0.0), (0.0, 1.0)), (2.0, 0.0), (1.0, 1.0), 0.0)
    g = numeric.gradients(rows, (1.0, 1.0)).first()
    assert (g.w2_1, g.w2_2, g.w1_11, g.w1_12, g.w1_21) == (3.0, 0.0, 1.0, -1.0, 0.0)


def test_guardrail_orders_differ(spark):
    rows = [(1, 0, s, "ok", "ok", 150, 0) for s in (1, 2)]
    df = spark.createDataFrame(rows, "run long, loop long, seq long, phase string, status string, latency_ms long, tokens long")
    assert telemetry.guarded(df, True, ms=150, tokens=100).first().steps == 1
    assert telemetry.guarded(df, False, ms=150, tokens=100).first().steps == 2
    costs = df.withColumns({"latency_ms": F.lit(0), "tokens": F.lit(10)})
    assert telemetry.guarded(costs, True, ms=150, tokens=15).first().steps == 2


def test_transformer_with_zero_weights_is_uniform(spark):
    docs = spark.createDataFrame([(1, "statement", "abc" * 50)], "doc_id long, genre string, body string")
    vocab = {"<BOS>": 0, "<stmt>": 1, "<min>": 2, "a": 3, "b": 4, "c": 5}
    r = models.transformer_scores(docs, vocab, models.CharTransformer(6, seed=None)).first()
    assert r.total_nll / r.body_tokens == pytest.approx(__import__("math").log(6))


def test_trace_defaults(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text(json.dumps({"phase": "act", "timestamp": 1.0}) + "\n\n" + json.dumps({"latency_ms": 4}) + "\n")
    rows = traces.read_trace(spark, str(path)).orderBy("idx").collect()
    assert [(r.phase, r.latency_ms, r.timestamp) for r in rows] == [("act", 0, 1.0), ("unknown", 4, 2.0)]


def test_corpus_digest_is_checked(spark, tmp_path):
    (tmp_path / "c.txt").write_text("text")
    good = sinks.read_corpus(spark, str(tmp_path / "c.txt")).first()
    assert sinks.read_corpus(spark, str(tmp_path / "c.txt"), good.sha256).count() == 1
    with pytest.raises(Exception, match="digest differs"):
        sinks.read_corpus(spark, str(tmp_path / "c.txt"), "0" * 64).collect()


def test_results_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    sinks.write_results(df, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"x": 1, "y": "a"}
    assert sinks.markdown(df).splitlines()[-1] == "| 1 | a |"


def test_stream_equals_batch(spark, sf, tmp_path):
    from quillspark.streaming import live

    source = tmp_path / "in"
    events = tables.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.repartition(3).write.parquet(str(source))
    stream = live.read_events(spark, str(source))
    run = live.daily_counts(stream, "40 days").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = live.daily_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))
    run = live.running_budgets(stream, 500, 500).writeStream.format("memory").queryName("budgets").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = {r.user_id: (r.tokens_left, r.ms_left) for r in sorted(spark.table("budgets").collect(), key=lambda r: r.events)}
    total = events.groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("t"), F.sum(F.floor("value")).alias("m")).collect()
    assert last == {r.user_id: (max(0, 500 - r.t), max(0, 500 - r.m)) for r in total}


@pytest.mark.parametrize("href", ["", "#a", "?q=1", "/x/y.htm", "//other.org/z", "http://a.b/c", "mailto:a@b.c", "x.htm", "./x.htm#t", "../x.htm", "../../../x/./y?z=1", "a/../b/c.htm", "https://A.org//x"])
def test_joined_addresses(spark, href):
    from urllib.parse import urljoin

    from quillspark.operators.press import BASE, joined_url

    (r,) = spark.range(1).select(joined_url(F.lit(BASE), F.lit(href)).alias("u")).collect()
    assert r.u == urljoin(BASE, href)


def test_official_addresses_and_days(spark):
    from quillspark.operators.press import dated, official

    rows = [
        ("https://Example.ORG//a//b?x#y", "https://www.example.org/a/b", None), ("http://example.org/a", None, None), ("https://evil.org/a", None, None), (None, None, None),
        ("https://news.example.org:443/x/monetary20240229a.htm", "https://www.example.org/x/monetary20240229a.htm", "2024-02-29"), ("https://example.org/monetary20230229a.htm", "https://www.example.org/monetary20230229a.htm", None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "u string").select(official(F.col("u")).alias("o"))
    assert [(r.o, str(r.d) if r.d else None) for r in df.select("o", dated(F.col("o")).alias("d")).collect()] == [r[1:] for r in rows]


def test_block_equals_loops():
    import numpy as np

    from quillspark.operators import blocks

    x = np.random.default_rng(1).standard_normal((5, 8))
    d, heads, wide = 8, 2, 12
    w = [blocks.fixed_weights(*shape) for shape in ((d, 3 * d, 1), (d, d, 2), (d, wide, 3), (wide, d, 4))]

    def normed(v):
        m = sum(v) / len(v)
        return [(a - m) / math.sqrt(sum((b - m) ** 2 for b in v) / len(v) + 1e-5) for a in v]

    def times(v, m):
        return [sum(v[r] * m[r, c] for r in range(len(v))) for c in range(m.shape[1])]

    p = [times(normed(row), w[0]) for row in x.tolist()]
    size, mid = d // heads, []
    for i in range(len(x)):
        y = []
        for h in range(heads):
            part = lambda t, k, h=h: p[t][k * d + h * size : k * d + (h + 1) * size]
            e = [math.exp(sum(a * b for a, b in zip(part(i, 0), part(j, 1), strict=True)) / math.sqrt(size)) for j in range(i + 1)]
            y += [sum(e[j] / sum(e) * part(j, 2)[k] for j in range(i + 1)) for k in range(size)]
        mid.append([a + b for a, b in zip(x[i].tolist(), times(y, w[1]), strict=True)])
    want = []
    for row in mid:
        hidden = [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in times(normed(row), w[2])]
        want.append([a + b for a, b in zip(row, times(hidden, w[3]), strict=True)])
    assert np.allclose(blocks.block(x, heads, wide), want)


def test_next_tokens_follow_the_softmax(spark):
    from quillspark.operators.blocks import next_tokens

    df = spark.range(4000).select("id", F.array(*map(F.lit, (0.0, 2.0, 1.0, 1.0, -3.0))).alias("x"))
    found = next_tokens(df, "id", "x", 1.0, 2, 5).groupBy("greedy", "sampled").count().collect()
    n = {r.sampled: r["count"] for r in found}
    assert {r.greedy for r in found} == {1} and set(n) == {1, 2, 3}  # equal to the second largest stays
    assert abs(n[1] / 4000 - math.e / (math.e + 2)) < 0.03
    assert {r.sampled for r in next_tokens(df, "id", "x", 0.01, None, 5).select("sampled").distinct().collect()} == {1}


def test_prefixes_and_alphabet_of_the_fit(spark):
    from quillspark.operators import tokens

    merges = [("a", "b", True), ("c", "d", True), ("ab", "", False), ("ab", "cd", True)]
    ranked = spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "rank int, left string, right string, is_new boolean")
    assert {r.n_new_tokens: r.n_merges for r in tokens.prefixes(ranked).collect()} == {0: 0, 1: 1, 2: 2, 3: 4}
    docs = spark.createDataFrame([("abab ab",)], "body string")
    with pytest.raises(ValueError):
        tokens.merges_of(docs, 3)
    with pytest.raises(ValueError):
        tokens.merges_of(spark.createDataFrame([("a" + tokens.END,)], "body string"), 100)
    words = tokens.encode_words(spark.createDataFrame([("ab", 1), ("axb", 1)], "word string, n long"), merges, {"a", "b"})
    assert {r.word: r.symbols for r in words.collect()} == {"ab": ["ab", tokens.END], "axb": None}
    with pytest.raises(Exception, match="outside the vocabulary"):
        tokens.all_known(words).collect()


def test_numbers_and_draws_of_clusters(spark):
    from quillspark.operators import stats

    rows = spark.createDataFrame([("a", i, float(i)) for i in range(700)] + [("b", 5, 1.0)], "stratum string, cluster long, x double")
    known = stats.numbered(rows, "stratum", "cluster").collect()
    assert sorted(r._i for r in known if r.stratum == "a") == list(range(700)) and {r._n for r in known} == {700, 1}
    times = stats.draws(rows, "s", 3).groupBy("resample", "stratum").agg(F.sum("times").alias("n"), F.count("*").alias("d")).collect()
    assert {(r.stratum, r.n) for r in times} == {("a", 700), ("b", 1)} and all(r.d < 500 for r in times if r.stratum == "a")
    sums = stats.drawn_sums(rows, "s", 3, ["x"]).collect()
    drawn = stats.draws(rows, "s", 3).join(rows, ["stratum", "cluster"]).groupBy("resample", "stratum").agg(F.sum(F.col("x") * F.col("times")).alias("x")).collect()
    assert sorted(map(tuple, sums)) == sorted(map(tuple, drawn))


def test_draws_of_few_clusters_are_made_in_many_tasks(spark, monkeypatch):
    from quillspark.operators import stats

    monkeypatch.setattr(stats, "DRAW_BLOCK", 7)
    known = stats.numbered(spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1)], "stratum string, cluster long"), "stratum", "cluster").coalesce(1)
    drawn = stats.single_draws(known, "s", 64, "stratum")
    counted = drawn.withColumn("part", F.spark_partition_id()).groupBy("resample", "stratum").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.first("part").alias("part")).collect()
    assert {(r.stratum, r.n, r.parts) for r in counted} == {("a", 20, 1), ("b", 1, 1)} and len(counted) == 128
    assert len({r.part for r in counted}) > 20


def test_tables_and_manifests(spark, tmp_path):
    from quillspark.sources import sinks, versions

    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        versions.replace_table(spark.range(n), path)
        assert versions.read_table(spark, path).count() == n
    with pytest.raises(Exception):
        versions.replace_table(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert versions.read_table(spark, path).count() == 5
    (tmp_path / "split.json").write_text('{"corpus_sha256": "abc",\n "documents": [{"id": "1", "split": "T"}, {"id": "2", "split": "N"}]}')
    assert {tuple(r) for r in sinks.read_split(spark, f"{tmp_path}/split.json", "abc").collect()} == {("1", "T"), ("2", "N")}
    with pytest.raises(Exception, match="made for corpus"):
        sinks.read_split(spark, f"{tmp_path}/split.json", "other").collect()
    trace = traces.rotated(f"{tmp_path}/trace", "r1")
    event = spark.createDataFrame([("c", "l", "act", "m", "ok", 3, None, "{}", None)], traces.TRACE_SCHEMA)
    traces.append_trace(event, trace)
    traces.append_trace(event, trace)
    found = spark.read.schema(traces.TRACE_SCHEMA).json(trace).collect()
    assert len(found) == 2 and all(r.timestamp > 1e9 for r in found) and trace.endswith("run_id=r1")
    sinks.write_results(event, f"{tmp_path}/results")
    assert spark.read.json(f"{tmp_path}/results").first().method == "m"


def test_rank_correlations_of_resamples_agree(spark, monkeypatch):
    """Rows sent to the tasks and rows joined with the draws give the same correlations, ties and two strata included."""
    from quillspark.operators import stats

    r = random.Random(8)
    rows = [("ab"[i % 2], i // 3, float(r.randint(0, 9)), float(r.randint(0, 9))) for i in range(240)] + [("c", 1, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "stratum string, cluster long, x double, y double")
    sent = {r.resample: r.rho for r in stats.spearman_sent(df, "x", "y", "t", 40).collect()}
    moved = {r.resample: r.rho for r in stats.spearman_in(stats.draws(df, "t", 40).join(df, ["stratum", "cluster"]), "x", "y", "resample", "times").collect()}
    assert sent.keys() == moved.keys() and all(sent[k] == pytest.approx(moved[k]) for k in sent)
    flat = df.withColumn("y", F.lit(1.0))
    assert {r.rho for r in stats.spearman_sent(flat, "x", "y", "t", 3).collect()} == {None}
    both = [stats.rho_bootstrap(df, "x", "y", "t", 30).first().asDict(), None]
    sums = [sorted(map(tuple, stats.drawn_sums(df.groupBy("stratum", "cluster").agg(F.sum("x").alias("v")), "s", 5, ["v"]).collect())), None]
    monkeypatch.setattr(stats, "SEND_CLUSTERS", 0)
    both[1] = stats.rho_bootstrap(df, "x", "y", "t", 30).first().asDict()
    sums[1] = sorted(map(tuple, stats.drawn_sums(df.groupBy("stratum", "cluster").agg(F.sum("x").alias("v")), "s", 5, ["v"]).collect()))
    assert both[0] == pytest.approx(both[1]) and sums[0] == sums[1]


def test_score_checks_look_at_the_scorers_windows(spark, monkeypatch):
    from quillspark.operators import blocks, models

    docs = spark.createDataFrame([(1, "abc" * 70), (2, ""), (3, "ab?")], "doc_id long, body string")
    vocab = {"a": 3, "b": 4, "c": 5}
    good = {r.doc_id: r for r in blocks.score_checks(docs, vocab).collect()}
    assert all(r.is_once for r in good.values()) and good[1].n_targets == 210 and good[1].first_target == 2 and not good[3].round_trips
    own = models.scored_windows

    def overlapping(n, block):
        return ((c, max(0, a - 1), b) for c, a, b in own(n, block))

    # workers read the module anew, so the check is made here
    seen = [t for _, a, b in overlapping(212, 64) for t in range(a, b)]
    assert seen != list(range(2, 212)) and [t for _, a, b in own(212, 64) for t in range(a, b)] == list(range(2, 212))


@pytest.mark.parametrize("split", ["N", "excluded", None])
def test_every_fit_refuses_other_splits(spark, split):
    from quillspark.operators import models, tokens, windows

    rows = [(1, "abc abc abc", "T"), (2, "abc abd", split)]
    df = spark.createDataFrame(rows, "doc_id long, body string, split string")
    fits = (
        lambda d: tokens.char_vocabulary(d).collect(), lambda d: tokens.merges_of(d, 8), lambda d: models.fitted_counts(d).collect(),
        lambda d: windows.sampled(d, F.length("body"), 2, 3).collect(),
    )
    for fit in fits:
        assert fit(df.where("split = 'T'")) is not None
        with pytest.raises(Exception, match="may be used"):
            fit(df)


def test_words_without_a_pair_of_the_merges_are_left_out(monkeypatch):
    import numpy as np

    r = random.Random(4)
    words = [[r.randint(1, 6) for _ in range(r.randint(1, 7))] for _ in range(400)]
    s = np.array([x for w in words for x in (*w, 0)], np.int32)
    steps = [(1, 2, 7), (7, 3, 8), (4, 4, 9)]
    some = tokens.touched(s, steps)
    assert some.tolist() == [any(p in ((1, 2), (7, 3), (4, 4)) for p in zip(w, w[1:], strict=False)) for w in words for _ in (*w, 0)]
    weight = np.ones(len(s), np.int64)
    for whole, part in ((s, s[some]), (np.zeros(0, np.int32), np.zeros(0, np.int32))):
        w, v = weight[: len(whole)], weight[: len(part)]
        for step in steps:
            whole, w, *a = tokens.joined(whole, w, *step)
            part, v, *b = tokens.joined(part, v, *step)
            assert [x.tolist() for x in a] == [x.tolist() for x in b]
    assert not tokens.touched(s, []).any() and not len(tokens.touched(s[:0], steps))
