"""Operators whose results have one right answer."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import bpe, queries, simhash, suffix_dedup

from . import plain


def test_simhash_query(spark, sf, pairs):
    fps = {i: plain.fingerprint(t, 3) for i, t in pairs}
    want = {i: (f"{fps[i]:016x}", c) for i, c in plain.components(fps, 2).items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_gray_index_finds_all_links(radius):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << np.uint64(r.integers(0, 64))) ^ (np.uint64(1) << np.uint64(r.integers(0, 64))) for _ in range(6)])
    fps = np.unique(np.concatenate([base, near]))
    bucket = r.integers(0, 3, len(fps))
    order = np.lexsort((simhash.gray_rank(fps), bucket))
    bucket, fps = bucket[order], fps[order]
    a, b = map(np.concatenate, zip(*simhash.search(bucket, fps, radius), strict=True))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_long_chains_are_one_component(spark):
    from quillspark.llm._graph import components
    from quillspark.llm._scratch import Scratch

    ids = list(range(60))
    random.Random(2).shuffle(ids)
    chain = [(a, b) for a, b in zip(ids, ids[1:], strict=False)] + [(100, 101)]
    found = components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "test"))
    assert {r.node: r.component for r in found.collect()} == {**dict.fromkeys(ids, 0), 100: 100, 101: 100}


def test_a_hub_of_many_links_is_dealt(spark):
    from quillspark.llm._graph import SALTS, components, with_smallest
    from quillspark.llm._scratch import Scratch

    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    found = components(star, Scratch(spark, "test"))
    assert found.agg(F.count("*"), F.max("component")).first() == (100_001, 0)
    hub = star.select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = with_smallest(hub).groupBy(F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("p"), "m").count().collect()
    assert len(parts) == SALTS and {p.m for p in parts} == {1} and max(p["count"] for p in parts) < 2 * 100_000 / SALTS


def test_buckets_over_many_batches(spark):
    r = random.Random(6)
    base = [r.getrandbits(63) for _ in range(12)]
    fps = {i: (base[i % 12] ^ (1 << r.randint(0, 4)) ^ (1 << r.randint(0, 62))) & (2**63 - 1) for i in range(240)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        links = simhash.links(spark.createDataFrame([(f, i) for i, f in fps.items()], "_fp long, _rep long"), 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    root = {i: i for i in fps}
    for _ in range(40):
        for x in links:
            root[x.a] = root[x.b] = min(root[x.a], root[x.b])
    assert root == plain.components(fps, 2)


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd, shingle=3).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.fingerprint == 0} == {0, None}
    assert {r.component_id for r in rows if r.doc_id == 4} == {4}
    assert simhash.near_duplicates(none).collect() == []


def test_one_of_each_keeps_the_smallest(odd, none):
    kept = simhash.one_of_each(odd, shingle=3)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns
    assert ids.count(4) == 1 and ids.count(0) == 1 and 1 not in ids and ids.count(None) == 2
    assert simhash.one_of_each(none).count() == 0


def suffix_rows(df, **more):
    found = suffix_dedup.dedup(df, **more)
    return [tuple(r) for r in found.select("_row.doc_id", "_row.text", "_n_bytes", "_n_removed", "_n_spans", "_kept").collect()]


def test_suffix_query(spark, sf, pairs):
    bodies = [t.encode() for _, t in pairs]
    want = {i: (len(b), int(g.sum()), plain.runs(g), plain.sha(plain.kept(b, g))) for (i, _), b, g in zip(pairs, bodies, plain.repeats(bodies, 400), strict=True)}
    rows = queries.op10_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    passages = Counter()
    split = {i: (t or "").lower().split() for i, t in pairs}
    for w in split.values():
        passages.update(tuple(w[k : k + 51]) for k in range(len(w) - 50))
    assert {r.doc_id for r in rows if r.shares_passage} == {i for i, w in split.items() if any(passages[tuple(w[k : k + 51])] > 1 for k in range(len(w) - 50))}


def test_planted_passages_around_the_length(spark):
    r = random.Random(7)

    def prose(n: int) -> str:
        return "".join(r.choice("abcdefghij klmnop") for _ in range(n))

    passages = [prose(n) for n in (300, 399, 400, 401, 500, 650, 800)]
    rows = []
    for k, p in enumerate(passages):
        for c in range(3):
            rows.append((10 * k + c, prose(r.randint(50, 900)) + str(c) + p + "XYZ"[c] + prose(r.randint(50, 900))))
    rows += [(1000 + i, prose(700)) for i in range(20)]
    rows += [(2000, passages[5] + "." + passages[5]), (2001, "q" * 900)]  # repeats within one text
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: tuple(x) for i, _, *x in suffix_rows(df)}
    bodies = [t.encode() for _, t in rows]
    for (i, _), b, g in zip(rows, bodies, plain.repeats(bodies, 400), strict=True):
        assert got[i] == (len(b), int(g.sum()), plain.runs(g), plain.kept(b, g))
    assert {i for i, x in got.items() if x[1]} == {10 * k + c for k in range(2, 7) for c in range(3)} | {2000, 2001}


@pytest.mark.parametrize("hot", [0, 2, 4096])
def test_suffix_odd_rows(odd, none, hot):
    rows = suffix_rows(odd, hot=hot)
    bodies = [(t or "").encode() for _, t, *_ in rows]
    for (_, _, n, removed, spans, kept), b, g in zip(rows, bodies, plain.repeats(bodies, 400), strict=True):
        assert (n, removed, spans, kept) == (len(b), int(g.sum()), plain.runs(g), plain.kept(b, g))
    assert suffix_rows(none) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=260), min_size=1, max_size=6), st.integers(40, 60))
def test_runs_cover_every_window_once(texts, length):
    seen = []
    for row, start, count, key, _, _ in suffix_dedup.all_runs(pa.array(texts), length):
        for r, s, c, k in zip(row, start, count, key, strict=True):
            seen += [(int(r), int(s) + i, int(k)) for i in range(c)]
    assert sorted((r, s) for r, s, _ in seen) == [(r, s) for r, t in enumerate(texts) for s in range(len(t) - length + 1)]
    keys = {}
    for r, s, k in seen:
        assert keys.setdefault(texts[r][s : s + length], k) == k


def test_family_levels_grow_geometrically():
    r = random.Random(3)
    family, older = suffix_dedup.SuffixFamily(40), {}
    for n in range(24):
        text = bytes(r.choice(b"ab") for _ in range(300)) + (b"abcdefgh" * 6 if n % 5 == 0 else b"")
        starts = np.arange(len(text) - 39)
        hit, met = family.add(np.frombuffer(text, np.uint8), starts)
        own = [text[i : i + 40] for i in starts]
        assert hit.tolist() == [w in older or own.count(w) > 1 for w in own]
        for w in own:
            older[w] = True
        sizes = [s for s, _ in family.levels]
        assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    for _, level in family.levels:
        windows = [family.text[i : i + 40].tobytes() for i in level]
        assert windows == sorted(set(windows))


@pytest.mark.parametrize(("batch", "family"), [(50, 100), (64, 1 << 19), (1 << 14, 1)])
def test_families_close_between_keys(spark, batch, family):
    r = random.Random(11)
    shared = ["".join(r.choice("abcdef") for _ in range(90)) for _ in range(4)]
    rows = [(k, 1, 10 * k + c, 0, 0, f"{c}" * c + shared[k] + f"{c}" * (c + 3)) for k in range(4) for c in range(5)]
    rows = [(k, n, a, b, s, len(t) - 39, t.encode()) for k, n, a, b, s, t in rows]
    df = spark.createDataFrame(rows, "m long, n long, k1 long, k2 long, s long, L long, span binary")
    got = {}
    for x in suffix_dedup.family_covers(df.coalesce(1), 40, batch, family).collect():
        got.setdefault(x.k1, set()).update(range(x.s, x.e))
    bodies = [t for *_, t in rows]
    for (_, _, a, *_), g in zip(rows, plain.repeats(bodies, 40), strict=True):
        assert got.get(a, set()) == set(np.flatnonzero(g).tolist())


def test_text_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1000)
    r = random.Random(9)
    long = "".join(r.choice("abcdef") for _ in range(2600))
    found = list(suffix_dedup.all_runs(pa.array([long]), 400))
    assert sorted(int(s) + i for _, start, count, *_ in found for s, c in zip(start, count, strict=True) for i in range(c)) == list(range(2201))


def test_bpe_query(spark, sf, pairs):
    enc = plain.encoding()
    want = {}
    for i, t in pairs:
        ids = np.array(enc.encode_ordinary(t), "<u4")
        want[i] = (len(ids), plain.sha(ids.tobytes()), plain.sha(t.encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_byte_bpe(spark, sf).collect()}
    assert got == want


@pytest.fixture(scope="module")
def encoders():
    path, pattern = queries.tokenizer()
    return bpe.Encoder(open(path, "rb").read(), pattern), plain.encoding()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_equals_the_library(encoders, texts):
    own, library = encoders
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bpe_long_pieces(encoders):
    own, library = encoders
    r = random.Random(4)
    for n in (255, 256, 257, 3000):
        t = "".join(r.choice("aeintsé") for _ in range(n))
        (ids,) = own.encode([t])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)


def test_bpe_odd_rows(odd, none):
    path, pattern = queries.tokenizer()
    rows = bpe.encode(odd, path, pattern).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((r.text or "").encode() for r in odd.select("text").collect())
    assert bpe.encode(none, path, pattern).collect() == []


def test_text_kept_by_the_pipeline_is_valid(spark):
    t = "é" * 300
    df = spark.createDataFrame([(1, "a" + t), (2, "bb" + t + "c")], "doc_id long, text string")
    rows = {r.doc_id: r.t for r in suffix_dedup.dedup(df, as_text=True).select("_row.doc_id", F.col("_kept").alias("t")).collect()}
    assert rows == {1: "a", 2: "bbc"}
