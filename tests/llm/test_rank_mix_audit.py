"""Search, mixing and the filter audit against SQL, plain versions and odd rows."""

import itertools
import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import audit, mixing, queries, search, simhash

ITEM = "item_id long, text string"


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_source_mixing", "op13_filter_audit"])
def test_queries_equal_sql(name, spark, sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())


def plain_terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain_search(rows, items, k):
    docs = [(i, plain_terms(t)) for i, t in rows]
    n, size = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, words in docs:
            tf, score = Counter(words), 0
            for t in plain_terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * tf[t] // (1000 * tf[t] + 12 * (75 + 25 * len(words) * n // size)))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if none else i, -score))
    return sorted(out, key=str)


def found(df, items, **more):
    return sorted(map(tuple, search.search(df, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_on_odd_rows(spark, odd, none):
    asked = [(1, "the OUER er an"), (1, "the OUER er an"), (2, None), (3, ""), (4, "...!"), (None, "x ab"), (5, "é 😀 end"), (6, "missing everywhere"), (7, "the the the anthe")]
    items = spark.createDataFrame(asked, ITEM).withColumn("doc_id", F.lit("clash")).withColumn("score", F.lit(1))
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = plain_search(rows, asked, 20)
    assert found(odd, items) == want and any(i is None for _, _, i, _ in want)
    assert found(odd, items, block_terms=1) == want
    assert found(none, items) == [] and found(odd, items.where("false")) == []


def test_search_prunes_no_tie_and_no_copy(spark, monkeypatch):
    """Many copies, equal scores and small blocks: the smallest ids of a score come first, whatever block they are in."""
    r = random.Random(3)
    body = [" ".join(r.choices(["ka", "lo", "mi", "nu", "pe", "zu"], weights=[50, 20, 10, 5, 2, 1], k=r.randint(1, 30))) for _ in range(40)]
    rows = [(i, body[0] if r.random() < 0.4 else r.choice(body)) for i in r.sample(range(10_000), 3000)]
    asked = [(i, " ".join(r.choices(["ka", "nu", "pe", "zu", "xx"], k=4))) for i in range(12)] + [(99, body[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(search, "BLOCK_DOCS", 5)
    for k in (1, 20):
        assert found(df, spark.createDataFrame(asked, ITEM), k=k) == plain_search(rows, asked, k)


def test_search_parts_beyond_64_bits():
    import numpy as np

    n = 1 << 40
    assert search.parts_of(np.array([3]), np.array([1 << 20]), n, n * 50).tolist() == [10**9 * 3 // (3000 + 12 * (75 + 25 * (1 << 20) * n // (n * 50)))]


def test_a_long_text_has_blocks_of_its_own(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(9000))) for i in range(3)] + [(i, "w1 w2") for i in range(3, 9)]
    items = search.Items([1], [search.terms(" ".join(f"w{k}" for k in range(9000)).encode())])
    blocks = search.forward(spark.createDataFrame(rows, "_id long, _t string").coalesce(1), items).collect()
    assert [len(b.ids) for b in blocks] == [1, 1, 1, 6] and sum(b.n_docs for b in blocks) == 9


def shares(sizes, weights, share, cap):
    """Targets by handing out the excess round by round."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(cap * sizes[s] for s in stopped)
        target = {s: cap * sizes[s] for s in stopped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        stopped |= over


def mixed(df, **more):
    return mixing.mix(df, keep=["doc_id"], **more).select("_row.doc_id", "_size", "_source_size", "_target", "_copies").collect()


def test_mix_targets_and_words(spark, sf, docs):
    rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = shares(sizes, mixing.WEIGHTS, 1.5, 2)
    got = {r.doc_id: r for r in mixed(docs)}
    taken = Counter()
    for i, s, n in rows:
        assert got[i]._size == n and got[i]._source_size == sizes[s] and got[i]._target == pytest.approx(want[s]) and 0 <= got[i]._copies <= 2
        taken[s] += n * got[i]._copies
    longest = {s: max(n for _, x, n in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 2 * longest[s] for s in sizes)
    assert any(want[s] == 2 * sizes[s] for s in sizes) and any(want[s] < 1.5 * sizes[s] for s in sizes)


def test_mix_reruns_agree_and_emit(spark, docs):
    a = mixing.mix(docs)
    b = mixing.mix(docs.repartition(5).sortWithinPartitions(F.rand(3)))
    key = ["_row.doc_id", "_target", "_copies"]
    assert sorted(a.select(*key).collect()) == sorted(b.select(*key).collect())
    copies = Counter(r.doc_id for r in mixing.emitted(a).select("doc_id").collect())
    assert copies == Counter({r.doc_id: r._copies for r in a.select(*key).collect() if r._copies})
    assert mixing.emitted(a).columns == docs.columns


def test_mix_of_odd_rows(spark, odd, none):
    df = odd.withColumn("source", F.expr("case when doc_id % 3 = 0 then 'b' when doc_id % 3 = 1 then '' end")).withColumn("_at", F.lit(1)).withColumn("_size", F.lit("x"))
    got = mixing.mix(df).collect()
    assert len(got) == odd.count() and got[0]._row._size == "x"
    words = Counter()
    for r in got:
        words[r._row.source] += r._size * r._copies
    target = {r._row.source: r._target for r in got}
    assert set(target) == {"", "b", None} and all(abs(words[s] - target[s]) <= 60_000 for s in target)
    assert mixed(none) == []
    blank = spark.createDataFrame([(1, None, "a"), (1, " ", None), (None, "", None)], "doc_id long, text string, source string")
    assert all(r._target == 0 and r._copies == 0 for r in mixed(blank))
    same = spark.createDataFrame([(7, "a b c", "s")] * 10, "doc_id long, text string, source string")
    assert sum(r._copies for r in mixed(same)) in (14, 15, 16)


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12), st.sampled_from([0.5, 1.5, 1.99, 3.0]))
@settings(max_examples=8, deadline=None)
def test_settle(spark, sizes, share):
    names = {f"s{k:02}": n for k, n in enumerate(sizes)}
    rows = [(s, n, float(mixing.WEIGHTS[k % 3])) for k, (s, n) in enumerate(names.items())]
    words, weight = mixing.settle(spark.createDataFrame(rows, "_source string, _source_size long, _weight double").coalesce(1), share, 2)
    if share < 2:
        want = shares(names, mixing.WEIGHTS, share, 2)
        for s, n, w in rows:
            assert (2 * n if not weight or 2 * n <= words / weight * w else words / weight * w) == pytest.approx(want[s])
    else:
        assert weight == 0


def plain_audit(rows, good, toxic):
    rows = [(i, t or "", s or "") for i, t, s in rows]
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    fails = []
    for i, t, _ in rows:
        w = t.encode().split()
        fails.append({f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if x})
    out, worth = {}, Counter()
    for part in {s for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails, strict=True) if s == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                bad = sum(f in x for _, x in own)
                out[part, "".join(order), step] = [len(left), len(gone), bad - len(gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                worth[part, f] += len(gone)
    return {(*k, *v, worth[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_odd_rows(spark, odd, none, labels):
    df = odd.withColumn("source", F.expr("case when doc_id % 3 = 0 then 'b' when doc_id % 3 = 1 then '' end")).withColumn("part", F.lit(3)).withColumn("_n", F.lit("x"))
    df = df.unionByName(df.where("doc_id in (9, 10)").withColumn("source", F.lit("c")))
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    marks = labels.collect()
    good, toxic = ({r.doc_id for r in marks if r.doc_id is not None and r[k] == 1} for k in (1, 2))
    want = plain_audit(rows, good, toxic)
    for send in (2_000_000, 0):
        got = audit.audit(df, labels, send_rows=send).select(*COUNTS).collect()
        assert len(got) == len(want) == 3 * 600 and {tuple(r) for r in got} == want
    assert audit.audit(none, labels).count() == 0
    assert {tuple(r) for r in audit.audit(df, labels.where("false")).select(*COUNTS).collect()} == plain_audit(rows, set(), set())


def test_audit_has_one_lattice_of_eighty_edges():
    steps = audit.paths()
    assert len(steps) == 600 and len({(b, n) for _, _, b, n in steps}) == 80


def test_near_duplicates_know_rows_by_id_and_text(spark):
    texts = dict(A="one two three four five six", B="seven eight nine ten eleven twelve", C="red green blue black white pink", D="north east south west up down")
    rows = [(1, "A"), (5, "A"), (5, "B"), (7, "C"), (7, "D"), (7, "C"), (None, "A")]
    df = spark.createDataFrame([(i, texts[t], t) for i, t in rows], "doc_id long, text string, _row string")
    got = sorted(((r.doc_id, r["_row"]) for r in simhash.one_of_each(df).collect()), key=str)
    assert got == sorted([(1, "A"), (5, "B"), (7, "C"), (7, "D"), (None, "A")], key=str)
    assert sorted(((r.doc_id, r["_row"]) for r in simhash.one_of_each(df, send_rows=0).collect()), key=str) == got


def test_near_duplicates_with_repeated_ids_lose_no_text(spark, docs):
    many = docs.withColumn("doc_id", F.expr("if(doc_id % 10 = 3, doc_id - 1, doc_id)"))
    kept = simhash.one_of_each(many, shingle=3, radius=0).select("doc_id", "text").collect()
    fp = lambda t: simhash.fingerprint((t or "").encode(), 3)
    want = {}
    for r in many.select("doc_id", "text").collect():
        want[fp(r.text)] = min(r.doc_id, want.get(fp(r.text), r.doc_id))
    assert sorted((fp(r.text), r.doc_id) for r in kept) == sorted(want.items())
