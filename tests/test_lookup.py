"""Substring search against a nested loop."""

import random

import pytest

from quillspark.operators import incidents, lookup


def looped(entries, needles, k):
    held = {}
    for pos, text in entries:
        if text is not None:
            held.setdefault(pos, []).append(text.lower())
    out = set()
    for n in {n.lower() for n in needles if n is not None}:
        hits = sorted(p for p, ts in held.items() if any(n in t for t in ts))[:k]
        out |= {(n, r, p) for r, p in enumerate(hits, 1)}
    return out


@pytest.mark.parametrize("send", [1_000_000, 0])
def test_search_equals_a_loop(spark, monkeypatch, send):
    monkeypatch.setattr(lookup, "SEND_ROWS", send)
    r = random.Random(send + 1)
    entries = [(r.randrange(200), "".join(r.choice("aaabcÉé 😀%_") for _ in range(r.randint(0, 40)))) for _ in range(400)] + [(3, None), (500, ""), (7, "x" * 5000 + "yz")]
    needles = ["", "a", "É", "zz", "AAA", "abca", "😀a", "%", "a_", "xxxxyz", None, "aaa", *("".join(r.choice("aab c") for _ in range(r.randint(1, 6))) for _ in range(60))]
    pieces, asked = spark.createDataFrame(entries, "pos long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    for k in (1, 7, 1000):
        assert {tuple(x) for x in lookup.search(pieces, asked, k).collect()} == looped(entries, needles, k)
    kept = lookup.indexed(pieces).cache()
    assert {tuple(x) for x in lookup.search(pieces, asked, 7, index=kept).collect()} == looped(entries, needles, 7)
    assert lookup.search(pieces.where("false"), asked, 3).count() == 0 and lookup.search(pieces, asked.where("false"), 3).count() == 0


def test_runbooks_beyond_any_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SEND_ROWS", 10)
    books = spark.range(20_000).selectExpr("cast(id as int) as pos", "concat('rb-', id) as id", "concat('Playbook ', id) as title", "array('Check CPU', concat('Restart node-', id % 7)) as steps")
    asked = spark.createDataFrame([("NODE-3",), ("playbook 19999",), ("cpu",), ("nothing",)], "query string")
    got = {(x.query, x.rank): (x.id, round(x.score, 6)) for x in incidents.retrieved(books, asked, 2).collect()}
    assert got == {("NODE-3", 1): ("rb-3", 1.0), ("NODE-3", 2): ("rb-10", 0.9), ("playbook 19999", 1): ("rb-19999", 1.0), ("cpu", 1): ("rb-0", 1.0), ("cpu", 2): ("rb-1", 0.9)}


def test_needles_are_found_in_one_scan_without_an_index(spark, monkeypatch):
    def never(*_):
        raise AssertionError("an index is made")

    monkeypatch.setattr(lookup, "indexed", never)
    r = random.Random(5)
    edge = "".join(r.choice("abc") for _ in range(lookup.SPAN + 40))
    entries = [(i, "".join(r.choice("ab c") for _ in range(60))) for i in range(300, 0, -1)] + [(900, edge), (2, "once more"), (None, "lost")]
    cuts = [edge[lookup.SPAN - 20 + i : lookup.SPAN + i + j] for i, j in ((0, 0), (10, 10), (19, 30), (25, 2))]
    needles = ["a", "ab", "lost", "abc" * 5, "", edge, edge + "x", *cuts, *(edge[i : i + n] for n in range(1, 2 * lookup.PROBE) for i in (0, 500))]
    found = lookup.search(spark.createDataFrame(entries, "pos long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"), 4)
    assert {tuple(x) for x in found.collect()} == looped([e for e in entries if e[0] is not None], needles, 4)
