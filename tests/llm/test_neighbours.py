"""Licences that read alike, and test items that share a common n-gram with a text."""

import random
import time

import numpy as np
import pyarrow as pa

from quillspark.llm import decontam, licenses


def test_neighbouring_licences_get_their_own_names(spark):
    sets = [(n, set(licenses.bigrams(b))) for n, b in licenses.TEMPLATES]
    near = {k for i, (n, a) in enumerate(sets) for j, (m, b) in enumerate(sets) if n != m and 2 * len(a & b) / (len(a) + len(b)) >= licenses.THRESHOLD for k in (i, j)}
    rows = [(k, licenses.TEMPLATES[k][1]) for k in sorted(near)]
    named = {"BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MIT", "MIT-0", "ISC", "0BSD"}
    assert named <= {licenses.TEMPLATES[k][0] for k in near}
    rows += [(1000, "Licensed under the GNU Affero General Public License, version 3"), (1001, "Neither edited: " + licenses.TEMPLATES[sorted(near)[-1]][1])]
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, licenses.TEMPLATES[k][0]) for k in near} | {(1000, "AGPL-3.0")} <= found
    assert all(n == licenses.TEMPLATES[i][0] for i, n in found if i < 1000)


def test_a_common_ngram_of_many_items_costs_one_test_a_pair():
    r = random.Random(1)
    body = [f"w{r.randrange(5000)}" for _ in range(6000)]
    for k in range(200):
        body[30 * k : 30 * k + 3] = ["one", "of", "the"]
    asked = []
    for k in range(2000):
        item = [f"i{k}q{j}" for j in range(30)]
        item[5:8] = ["one", "of", "the"]
        asked.append(" ".join(item))
    asked.append(" ".join(body[100:130]))
    items = decontam.Items(list(range(len(asked))), asked)
    seeds = items.seeds(items.keys(), np.ones(len(items.keys()), int))
    began = time.process_time()
    found = list(decontam.scan(pa.array([" ".join(body)]), items, seeds, decontam.filter_bits(seeds.keys), 0.5))
    assert time.process_time() - began < 1
    assert {(row, item) for row, item, score, *_ in found if score == 1} == {(0, 2000)}


def test_passages_do_not_depend_on_the_size_of_a_pass(monkeypatch):
    r = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    texts = pa.array([" ".join(r.choices(words, k=n)) for n in (0, 40, 900, 30)])
    items = decontam.Items(list(range(60)), [" ".join(r.choices(words, k=r.randint(1, 20))) for _ in range(60)])
    seeds = items.seeds(items.keys(), np.ones(len(items.keys()), int))
    want = sorted(decontam.scan(texts, items, seeds, decontam.filter_bits(seeds.keys), 0.5))
    monkeypatch.setattr(decontam, "CELLS", 7)
    assert want and sorted(decontam.scan(texts, items, seeds, decontam.filter_bits(seeds.keys), 0.5)) == want
