"""Generation and training against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from quillspark.operators import generation, models, training
from quillspark.operators.numeric import NAMES


def hashed(*parts, n):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) % n


def continued(bodies, prompts, steps, order, temperature, greedy, top_k, seed):
    counts = defaultdict(Counter)
    for b in bodies:
        for i, c in enumerate(b):
            for k in range(min(i, order - 1) + 1):
                counts[b[i - k : i]][c] += 1
    alphabet = sorted(counts[""])
    out = {}
    for id, text in prompts:
        new = ""
        for step in range(steps):
            ctx = ((text or "") + new)[-(order - 1) :] if order > 1 else ""
            p = []
            for c in alphabet:
                x = 1.0 / len(alphabet)
                for k in range(len(ctx) + 1):
                    seen = counts.get(ctx[len(ctx) - k :])
                    if seen:
                        x = (seen[c] + len(seen) * x) / (seen.total() + len(seen))
                p.append(x)
            if greedy:
                at = p.index(max(p))
            else:
                w = [x ** (1 / temperature) for x in p]
                if top_k:
                    kth = sorted(w, reverse=True)[min(top_k, len(w)) - 1]
                    w = [x if x >= kth else 0.0 for x in w]
                u = (hashed("generate", seed, step, id, n=1 << 32) + 0.5) / 2**32 * sum(w)
                total, at = 0.0, 0
                for x in w:
                    total += x
                    at += total <= u
                at = min(at, len(w) - 1)
            new += alphabet[at]
        out[id] = new
    return out


@pytest.mark.parametrize(("seed", "temperature", "greedy", "top_k"), [(1, 1.0, False, None), (2, 0.7, False, 4), (3, 1.0, False, 1), (0, 1.0, True, None)])
def test_generation_equals_a_plain_loop(spark, seed, temperature, greedy, top_k):
    r = random.Random(9)
    bodies = ["".join(r.choice("ab cdé") for _ in range(60)) for _ in range(20)]
    prompts = [(1, "ab"), (2, ""), (3, None), (4, "zzzz"), (5, "a b c d"), (6, "é")]
    counts = models.ngram_counts_of(models.grams(spark.createDataFrame([(b,) for b in bodies], "body string"), [])).cache()
    df = spark.createDataFrame(prompts, "id long, text string")
    made = generation.generate(df, counts, 6, temperature=temperature, greedy=greedy, top_k=top_k, seed=seed)
    assert {x.id: x.new for x in made.collect()} == continued(bodies, prompts, 6, 5, temperature, greedy, top_k, seed)
    assert generation.generate(df.where("false"), counts, 2).count() == 0
    with pytest.raises(ValueError):
        generation.generate(df, counts.where("false"), 1)


def test_training_equals_a_plain_loop(spark):
    r = random.Random(3)
    rows = [(i, r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(120)]
    rows = [(i, x, z, float(x * z < 0)) for i, x, z in rows] + [(500, None, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, x1 double, x2 double, y double")
    runs = [(1, 0.05), (2, 0.3)]
    steps, epochs = training.train(df.where("event_id % 4 <> 0"), df.where("event_id % 4 = 0"), runs, 2, 5)
    got = {(s.run, s.epoch, s.batch): s for s in steps.collect()}
    ends = {(e.run, e.epoch): e for e in training.checkpoints(epochs).collect()}

    def outputs(p, x, z):
        a = [p[f"w1_{i}1"] * x + p[f"w1_{i}2"] * z + p[f"b1_{i}"] for i in (1, 2)]
        return a, sum(p[f"w2_{i + 1}"] * max(a[i], 0) for i in (0, 1)) + p["b2"]

    for run, (seed, rate) in enumerate(runs):
        p = dict(training.START)
        for epoch in (1, 2):
            for batch in range(5):
                own = [q for q in rows if q[1] is not None and q[0] % 4 and hashed("batch", seed, epoch, q[0], n=5) == batch]
                g, loss, active = dict.fromkeys(NAMES, 0.0), 0.0, 0
                for _, x, z, y in own:
                    a, f = outputs(p, x, z)
                    loss += 0.5 * (f - y) ** 2
                    active += (a[0] > 0) + (a[1] > 0)
                    g["b2"] += f - y
                    for i in (1, 2):
                        g[f"w2_{i}"] += (f - y) * max(a[i - 1], 0)
                        up = (f - y) * p[f"w2_{i}"] if a[i - 1] > 0 else 0.0
                        g[f"b1_{i}"] += up
                        g[f"w1_{i}1"] += up * x
                        g[f"w1_{i}2"] += up * z
                s, n = got[run, epoch, batch], len(own)
                assert s.points == n and s.loss == pytest.approx(loss / n) and s.active == pytest.approx(active / 2 / n)
                assert s.gradient_norm == pytest.approx(math.sqrt(sum((v / n) ** 2 for v in g.values())))
                p = {k: v - rate * g[k] / n for k, v in p.items()}
            held = [(outputs(p, x, z)[1], y) for i, x, z, y in rows if x is not None and i % 4 == 0]
            assert ends[run, epoch].val_loss == pytest.approx(sum(0.5 * (f - y) ** 2 for f, y in held) / len(held))
            assert ends[run, epoch].val_accuracy == pytest.approx(sum((f > 0.5) == (y > 0.5) for f, y in held) / len(held))
        best = min((1, 2), key=lambda e: ends[run, e].val_loss)
        assert [e for e in (1, 2) if ends[run, e].is_best] == [best]


def test_weights_are_made_once_a_context(spark):
    """Powers, cut and sums are no nested lambdas, which would be run again for each character."""
    p = spark.createDataFrame([("a", [0.1, 0.4, 0.2, 0.3]), ("b", [0.25] * 4)], "ctx string, p array<double>")
    made = generation.weights(p, 2.0, 2)
    got = {r.ctx: (r.upto, r.best) for r in made.collect()}
    assert got["a"][0] == pytest.approx([0, 0.16, 0.16, 0.25]) and got["a"][1] == 1
    assert got["b"][0] == pytest.approx([0.0625, 0.125, 0.1875, 0.25]) and got["b"][1] == 0
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
