"""The pipeline against its stages done plainly, one after the other."""

import numpy as np

import corpus_pipeline
from quillspark.llm import decontam, quality_rules

from . import plain


def test_stages_return_documents(spark, sf, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_pipeline(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    passed = {r._id for r in quality_rules.judge(docs, labels).where("_kept").select("_id").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in passed}
    top = plain.components({i: plain.fingerprint(t, 5) for i, t in rows.items()}, 3)
    rows = {i: t for i, t in rows.items() if top[i] == i}
    bodies = [t.encode() for t in rows.values()]
    rows = {i: plain.kept(b, g).decode("utf-8", "ignore") for i, b, g in zip(rows, bodies, plain.repeats(bodies, 400), strict=True)}
    left = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    leaked = {r.doc_id for r in decontam.matches(left, bench).collect()}
    items = [r.text for r in bench.collect()]
    assert {i for i, t in rows.items() if any(x in t for x in items)} <= leaked
    enc = plain.encoding()
    want = {}
    for i, t in rows.items():
        if i not in leaked:
            ids = np.array(enc.encode_ordinary(t), "<u4")
            want[i] = (len(ids), plain.sha(ids.tobytes()), plain.sha(t.encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_on_odd_rows(spark, odd, none, sf):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
        assert stage(spark, none, sf).count() == 0, name
        if name != "byte-level bpe":
            assert out.schema.simpleString() == odd.schema.simpleString(), name
            assert set(ids) <= {r.doc_id for r in odd.select("doc_id").collect()}
    cleaned = corpus_pipeline.repeated_passages(spark, odd, sf).collect()
    assert len(cleaned) == odd.count() and sum(r.text is None for r in cleaned) == 2 and all(r.n_chars is None for r in cleaned if r.text is None)
