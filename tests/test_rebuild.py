"""Comparison by digests against exceptAll both ways."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import rebuild


def both_ways(a, b):
    return sorted([(*r, "base") for r in a.exceptAll(b).collect()] + [(*r, "rebuild") for r in b.exceptAll(a).collect()], key=str)


def test_ten_rows_of_many_are_found_in_a_twentieth(spark, sf):
    base = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, F.lit("x")).alias("note"))
    edited = base.where("id <> 77").withColumn("note", F.when(F.col("id") % 2500 == 12, F.lit("edited")).otherwise(F.col("note"))).union(base.where("id = 78"))
    bits = rebuild.leaf_bits(20_000)
    a, b = rebuild.snapshot(base, "id", bits), rebuild.snapshot(edited, "id", bits)
    leaves = rebuild.differing(a, b)
    assert 0 < rebuild.inside(a, leaves).count() + rebuild.inside(b, leaves).count() < 40_000 / 20
    got = sorted(map(tuple, rebuild.changes(a, b).collect()), key=str)
    assert got == both_ways(base, edited) and len(got) == 8 * 2 + 2
    plan = rebuild.inside(a, leaves)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "_leaf" in plan.split("PushedFilters")[1]


@pytest.mark.parametrize("named", [5_000, 0])
def test_nulls_repeats_and_empty_builds(spark, monkeypatch, named):
    monkeypatch.setattr(rebuild, "NAMED", named)
    rows = [(None, "a", None), (None, "a", None), (1, None, "a"), (1, "a", None), (2, "", None), (3, None, None)]
    other = [(None, "a", None), (1, "a", None), (1, "a", None), (2, None, None), (3, None, ""), (None, "b", None)]
    schema = "id long, text string, note string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    for x, y in ((a, b), (a, a), (a, a.where("false")), (a.where("false"), b), (a.where("false"), a.where("false"))):
        sx, sy = rebuild.snapshot(x, "id", 8), rebuild.snapshot(y, "id", 8)
        assert sorted(map(tuple, rebuild.changes(sx, sy).collect()), key=str) == both_ways(x, y)
        checks = {r.check: r.same for r in rebuild.report(sx, sy, ["id"], "text").collect()}
        assert checks["rows"] == (x.count() == y.count()) and (x is not y or all(checks.values()))
    with pytest.raises(ValueError):
        rebuild.differing(sx, rebuild.snapshot(a, "id", 4))
