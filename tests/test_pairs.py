"""Sums of all pairs by blocks against dense numpy, with blocks of a few items and Arrow batches of a few rows."""

from __future__ import annotations

import numpy as np
import pytest

from loamspark.operators import distances as ds
from loamspark.operators import network as nw
from loamspark.operators import pairs as ps


@pytest.mark.parametrize("block,batch", [(5, 7), (1024, 10_000), (40, 1)])
def test_sums_equal_dense_ones(spark, monkeypatch, block, batch):
    monkeypatch.setattr(ps, "BLOCK", block)
    monkeypatch.setattr(ps, "_AXES", 3)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (23, 31)) * (rng.random((23, 31)) < 0.4)
    x[:, 4] = 1 + np.arange(23)
    x[7] = 0
    cells = spark.createDataFrame([(f"s{i:02}", int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))] + [("s07", None, 0.0)], "item string, axis int, value double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for kind, f in (("dot", lambda a, b: a * b), ("min", np.minimum)):
            got = {(r.a, r.b): r for r in ps.pair_sums(cells, kind).collect()}
            assert len(got) == 23 * 22 // 2
            for i in range(23):
                for j in range(i + 1, 23):
                    r = got[f"s{i:02}", f"s{j:02}"]
                    assert (r.m, r.ta, r.tb, r.qa, r.qb) == pytest.approx((f(x[i], x[j]).sum(), x[i].sum(), x[j].sum(), (x[i] ** 2).sum(), (x[j] ** 2).sum()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_no_products_in_plans(spark):
    rows = [(f"f{i}", f"s{j}", float((i * j) % 5)) for i in range(6) for j in range(4)]
    table = spark.createDataFrame(rows, "feature_id string, sample_id string, value double")
    meta = spark.createDataFrame([(f"s{j}", "g" if j < 2 else "h") for j in range(4)], "sample_id string, grp string")
    for df in (nw.phi(table), nw.phi(table, 0.5), nw.phi_by_group(table, meta)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    empty = spark.createDataFrame([("f", "s", 0.0), ("f", "t", 0.0)], "feature_id string, sample_id string, value double")
    assert [r.d for r in ds.bray_curtis(empty).collect()] == [None] and [r.d for r in ds.jaccard(empty).collect()] == [0.0]
    assert ds.bray_curtis(empty.limit(0)).collect() == [] and nw.phi(empty).collect() == []


@pytest.mark.parametrize("kind", ["int", "string"])
def test_jaccard_by_blocks_makes_no_row_for_a_shared_feature(spark, monkeypatch, kind):
    monkeypatch.setattr(ds, "BLOCK", 8)
    rng = np.random.default_rng(4)
    name = (lambda x: x) if kind == "int" else (lambda x: f"é{x}")
    # A feature that all have, samples without any, and zeros.
    own = {s: {f for f in range(1, 40) if rng.random() < 0.2} | {0} for s in range(30)} | {30: set(), 31: set()}
    rows = [(name(f), name(s), 1.5) for s, x in own.items() for f in x] + [(name(99), name(s), 0.0) for s in own]
    got = ds.jaccard(spark.createDataFrame(rows, f"feature_id {kind}, sample_id {kind}, value double"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = {tuple(sorted((name(a), name(b)))): 1 - len(own[a] & own[b]) / len(own[a] | own[b]) if own[a] | own[b] else 0.0 for a in own for b in own if a < b}
    found = got.collect()
    assert len(found) == len(want) and {(r.s1, r.s2): r.d for r in found} == pytest.approx(want)
