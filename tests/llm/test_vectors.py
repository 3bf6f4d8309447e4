import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamspark.llm import embedding_dedup as e
from loamspark.llm import hilbert_ann as h
from loamspark.llm import queries

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d), axis=-1).reshape(-1, d)
        keys = h.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**d))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def rows_of(spark, d):
    got = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in got]), np.array([r.embedding for r in got], float)


def brute_nearest(ids, x, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = INF
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), d[i]) for i in order]


def test_ann_recall_and_scores(spark, small):
    for d, floor in ((small, 1.0), (small.replace("0.001", "0.1"), 0.9), ("/root/testdata/check_s", 0.9)):
        if not os.path.isdir(d):
            continue
        ids, x = rows_of(spark, d)
        got = {}
        for r in queries.op1_hilbert_ann(spark, d).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        asked = sorted(int(i) for i in ids if i % 100 == 0)
        assert sorted(got) == asked
        hits = total = 0
        for q in asked:
            want = brute_nearest(ids, x, q, 10)
            mine = sorted(got[q])
            assert [m[0] for m in mine] == list(range(1, len(want) + 1))
            assert [m[2] for m in mine] == sorted(m[2] for m in mine)
            for _, i, s in mine:
                assert abs(s - math.sqrt(((x[ids == q][0] - x[ids == i][0]) ** 2).sum())) < 1e-12
            hits += len({i for i, _ in want} & {m[1] for m in mine})
            total += len(want)
        print(d, hits / total)
        assert hits >= floor * total, (d, hits / total)


def test_ann_edges(spark):
    good = [(i, [float(i % 3), 1.0], 0) for i in range(1, 30)] + [(100, [1.0, 1.0], 0), (100, [1.0, 1.0], 0)]
    odd = [(200, None, 0), (300, [0.0, 0.0], 0), (400, [None, 1.0], 0), (500, [NAN, 1.0], 0), (600, [INF, 1.0], 0), (700, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (800, [], 0)]
    df = table(spark, good + odd)
    got = sorted(map(tuple, h.search(df, df.where("vec_id % 100 = 0")).collect()))
    assert [(q, r, v, s) for q, r, v, s in got] == [(100, i + 1, 3 * i + 1, 0.0) for i in range(10)]
    few = table(spark, good[:3] + odd)
    got = sorted(map(tuple, h.search(few, few.where("vec_id = 2")).collect()))
    assert [g[:3] for g in got] == [(2, 1, 1), (2, 2, 3)] and abs(got[1][3] - 2) < 1e-12 and abs(got[0][3] - 1) < 1e-12
    assert h.search(df.limit(0), df).count() == 0
    assert h.search(table(spark, odd[:2]), df).count() == 0


def test_ann_clashes_and_repeated_ids(spark):
    rows = [(i, [float(i % 4), 1.0], i) for i in range(1, 20)] + [(5, [9.0, 9.0], 5), (100, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id int").selectExpr("*", "1 AS node", "2 AS slot", "3 AS bucket", "4 AS turn", "5 AS ids", "6 AS id", "7 AS ok", "8 AS h1", "9 AS asks")
    got = sorted(map(tuple, h.search(df, df.where("vec_id in (7, 100)")).collect()))
    assert [g[2] for g in got if g[0] == 100] == [1, 5, 9, 13, 17, 2, 4, 6, 8, 10]
    assert [g[2] for g in got if g[0] == 7] == [3, 11, 15, 19, 2, 6, 10, 14, 18, 1]


def test_ann_work(spark):
    """Each query is compared with a fourth of the table at most, each row once, and finds 0.9 of its neighbours, in data without structure."""
    x = np.random.default_rng(23).standard_normal((51_282, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 64, pa.int32()), pa.array(x.reshape(-1)))
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": flat}))
    reps = h.representatives(table).select("node", "embedding")
    n = reps.count()
    asked = table.where("vec_id % 400 = 0").select(F.col("vec_id").alias("id"), "embedding")
    curves = h.sampled(reps.withColumn("id", F.col("node")), n)
    lists = h.candidates(reps, asked, curves).collect()
    seen = {}
    for r in lists:
        seen.setdefault(r["query"], []).append(np.frombuffer(r["ids"], np.int64))
    compared = [len(np.unique(np.concatenate(v))) for v in seen.values()]
    print(n, np.mean(compared) / n, max(compared) / n)
    assert len(seen) == asked.count() and np.mean(compared) <= 0.25 * n
    rows = reps.toPandas()
    x, node = np.stack(rows["embedding"]).astype(float), rows["node"].to_numpy()
    hits = 0
    for r in asked.collect():
        d = ((x - np.array(r.embedding, float)) ** 2).sum(axis=1)
        hits += np.isin(node[np.argsort(d)[1:11]], np.concatenate(seen[r.id])).sum()
    print(hits / (10 * len(seen)))
    assert hits >= 0.9 * 10 * len(seen)


def test_nearest_breaks_ties_by_id():
    x = np.array([[1.0, 0], [0, 1.0], [-1.0, 0], [0, -1.0], [3, 3]])
    best, far = h.nearest(np.zeros(2), x, np.array([9, 4, 7, 1, 0]), 3)
    assert best.tolist() == [3, 1, 2] and far.tolist() == [1, 1, 1]


def brute_links(ids, x):
    n = np.linalg.norm(x, axis=1)
    cos = (x @ x.T) / np.outer(n, n)
    near = cos >= 0.95
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label, 2**62).min(axis=1))
        if (new == label).all():
            return {int(i): (int(k), int(c)) for i, k, c in zip(ids, near.sum(axis=1), label)}
        label = new


def test_chances():
    rng = np.random.default_rng(0)
    for deviation in (0.3, 1.4):
        d, at = rng.normal(0, deviation, 200_000), rng.random(200_000) * e.WIDTH
        assert abs((np.floor((at + d) / e.WIDTH) == 0).mean() - e.same_window(deviation)) < 0.005
    assert e.plan(100) == e.Plan(1, 0, e.plan(100).count)
    p = e.plan(50_000)
    assert 1 - (1 - e.same_window(math.sqrt(0.1)) ** p.depth) ** p.buckets >= e.MEETING
    assert e.plan(10**9).buckets < 400


def near_copies(rng, base, cos, n):
    out = []
    for _ in range(n):
        v = rng.standard_normal(len(base))
        v -= (v @ base) * base
        out.append(cos * base + math.sqrt(1 - cos * cos) * v / np.linalg.norm(v))
    return out


def test_links_near_the_threshold(spark, monkeypatch):
    """Buckets of several projections, large ones split: pairs from 0.951 up are found, none below 0.95."""
    monkeypatch.setattr(e, "STRANGERS", 20)
    monkeypatch.setattr(e, "BUCKET_ROWS", 32)
    rng = np.random.default_rng(5)
    x = list(rng.standard_normal((1500, 64)) / 8)
    for cos in (0.951, 0.955, 0.97, 0.99, 0.949):
        for _ in range(40):
            b = rng.standard_normal(64)
            b /= np.linalg.norm(b)
            x += [b * 3, *near_copies(rng, b, cos, 1)]
    b = np.ones(64) / 8
    x += [b] * 30 + near_copies(rng, b, 0.99, 120)
    x = np.array(x).astype(np.float32)
    ids = rng.permutation(len(x)) + 10
    want = brute_links(ids, x.astype(float))
    got = e.dedup(table(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x)])).collect()
    assert len(got) == len(x)
    links = sum(r.n_links for r in got)
    true = sum(k for k, _ in want.values())
    assert 0.995 * true <= links <= true
    wrong = [r for r in got if (r.n_links, r.component_id) != want[r.vec_id]]
    assert len(wrong) <= 4 and all(r.n_links <= want[r.vec_id][0] for r in wrong)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_dedup_edges(spark):
    rows = [(5, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (9, [2.0, 0.001], 0), (1, [0.0, 1.0], 0), (2, None, 0), (4, [0.0, 0.0], 0), (6, [None, 1.0], 0), (7, [NAN, 1.0], 0), (8, [-INF, 1.0], 0), (None, [1.0, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [], 0), (5, [1.0, 0.0], 0)]
    got = sorted(map(tuple, e.dedup(table(spark, rows)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 4, 6, 7, 8, 11, 12)]
    assert got == sorted([(5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (9, 3, 3, False), (None, 0, None, True), *alone], key=str)
    assert e.dedup(table(spark, rows).limit(0)).count() == 0


def test_dedup_query(spark, small):
    for d in (small.replace("0.001", "0.1"), "/root/testdata/check_h"):
        if not os.path.isdir(d):
            continue
        ids, x = rows_of(spark, d)
        want = brute_links(ids, x)
        got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op7_embedding_dedup(spark, d).collect()}
        assert got == want
