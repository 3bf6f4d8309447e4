import numpy as np
from pyspark.sql import functions as F

from loamspark.llm import hard_negatives as h
from loamspark.llm import queries

NAN, INF = float("nan"), float("inf")


def brute(ids, labels, x, asked):
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    out = []
    for a in np.flatnonzero(asked):
        score = v @ v[a]
        order = np.lexsort((ids, -score))
        order = order[ids[order] != ids[a]]
        for p in [i for i in order if labels[i] == labels[a]][:5]:
            fits = [i for i in order if labels[i] != labels[a] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(int(ids[a]), int(ids[p]), n + 1, int(ids[i]), int(score[p]), int(score[i])) for n, i in enumerate(fits)]
    return sorted(out)


def table(spark, ids, labels, x, n=3):
    rows = [(int(i), r.tolist(), int(y)) for i, y, r in zip(ids, labels, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(n)


def answer(df, step=10):
    return sorted(map(tuple, h.mine(df, F.col("vec_id") % step == 0).collect()))


def test_query_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    labels = np.array([(r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label for r in rows])
    got = queries.op11_hard_negatives(spark, small)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(ids, labels, x, ids % 100 == 0)


def test_rounds_ties_and_crowds(spark, monkeypatch):
    """Several pivots, small blocks and many rounds; a third of the rows is one vector, scores tie, one label is rare."""
    monkeypatch.setattr(h, "BLOCK_ROWS", 16)
    monkeypatch.setattr(h, "FIRST", 1)
    monkeypatch.setattr(h, "GROWTH", 6)
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((6, 5))
    x = np.round(centres[rng.integers(0, 6, 600)] + 0.2 * rng.standard_normal((600, 5)), 1)
    x[rng.permutation(600)[:200]] = x[0]
    x[5] = 0
    ids, labels = rng.permutation(2000)[:600], rng.integers(0, 4, 600)
    labels[:3] = 9
    ids[0] = 5000
    got = answer(table(spark, ids, labels, x, 5), 50)
    want = brute(ids, labels, x, ids % 50 == 0)
    assert got == want and len(want) > 200


def test_annuli_leave_blocks_out(spark, monkeypatch):
    """In clustered data a query meets a part of the blocks."""
    monkeypatch.setattr(h, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(13)
    x = np.repeat(np.eye(16)[:, :16], 200, axis=0) + 0.02 * rng.standard_normal((3200, 16))
    ids, labels = np.arange(3200), np.arange(3200) % 3
    cut, size = h.cut_rows(table(spark, ids, labels, x))
    rows = cut.persist()
    index, layout = h.build(rows, size)
    assert index.agg(F.sum(F.octet_length("ids") / 8)).first()[0] == 3200
    asks = rows.where("id % 100 = 0").select(F.col("id").alias("query"), "label", "ints", F.array(F.lit(h._NONE).cast("long")).alias("least"), F.array(F.lit(-h._NONE - 1).cast("long")).alias("most"))
    met = []
    scanned = h._scanned
    monkeypatch.setattr(h, "_scanned", lambda index, tiles, *a: met.append(tiles.selectExpr("sum(size(asks))").first()[0]) or scanned(index, tiles, *a))
    found = h.search(index, layout, asks, size, True, 5)
    assert found.count() == 32 * 5
    print(met, index.count())
    assert sum(met) < 0.5 * 32 * index.count()
    rows.unpersist()


def test_rows_that_take_no_part(spark):
    kept = [(10, [1.0, 0.0], 1), (11, [0.9, 0.0], 1), (12, [0.5, 0.3], 2), (13, [0.0, 0.0], 2), (14, [0.5, -0.3], 3), (14, [0.5, -0.3], 3), (20, [-1.0, 0.0], 1), (30, [0.0, 0.0], 7)]
    odd = [(40, None, 1), (50, [None, 1.0], 1), (60, [NAN, 1.0], 1), (70, [INF, 1.0], 1), (80, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (90, [1.0], 1), (100, [], 2)]
    df = spark.createDataFrame(kept + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS ids", "3 AS block", "4 AS query", "5 AS ints", "6 AS score", "7 AS rank", "8 AS pivot", "9 AS slot")
    got = answer(df)
    assert got == [(10, 11, 1, 12, 256 * 230, 256 * 128), (10, 11, 2, 14, 256 * 230, 256 * 128)]
    for none in (df.limit(0), df.where("vec_id in (40, 50)"), df.where("vec_id = 10"), df.where("vec_id = 100")):
        assert answer(none) == []


def test_bands_at_negative_and_zero_scores(spark):
    ids, labels = np.array([10, 1, 2, 3, 4]), np.array([0, 0, 0, 1, 1])
    x = np.array([[1.0, 0.0], [-0.5, 0.0], [0.0, 1.0], [0.0, -3.0], [-0.4, 0.0]])
    assert answer(table(spark, ids, labels, x)) == brute(ids, labels, x, ids % 10 == 0) == [(10, 2, 1, 3, 0, 0)]


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(17)
    x = rng.integers(-90_000, 90_000, (60, 3)) + 0.0
    ids, labels = np.arange(60), np.arange(60) % 2
    assert answer(table(spark, ids, labels, x)) == brute(ids, labels, x, ids % 10 == 0)
