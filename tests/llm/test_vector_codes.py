import numpy as np
from pyspark.sql import functions as F

from loamspark.llm import queries
from loamspark.llm import vector_codes as v

NAN, INF = float("nan"), float("inf")


def brute(ids, labels, x, entries=256, rounds=4):
    """Rounds over all distances, rows in ascending order of id."""
    order = np.argsort(ids, kind="stable")
    parts = np.floor(1024 * x.astype(float)).astype(np.int64)[order].reshape(len(x), 4, -1)
    books = [parts[:entries, p].copy() for p in range(4)]

    def nearest(p):
        d = ((parts[:, p, None] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(4):
            at, _ = nearest(p)
            for e in np.unique(at):
                own = parts[at == e, p]
                books[p][e] = np.floor_divide(own.sum(axis=0), len(own))
    found = [nearest(p) for p in range(4)]
    error = sum(f[1] for f in found)
    labels = [labels[i] for i in order]
    total = {k: sum(int(e) for e, y in zip(error, labels, strict=True) if y == k) for k in set(labels)}
    return sorted((int(ids[order[i]]), "".join(f"{f[0][i]:02x}" for f in found), int(error[i]), total[labels[i]]) for i in range(len(x))), np.array(books)


def answer(df):
    codes, books = v.compress(df)
    return sorted((r.vec_id, r.code.hex(), r.error, r.label_error) for r in codes.collect()), books


def test_tree_equals_brute_force():
    rng = np.random.default_rng(3)
    for size, span in ((1, 3), (4, 2), (16, 300), (3, 2**27)):
        entries = rng.integers(-span, span + 1, (256, size))
        x = np.concatenate([rng.integers(-span - 1, span + 2, (2000, size)), entries])
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        at, far = v.Tree.build(entries).nearest(x)
        assert (at == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all(), size
    same = v.Tree.build(np.ones((40, 2), np.int64))
    assert (same.nearest(np.array([[1, 1], [5, 0]]))[0] == 0).all()


def test_query_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    want, books = brute(np.array([r.vec_id for r in rows]), [r.label for r in rows], np.array([r.embedding for r in rows]))
    got = queries.op13_vector_codes(spark, small).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {v.digest(books)}


def test_ties_copies_and_crowds(spark):
    """Half the rows are one vector, start entries are equal, distances tie; negative means are floored."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (900, 8)).astype(float) / 1024
    x[::2] = x[0]
    ids, labels = rng.permutation(900), [None if i % 7 == 0 else i % 3 for i in range(900)]
    df = spark.createDataFrame([(int(i), r.tolist(), y) for i, r, y in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<double>, label int").repartition(7)
    got, books = answer(df)
    want, expected = brute(ids, labels, x)
    assert got == want and (books == expected).all()


def test_rows_that_take_no_part(spark):
    kept = [(3, [1.0, 0.0, 0.0, -0.0001], None), (1, [0.0] * 4, 1), (None, [1.0, 1.0, 1.0, 1.0], 1), (3, [1.0, 0.0, 0.0, 0.0], None)]
    odd = [(4, None, 1), (5, [None, 0.0, 0.0, 0.0], 1), (6, [NAN, 0.0, 0.0, 0.0], 1), (7, [0.0, -INF, 0.0, 0.0], 1), (8, [1.0], 1), (9, [], None)]
    df = spark.createDataFrame(kept + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS code", "'a' AS error", "3 AS own", "4 AS ints", "5 AS label_error", "6 AS part", "7 AS size")
    codes, books = v.compress(df)
    got = sorted((r.vec_id or 0, r.code.hex(), r.error, r.label, r.label_error) for r in codes.collect())
    # Part 3 of id 3 is -1 or 0; the rows start codebooks by id, those without id last.
    assert books[0].reshape(-1).tolist() == [0, 1024, 1024, 1024] and sorted(books[3].reshape(-1).tolist()) == [-1, 0, 0, 1024]
    assert [g[0] for g in got] == [0, 1, 3, 3] and all(g[2] == 0 and g[4] == 0 for g in got)
    assert got[1][1] == "00000000"
    for none in (df.limit(0), df.where("vec_id in (4, 5, 6)")):
        codes, books = v.compress(none)
        assert codes.collect() == [] and codes.columns == ["vec_id", "label", "code", "error", "label_error"] and v.digest(books)


def test_lengths_clamps_and_decoding(spark):
    """A length that 4 does not divide is filled up; huge components are clamped; codes name their entries."""
    rows = [(i, [float(i), 0.5, -1e30 if i == 2 else 1.0, 0.0, 2.0], 0) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes, books = v.compress(df)
    assert books.shape == (4, 6, 2) and int(books.min()) == -v.largest(8)
    near = v.decoded(codes.where("vec_id <> 2").withColumn("none", F.lit(None).cast("binary")), books)
    assert sorted(tuple(r.approximation[:5]) for r in near.collect()) == [tuple(r[1]) for r in rows if r[0] != 2]
    assert v.decoded(near.drop("approximation"), books, "none").where("approximation IS NOT NULL").count() == 0
