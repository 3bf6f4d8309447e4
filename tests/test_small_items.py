from loamspark.operators import evaluation as ev
from loamspark.operators import joint as jt
from loamspark.operators import kmers as km
from loamspark.operators import mixture as mx


def test_hits_by_marker_and_times(spark):
    hits = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "b", "x"), (3, "c", "z")], "read_id int, marker string, species string")
    got = {r.species: (r.a, r.b, r.read_pct) for r in mx.species_by_marker(hits, ["a", "b"]).collect()}
    assert got == {"x": (1, 1, 200 / 3), "y": (1, 0, 100 / 3)}
    times = spark.createDataFrame([("p", 1.0), ("p", 3.0), ("q", 2.0), ("r", None)], "run string, seconds double")
    assert {r.run: (r.n, r.mean, r.sd) for r in ev.timings(times, "run").collect()} == {"p": (2, 2.0, 2**0.5), "q": (1, 2.0, 0.0), "r": (0, None, 0.0)}


def test_strains_without_reads_are_even(spark):
    none = spark.createDataFrame([], "read_id int, strain string, gene string, containment double")
    rows = jt.fit(none, 2, strains=["a", "b"], genes=["g", "h"]).collect()
    assert {(r.strain, r.gene, r.pi, r.phi, r.lo, r.hi, r.mobile, r.bic, r.converged) for r in rows} == {(s, g, 1 / 3, 0.5, 0.0, 1.0, 1 / 3, float("inf"), False) for s in "ab" for g in "gh"}
    assert jt.fit(none, 2).count() == 0


def test_genes_in_the_order_of_the_annotation(spark):
    table = spark.createDataFrame([("s", 50, "h")], "id string, pos int, hash string")
    genes = spark.createDataFrame([("s", 0, 100, "early", 2), ("s", 40, 60, "first", 1)], "id string, start int, end int, gene string, line int")
    assert km.genes_at(table, genes).first().gene == "early" and km.genes_at(table, genes, order="line").first().gene == "first"


def test_simulated_reads_leave_their_task_in_parts(spark, monkeypatch):
    from loamspark.operators import simulate as si

    rows = spark.createDataFrame([(i, "ACGTTGCA" * 30) for i in range(4)], "id int, sequence string").coalesce(1)
    want = sorted(map(tuple, si.reads(rows, 25, 50, 0.1).collect()))
    monkeypatch.setattr(si, "HELD", 10)
    assert len(want) == 100 and sorted(map(tuple, si.reads(rows, 25, 50, 0.1).collect())) == want
