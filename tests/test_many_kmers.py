"""K-mers hashed in batches, and indexes cut to what the reads meet."""

import numpy as np
from pyspark.sql import functions as F

from loamspark.functions import dna
from loamspark.operators import kmers as km
from loamspark.operators import markers as mk
from loamspark.plans import inference  # noqa: F401
from loamspark.plans.catalog import QUERIES

RNG = np.random.default_rng(5)


def _text(n: int, letters: str = "ACGT") -> str:
    return "".join(RNG.choice(list(letters), n))


def test_hashes_in_batches_are_those_of_sparks_functions(spark, monkeypatch):
    monkeypatch.setattr(km, "ROWS", 900)
    monkeypatch.setattr(km, "CACHED", 256)
    texts = [_text(3000), None, "", "acgtn" * 9, _text(40) + "é" + _text(40), _text(20), _text(21), "ACGTÿ" * 3 + _text(30), *[_text(60, "ACGTN") for _ in range(40)]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id int, sequence string").select(F.struct("id").alias("id"), "sequence").coalesce(1)
    for k in (1, 4, 21, 31, 33):
        want = sorted(map(tuple, km.windows(rows, k).select("id.id", "pos", dna.hash_hex(F.least("kmer", "back"))).collect()))
        got = km.hashes(rows, k)
        assert got.dtypes == [("id", "struct<id:int>"), ("pos", "int"), ("hash", "string")]
        assert sorted((r.id.id, r.pos, r.hash) for r in got.collect()) == want
        assert sorted((r.id.id, r.pos, r.hash) for r in km.hashes(rows, k, scale=0.3).collect()) == [w for w in want if w[2] < dna.below(0.3)]
    assert "Generate" not in km.hashes(rows, 21)._jdf.queryExecution().executedPlan().toString()


def test_primers_in_batches_and_apart(spark, monkeypatch):
    monkeypatch.setattr(km, "ROWS", 300)
    monkeypatch.setattr(km, "CACHED", 64)
    texts = ["ACG", "TAC", _text(900), None, "acgtac", "AÿGTAC"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, sequence string").coalesce(1)
    for primer, most in (("RCNTAY", 0), ("RCNTAY", 2), ("ACGTAC", 1)):
        want = []
        for i, s in enumerate(t.upper() if t else "" for t in texts):
            for at in range(len(s) - 5):
                n = sum(c not in km.IUPAC[p] for c, p in zip(s[at : at + 6], primer, strict=True))
                want += [(i, at, n)] if n <= most else []
        assert sorted(map(tuple, km.primer_hits(rows, primer, most).collect())) == want


def test_rows_that_reads_meet(spark, monkeypatch):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "y")], "id int, pos int, hash string")
    b = spark.createDataFrame([(7, "x"), (7, "z"), (7, "x"), (8, "w")], "id int, hash string")
    for most in (0, km.BROADCAST):
        monkeypatch.setattr(km, "BROADCAST", most)
        assert sorted(map(tuple, km.met(b, a).collect())) == [(7, "x"), (7, "x")]
        assert list(map(tuple, km.containment(a, b, distinct=False, jaccard=False).collect())) == [(1, 7, 2, 2 / 3)]


def test_a_part_of_a_marker_index_classifies_alike(spark):
    long = [_text(400) for _ in range(6)]
    refs = spark.createDataFrame([(i % 3, i % 2, s) for i, s in enumerate(long)] + [(2, 0, long[0][:18])], "species int, marker int, sequence string")
    primers = spark.createDataFrame([(i % 2, s[:20]) for i, s in enumerate(long)], "marker int, sequence string")
    reads = spark.createDataFrame([(i, s[i * 9 : i * 9 + 90]) for i, s in enumerate(long[:4])], "id int, sequence string")
    whole, part = (mk.build(refs, primers, scale=0.2, reads=r) for r in (None, reads))
    assert part.fine.count() < whole.fine.count() / 4 and part.coarse.count() < whole.coarse.count()
    want = sorted(map(tuple, mk.classify(reads, whole).collect()))
    assert want and sorted(map(tuple, mk.classify(reads, part).collect())) == want


def test_fine_sizes_are_those_of_the_index_without_a_row_for_each_kmer(spark, monkeypatch):
    monkeypatch.setattr(km, "SORTED", 700)
    monkeypatch.setattr(km, "CACHED", 256)
    texts = [_text(3000), None, "", "acgtn" * 9, _text(40) + "é" + _text(40), _text(14), _text(15), _text(20), _text(21), *[_text(60, "ACGTN") for _ in range(40)]]
    refs = spark.createDataFrame([(i % 3 if i % 7 else None, i % 2, s) for i, s in enumerate([*texts, *texts[:3]])], "species long, marker int, sequence string").repartition(3)
    want = mk.build(refs, refs.select("marker", "sequence"), scale=1.0).fine.groupBy("species", "marker").count()
    got = mk.fine_sizes(refs)
    assert got.dtypes == [("species", "bigint"), ("marker", "int"), ("n", "bigint")]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.withColumnRenamed("count", "n").collect()))
    rows = spark.createDataFrame([(1, "ACGTACGTTT" * 5000)], "id int, sequence string")
    assert [tuple(r) for k in (1, 2, 31) for r in km.distinct_counts(rows, k, 50_000, "id").collect()] == [(1, km.windows(rows, k).select(F.least("kmer", "back")).distinct().count()) for k in (1, 2, 31)]


def test_fine_sizes_query_shuffles_no_row_for_each_kmer(spark, small):
    plan = QUERIES["km_20_fine_index_sizes"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "codes" in plan and "hash string" not in plan and " hash#" not in plan
