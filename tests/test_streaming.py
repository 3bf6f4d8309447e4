"""A stream of reads in several batches counts as the batch query does; a read's hashes may come in any of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loamspark.functions import special
from loamspark.operators import functional as fu
from loamspark.operators import kmers as km
from loamspark.streaming import classify as sc

SCHEMA = "id string, sequence string"


def test_three_batches_equal_one(spark, tmp_path):
    rng = random.Random(2)
    genomes = {n: "".join(rng.choice("ACGT") for _ in range(900)) for n in ("A", "B")}
    index = km.hashes(spark.createDataFrame(list(genomes.items()), SCHEMA), 21).select(F.col("id").alias("species"), "hash").distinct()
    # Pieces of one read come in several files, and overlap: their common k-mers count once.
    parts = [[("r1", genomes["A"][:300]), ("r2", genomes["B"][100:160])], [("r1", genomes["A"][200:500]), ("r3", "ACGTN" * 30), ("r4", None)], [("r1", genomes["A"][200:500]), ("r1", genomes["B"][:40]), ("r2", "short")]]
    folder = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sc.latest(sc.counts(stream, index), ["id", "species"], "hashes", spark)
    every = spark.read.parquet(folder)
    want = sc.hits(every, index).groupBy("id", "species").agg(F.countDistinct("hash").alias("hashes"))
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect()))
    assert rows == [("r1", "A", 480), ("r1", "B", 20), ("r2", "B", 40)]


def test_fisher_by_pieces(spark):
    assert special.hypergeometric_p(3, 1, 1, 3, True) == pytest.approx(17 / 70)
    assert special.hypergeometric_p(3, 1, 1, 3, False) == pytest.approx(34 / 70)
    for greater in (True, False):
        assert special.hypergeometric_p(40, 60, 30, 90, greater, 7) == pytest.approx(special.hypergeometric_p(40, 60, 30, 90, greater), rel=1e-12)
    rows = spark.createDataFrame([(3, 1, 1, 3), (0, 0, 0, 0), (None, 1, 1, 1), (5, 0, 0, 5)], "a long, b long, c long, d long")
    got = {r.a: r.p for r in fu.fisher(rows, "two-sided").collect()}
    assert got == {3: pytest.approx(34 / 70), 0: pytest.approx(1.0), None: None, 5: pytest.approx(2 / 252)}
    assert "Window" not in fu.fisher(rows)._jdf.queryExecution().executedPlan().toString()
