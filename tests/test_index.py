"""A saved index answers like the tables that it was saved from, alone and after more strains are added."""

from __future__ import annotations

import random

import pytest

from loamspark.operators import differential as di
from loamspark.operators import kmers as km


def test_saved_index(spark, tmp_path):
    rng = random.Random(3)
    genomes = {i: "".join(rng.choice("ACGT") for _ in range(700)) for i in range(4)}
    seqs = spark.createDataFrame([(i, s + s[:60] * (i == 0)) for i, s in genomes.items()], "id int, sequence string")
    strains = spark.createDataFrame([(i, f"s{i // 2}") for i in genomes], "id int, species string")
    genes = spark.createDataFrame([(i, f"g{g}", g * 200, g * 200 + 150) for i in genomes for g in range(3)], "id int, gene string, start int, end int")
    reads = spark.createDataFrame([(100 + i, s[20:120]) for i, s in genomes.items()] + [(200, "A" * 80), (201, "ACG"), (202, None)], "id int, sequence string")
    table, looked = km.hashes(seqs, 15).cache(), km.hashes(reads, 15).cache()
    plain = km.genes_at(table, genes).select("id", "hash", "gene")
    expected = {tuple(r) for r in km.classify(looked, strains, km.coarse_index(strains, table, 0.5), plain, 0.5).collect()}
    assert {(100 + i, i, 1.0, "g0", f"s{i // 2}") for i in genomes} <= expected and not {r[0] for r in expected} & {200, 201, 202}
    path = str(tmp_path / "index")
    first = table.where("id < 3")
    km.save_index(strains, first, genes, 0.5, path)
    assert {tuple(r) for r in km.classify(looked, strains, *km.load_index(spark, path)).collect()} == {r for r in expected if r[1] < 3}
    km.add_to_index(strains, table.where("id = 3"), genes, path)
    coarse, fine, scale = km.load_index(spark, path)
    assert {tuple(r) for r in km.classify(looked, strains, coarse, fine, scale, folder=str(tmp_path)).collect()} == expected
    assert coarse.count() == coarse.distinct().count() and {r[0] for r in km.load_index(spark, path, ["s1"])[1].select("species").distinct().collect()} == {"s1"}

    # The same add again is refused, and so is a second index; neither changes what is read.
    for again in (lambda: km.add_to_index(strains, table.where("id = 3"), genes, path), lambda: km.save_index(strains, first, genes, 0.5, path), lambda: km._commit(spark, path, {"version": 2})):
        with pytest.raises((ValueError, FileExistsError)):
            again()
    assert km.load_index(spark, path)[1].count() == fine.count() and scale == 0.5
    plan = km.load_index(spark, path, ["s1"])[1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [species" in plan.replace("isnotnull(species#", "species#") or "species" in plan.split("PartitionFilters:")[1].split("]")[0]
    with pytest.raises(FileNotFoundError):
        km.load_index(spark, str(tmp_path / "none"))


def test_significance(spark):
    rows = spark.createDataFrame([(1, 0.01, 2.0), (2, 0.01, -2.0), (3, 0.01, 0.5), (4, 0.2, 3.0), (5, None, 3.0), (6, 0.01, None)], "id int, q double, lfc double")
    assert [r["class"] for r in di.significance(rows).orderBy("id").collect()] == ["up", "down", "NS", "NS", "NS", "NS"]
