"""Records of split files equal those of whole ones, wherever a split falls; a file is classified in one plan."""

from __future__ import annotations

import gzip
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamspark.operators import kmers as km
from loamspark.sources import fastq_files as ff
from loamspark.sources import sequences as sq


def text(n: int, width: int, end: str = "\n", seed: int = 1) -> str:
    """Wrapped records whose quality lines begin with '@' and '+' more often than not."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.randint(0, 4 * width)
        bases, quality = "".join(rng.choice("ACGTN") for _ in range(size)), "".join("@+"[rng.random() < 0.5] if j % width == 0 else rng.choice("@+IJAC#") for j in range(size))
        cut = lambda s: [s[j : j + width] for j in range(0, max(len(s), 1), width)]
        out += [f"@r{i} more", *cut(bases), "+" + f"r{i}" * (i % 2), *cut(quality)]
    return end.join(out) + end


def whole(data: bytes) -> list:
    return list(ff.records(ff.lines_from(pa.BufferReader(data), 0)))


@pytest.mark.parametrize("width,end", [(7, "\n"), (20, "\r\n"), (500, "\n")])
def test_a_split_at_every_byte(width, end):
    data = text(24 if width < 100 else 6, width, end).encode()
    expected = whole(data)
    assert len(expected) in (6, 24)
    file = pa.BufferReader(data)
    for start in range(len(data)):
        following = next((r[0] for r in expected if r[0] >= start), None)
        for context in (0, 40, len(data)):
            assert ff.first_record(file, start, context) == following, (start, context)


def test_splits_of_a_folder(spark, tmp_path):
    (tmp_path / "a.fq").write_text(text(300, 11))
    (tmp_path / "b.fastq").write_text(text(50, 60, "\r\n", 2) + "@cut\nACGT\n+\nII")
    (tmp_path / "empty.fq").write_text("")
    (tmp_path / "_SUCCESS").write_text("x")
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write(text(40, 9, seed=3))
    expected = sorted((r.read_id, r.sequence, r.quality) for r in sq.fastq(spark, f"{tmp_path}/*.f*q*", wrapped=True).collect())
    for size in (700, 1 << 20):
        got = ff.read_fastq(spark, str(tmp_path), size, 500)
        assert sorted((r.read_id, r.sequence, r.quality) for r in got.collect()) == expected and len(expected) == 390
    assert got.where("file like '%a.fq'").agg(F.countDistinct("at")).first()[0] == 300
    with pytest.raises(FileNotFoundError):
        ff.read_fastq(spark, f"{tmp_path}/none*")


def test_classify_file(spark, tmp_path):
    rng = random.Random(5)
    genomes = {name: "".join(rng.choice("ACGT") for _ in range(3000)) for name in ("s1", "s2", "t1")}
    sequences = spark.createDataFrame(list(genomes.items()), "id string, sequence string")
    strains = spark.createDataFrame([("s1", "S"), ("s2", "S"), ("t1", "T")], "id string, species string")
    genes = spark.createDataFrame([("s1", 0, 1500, "left"), ("s1", 1500, 3000, "right")], "id string, start int, end int, gene string")
    km.save_index(strains, km.hashes(sequences, 21), genes, 0.2, f"{tmp_path}/index")
    reads = [(f"{n}-{i}", g[i : i + 150]) for n, g in genomes.items() for i in range(0, 2800, 400)] + [("short", genomes["s1"][:40]), ("twice", genomes["s2"][:120]), ("twice", genomes["t1"][:120]), ("odd", "ACGT" * 40)]
    with open(tmp_path / "reads.fq", "w") as f:
        for n, s in reads:
            f.write(f"@{n} x\n{s[:70]}\n{s[70:]}\n+\n{'@' * len(s[:70])}\n{'I' * len(s[70:])}\n")
    hits, summary = km.classify_file(spark, f"{tmp_path}/reads.fq", f"{tmp_path}/index", strains, 21, split_bytes=1000)
    got = {(r.id.split("@")[0], r.strain): r for r in hits.collect()}
    assert {k for k in got if k[0] not in ("twice",)} == {(n, n.split("-")[0]) for n, s in reads if "-" in n}
    assert {k[1] for k in got if k[0] == "twice"} == {"s2", "t1"}
    assert all(abs(r.containment - 1) < 1e-12 for r in got.values())
    assert got["s1-0", "s1"].gene == "left" and got["s1-2000", "s1"].gene == "right" and got["t1-0", "t1"].gene is None and got["t1-0", "t1"].species == "T"
    row = summary.first()
    assert (row.total, row.classified, row.too_short) == (len(reads), len(reads) - 2, 1)
