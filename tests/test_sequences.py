"""Sequence files as they are found: signs in headers, empty reads, wrapped records, CRLF, compression, blocks smaller than a record."""

from __future__ import annotations

import gzip

import pytest

from loamspark.sources import sequences as sq


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fasta_headers_with_the_sign(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 A>G variant\nacgt\nAC\n>r2\n\n>r3 x\r\nTT\r\nGG\r\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">r4\nAAAA")
    got = rows(sq.fasta(spark, f"{tmp_path}/*.fa*"), "id", "description", "sequence")
    assert got == [("r1", "r1 A>G variant", "ACGTAC"), ("r2", "r2", ""), ("r3", "r3 x", "TTGG"), ("r4", "r4", "AAAA")]


def test_whole_sequences(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">one\nac\n>two > three\ngt\r\n")
    assert [r["sequence"] for r in sq.whole_sequences(spark, f"{tmp_path}/g.fa").collect()] == ["ACGT"]


RECORDS = [(f"r{i}", "ACGT" * (i % 7), "@+#I" * (i % 7)) for i in range(400)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_blocks_and_empty_reads(spark, tmp_path, end):
    (tmp_path / "a.fq").write_bytes("".join(f"@{n} more{end}{s}{end}+{end}{q}{end}" for n, s, q in RECORDS).encode())
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@last\nAC\n+last\nII")
    expected = sorted([*RECORDS, ("last", "AC", "II")])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        for wrapped in (False, True):
            assert rows(sq.fastq(spark, str(tmp_path), wrapped), "read_id", "sequence", "quality") == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq_wrapped(spark, tmp_path):
    (tmp_path / "w.fq").write_text("@a x\nACG\nT\n+\n@II\nI\n\n@b\n\n+\n\n@c\nA\n+c\n+\n@cut\nACGT\n+\nII\n")
    assert rows(sq.fastq(spark, f"{tmp_path}/w.fq", wrapped=True), "read_id", "sequence", "quality") == [("a", "ACGT", "@III"), ("b", "", ""), ("c", "A", "+")]
