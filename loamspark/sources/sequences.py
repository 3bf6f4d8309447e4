"""FASTA and FASTQ, read by Spark's text reader (compressed files too) and written as text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``id, description, sequence, file`` of every record.

    A record begins with '>' at the start of a line, wherever else the sign stands, so files are split between records. Lines may end with CRLF.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"), F.col("_metadata.file_path").alias("file")).where(F.col("value").rlike(r"\S"))
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), head.alias("description"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")).alias("sequence"), "file")


def fasta_directory(spark: SparkSession, path: str) -> DataFrame:
    """``species, marker, sequence`` of files named Species_MARKER.fa."""
    rows = fasta(spark, path).withColumn("name", F.regexp_extract("file", r"([^/]+)\.fa(?:sta)?(?:\.gz)?$", 1))
    return rows.select(F.regexp_extract("name", r"^(.*)_[^_]+$", 1).alias("species"), F.regexp_extract("name", r"_([^_]+)$", 1).alias("marker"), "sequence")


def whole_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``file, sequence``: all sequence lines of each file as one sequence, headers left out; a file is one row, for genomes and amplicons of one file each."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.select("file", F.upper(F.regexp_replace(F.regexp_replace("value", r"(?m)^>.*$", ""), r"\s", "")).alias("sequence"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, line``: the lines of every file, empty ones too, with their numbers from 0.

    Files are read in blocks; a block's lines are numbered as they are read, and begin at the count of the lines in the blocks before it.
    """
    at = F.monotonically_increasing_id()
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines")).select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("n"), "line")


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of lines in order, each as long as its sequence says; one that its file cuts short is left out."""
    name, bases, quality, file = None, [], None, None
    for batch in batches:
        out = []
        for here, line in zip(batch["file"], batch["line"]):
            if here != file:
                file, name = here, None
            if name is None:
                if line.startswith("@"):
                    name, bases, quality = line[1:].split(None, 1)[0] if line[1:].strip() else "", [], None
                continue
            if quality is None:
                if not line.startswith("+"):
                    bases.append(line)
                    continue
                quality = ""
            else:
                quality += line
            whole = "".join(bases)
            if len(quality) >= len(whole):
                out.append((name, whole, quality))
                name = None
        yield pd.DataFrame(out, columns=["read_id", "sequence", "quality"])


def fastq(spark: SparkSession, path: str, wrapped: bool = False) -> DataFrame:
    """``read_id, sequence, quality`` of every record; a read may be empty.

    Records have four lines, so a file is read in blocks. ``wrapped`` takes records whose sequence and quality go over several lines: where one ends follows only
    from those before it, so the lines of a file pass one task in their order, without ever being held as a whole.
    """
    lines = _lines(spark, path)
    if wrapped:
        return lines.repartition("file").sortWithinPartitions("file", "n").mapInPandas(_records, "read_id string, sequence string, quality string")
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("line")))
    records = lines.groupBy("file", F.floor(F.col("n") / 4).alias("r")).agg(part(0).alias("head"), part(1).alias("sequence"), part(3).alias("quality")).where(F.startswith("head", F.lit("@")))
    return records.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("read_id"), F.coalesce("sequence", F.lit("")).alias("sequence"), F.coalesce("quality", F.lit("")).alias("quality"))


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    quality = F.coalesce("quality", F.repeat(F.lit("I"), F.length("sequence"))) if "quality" in reads.columns else F.repeat(F.lit("I"), F.length("sequence"))
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "sequence", F.lit("+"), quality).alias("value")).write.option("compression", compression).text(path)
