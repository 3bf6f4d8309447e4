"""The corpus pipeline: toxic and poor documents go, one document of each near-duplicate group stays, the rest is packed.

Each stage works on all rows its predecessor kept and returns the columns of documents, but for the last, which returns the pieces of the packed
sequences with their ids. Null and empty texts hold no toxic passage, are as good as all labelled documents are on average, and have no near duplicates;
of rows that repeat an id and its text one stays; other columns pass, whatever their names; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm import minhash_dedup, packing, quality_knn, toxicity
from loamspark.llm.queries import learnable
from loamspark.llm.shared import discard, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7 by the segment model of ``labels.toxic``.

    Texts without a word, null ones too, stay. Repeated rows and rows without id are judged by their text like any; other columns pass unread.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels.where(learnable(3, 1))))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more by the neighbours' votes from ``labels.quality``; ties in the last place all vote.

    Null and empty texts score the share of all labels, so they stay or go together. Repeated rows and rows without id are judged by their text like any; other columns pass unread.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_knn.keep_good(docs, quality_knn.fit(docs, labels.where(learnable(5, 0))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more (op5 takes 0.85).

    The smallest id of a group stays, of several texts under that id the one of the smallest hash. Texts without a word and rows without id are in no group and
    stay; of rows that repeat an id and its text one stays, chosen by a hash of its columns, so no order matters.
    """
    return minhash_dedup.keep_first(docs, 80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    A null or empty text packs its end id; repeated rows and rows without id are documents of their own; other columns are not read.
    """
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Models, signatures and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``, each written as Parquet in the shared folder and read again; a stage's table goes when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        result = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            discard(last)
        docs = last = result
    return docs
