"""Tab-separated tables with dynamic columns, and small JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = ["domain", "phylum", "class", "order", "family", "genus", "species"]


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def abundance(spark: SparkSession, path: str) -> DataFrame:
    """A wide table, first column the feature, the others samples, as long rows; blank features are skipped."""
    wide = _tsv(spark, path)
    first, *samples = wide.columns
    wide = wide.where(F.trim(F.coalesce(F.col(f"`{first}`"), F.lit(""))) != "")
    if not samples:
        return wide.select(F.col(f"`{first}`").alias("feature_id"), F.lit(None).cast("string").alias("sample_id"), F.lit(None).cast("double").alias("value")).limit(0)
    long = wide.unpivot([F.col(f"`{first}`")], [F.col(f"`{s}`") for s in samples], "sample_id", "value")
    return long.select(F.col(f"`{first}`").alias("feature_id"), "sample_id", F.col("value").cast("double").alias("value"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``feature_id`` and the seven ranks, missing ones ''; the id column is MAG_ID or mag_id."""
    rows = _tsv(spark, path)
    key = next(c for c in ("MAG_ID", "mag_id", rows.columns[0]) if c in rows.columns)
    rows = rows.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
    return rows.select(F.col(key).alias("feature_id"), *[(F.coalesce(F.trim(F.col(f"`{r}`")), F.lit("")) if r in rows.columns else F.lit("")).alias(r) for r in RANKS])


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path).where(F.trim(F.coalesce(F.col("sample_id"), F.lit(""))) != "")


def genome_id(gene: Column) -> Column:
    """The genome of a gene id: contig and gene numbers cut off, then dots as underscores."""
    return F.replace(F.trim(F.regexp_replace(F.regexp_replace(gene, r"_k\d+_\d+$", ""), r"_\d+$", "")), F.lit("."), F.lit("_"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """``gene_id, feature_id, ko_id, kegg_hit, cazy_id, pfam_id`` of a gene table; blanks are null, the genome is the column fasta or comes from the gene."""
    rows = _tsv(spark, path)
    first = rows.columns[0]
    gene = next((c for c in ("gene_id", first) if c in rows.columns), first)
    pick = lambda *names: next((F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in rows.columns), F.lit(None).cast("string"))
    genome = F.replace(F.trim(F.col("fasta")), F.lit("."), F.lit("_")) if "fasta" in rows.columns else genome_id(F.col(f"`{gene}`"))
    return rows.select(F.col(f"`{gene}`").alias("gene_id"), genome.alias("feature_id"), pick("ko_id", "kegg_id").alias("ko_id"), pick("kegg_hit").alias("kegg_hit"), pick("cazy_hits", "cazy_id").alias("cazy_id"), pick("pfam_hits", "pfam_id").alias("pfam_id"))


def spike_ins(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="sample_id string, species_idx int, marker_idx int, true_w double, obs_reads double")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", "version string, url string, sha256 string, size long").alias("m")).select("m.*")


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """``d_mu, d_sigma, b_mu, b_sigma`` as ``sinks.calibration`` wrote them."""
    return spark.read.schema("d_mu double, d_sigma double, b_mu double, b_sigma double").json(path)


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A benchmark's table by its schema, in the header's order; no rows where there is no file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    kinds = spark.createDataFrame([], schema).schema
    rows = _tsv(spark, path)
    return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def check_shape(table: DataFrame, features: int, samples: int) -> DataFrame:
    """The table, if it has so many features and samples; else ValueError."""
    found = table.agg(F.count_distinct("feature_id").alias("f"), F.count_distinct("sample_id").alias("s")).first()
    if (found["f"], found["s"]) != (features, samples):
        raise ValueError(f"{found['f']} features and {found['s']} samples, not {features} and {samples}")
    return table
