"""The supplied tables read as abundances, metadata, annotations, sequences and candidates, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.functions import dna
from loamspark.functions.frames import sql

#: The same views for DuckDB, put before an oracle's query as needed.
VIEWS = {
    "ab": "SELECT l_suppkey AS sample_id, p_brand AS feature_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "tiny": "SELECT s_nationkey AS sample_id, p_brand AS feature_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "sp": "SELECT l_suppkey AS sample_id, l_partkey AS feature_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "meta": "SELECT s_suppkey AS sample_id, r_name AS grp, CASE WHEN s_acctbal < 3000 THEN 'low' ELSE 'high' END AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "tmeta": "SELECT n_nationkey AS sample_id, r_name AS grp, 'b' || (n_nationkey % 3) AS block FROM nation JOIN region ON n_regionkey = r_regionkey",
    "tax": "SELECT p_partkey AS feature_id, p_brand AS genus, p_type AS phylum FROM part",
    "genes": "SELECT l_orderkey * 10 + l_linenumber AS gene_id, l_partkey AS feature_id, 'K' || l_suppkey AS ko_id, CASE WHEN l_returnflag = 'R' THEN ['GH','GT','PL','CE','AA','CBM','XX'][p_size % 7 + 1] || p_size END AS cazy_id FROM lineitem JOIN part ON l_partkey = p_partkey",
    "traits": "SELECT 't' || i AS trait, 'K' || (i * 3) AS ko_id FROM (SELECT unnest(range(1, 14)) AS i)",
    "cand": "SELECT read_id, marker, species, max(c) AS containment FROM (SELECT l_orderkey * 10 + l_linenumber AS read_id, l_linenumber % 3 AS marker, l_partkey % 6 AS species, 0.95 - l_tax AS c FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_linenumber % 3, (l_suppkey * l_suppkey) % 6, 0.5 + l_discount FROM lineitem) GROUP BY ALL",
    "dist": "SELECT a.sample_id AS s1, b.sample_id AS s2, sum(abs(a.value - b.value)) / sum(a.value + b.value) AS d FROM dense a JOIN dense b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY ALL",
    "dense": "SELECT f.feature_id, s.sample_id, coalesce(t.value, 0.0) AS value FROM (SELECT DISTINCT feature_id FROM tiny) f CROSS JOIN (SELECT DISTINCT sample_id FROM tiny) s LEFT JOIN tiny t ON t.feature_id = f.feature_id AND t.sample_id = s.sample_id",
    "dab": "SELECT f.feature_id, s.sample_id, coalesce(t.value, 0.0) AS value FROM (SELECT DISTINCT feature_id FROM ab) f CROSS JOIN (SELECT DISTINCT sample_id FROM ab) s LEFT JOIN ab t ON t.feature_id = f.feature_id AND t.sample_id = s.sample_id",
    "dsp": "SELECT f.feature_id, s.sample_id, coalesce(t.value, 0.0) AS value FROM (SELECT DISTINCT feature_id FROM sp) f CROSS JOIN (SELECT DISTINCT sample_id FROM sp) s LEFT JOIN sp t ON t.feature_id = f.feature_id AND t.sample_id = s.sample_id",
    "phi": "SELECT a.feature_id AS src, b.feature_id AS dst, var_samp(ln(a.value + 1) - ln(b.value + 1)) AS phi FROM dense a JOIN dense b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id GROUP BY ALL",
    "net": "SELECT * FROM phi WHERE phi <= (SELECT quantile_cont(phi, 0.2) FROM phi)",
    "mods": "SELECT DISTINCT feature_id, length(feature_id) * 2 + ascii(right(feature_id, 1)) % 2 AS module FROM tiny",
    "seqs": "SELECT doc_id AS id, source AS species, translate(upper(regexp_replace(lower(text), '[^a-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS sequence FROM documents",
    "reads": "SELECT item_id AS id, translate(upper(regexp_replace(lower(text), '[^a-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS sequence FROM benchmark",
    "truth": "SELECT s.s_suppkey AS id, s.s_nationkey AS experiment, abs(s.s_acctbal) / 10000 AS true_w, q / 3000 AS est_w FROM supplier s JOIN (SELECT l_suppkey, avg(l_extendedprice) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s.s_suppkey",
}
_HASH = "md5('\\x2A\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB || encode(least(x, reverse(translate(x, 'ACGT', 'TGCA')))))"
_HEX = " || ".join(f"substr(h, {i}, 2)" for i in range(15, 0, -2))
for _t, _k in (("seqs", 21), ("reads", 21)):
    VIEWS[f"{_t}_k"] = f"SELECT id, pos, {_HEX} AS hash FROM (SELECT id, pos, {_HASH} AS h FROM (SELECT id, pos, substr(sequence, CAST(pos + 1 AS INTEGER), {_k}) AS x FROM (SELECT id, sequence, unnest(range(0, greatest(length(sequence) - {_k - 1}, 0))) AS pos FROM {_t})))"
NEEDS = {"dense": ["tiny"], "dab": ["ab"], "dsp": ["sp"], "dist": ["dense"], "phi": ["dense"], "net": ["phi"], "mods": ["tiny"], "seqs_k": ["seqs"], "reads_k": ["reads"]}


def views(*names: str) -> str:
    """WITH clause of the named views and those below them."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in names}


def ab(spark: SparkSession, d: str) -> DataFrame:
    """Samples are suppliers, features are brands."""
    return sql("SELECT l_suppkey AS sample_id, p_brand AS feature_id, sum(l_quantity) AS value FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY ALL", **_tables(spark, d, "lineitem", "part"))


def tiny(spark: SparkSession, d: str) -> DataFrame:
    """Samples are nations, features are brands."""
    return sql("SELECT s_nationkey AS sample_id, p_brand AS feature_id, sum(l_quantity) AS value FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY ALL", **_tables(spark, d, "lineitem", "part", "supplier"))


def sp(spark: SparkSession, d: str) -> DataFrame:
    """Samples are suppliers, features are parts: sparse."""
    return sql("SELECT l_suppkey AS sample_id, l_partkey AS feature_id, sum(l_quantity) AS value FROM {lineitem} GROUP BY ALL", **_tables(spark, d, "lineitem"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The rows that ``sp`` sums."""
    return table(spark, d, "lineitem").selectExpr("l_suppkey AS sample_id", "l_partkey AS feature_id", "l_quantity AS value")


def meta(spark: SparkSession, d: str) -> DataFrame:
    return sql("SELECT s_suppkey AS sample_id, r_name AS grp, CASE WHEN s_acctbal < 3000 THEN 'low' ELSE 'high' END AS balance FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey", **_tables(spark, d, "supplier", "nation", "region"))


def tmeta(spark: SparkSession, d: str) -> DataFrame:
    return sql("SELECT n_nationkey AS sample_id, r_name AS grp, concat('b', n_nationkey % 3) AS block FROM {nation} JOIN {region} ON n_regionkey = r_regionkey", **_tables(spark, d, "nation", "region"))


def tax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("genus"), F.col("p_type").alias("phylum"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    return sql(
        """SELECT l_orderkey * 10 + l_linenumber AS gene_id, l_partkey AS feature_id, concat('K', l_suppkey) AS ko_id,
                  CASE WHEN l_returnflag = 'R' THEN concat(element_at(array('GH','GT','PL','CE','AA','CBM','XX'), p_size % 7 + 1), p_size) END AS cazy_id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
        **_tables(spark, d, "lineitem", "part"),
    )


def traits(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 14).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("trait"), F.concat(F.lit("K"), (F.col("id") * 3).cast("string")).alias("ko_id"))


def cand(spark: SparkSession, d: str) -> DataFrame:
    """Both candidates of each line. They are dealt by read at once, so that grouping them by read later moves none again."""
    return sql(
        """SELECT read_id, marker, species, max(c) AS containment FROM (SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS read_id, l_linenumber % 3 AS marker, l_partkey % 6 AS species, 0.95D - l_tax AS c FROM {lineitem}
           UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_linenumber % 3, (l_suppkey * l_suppkey) % 6, 0.5D + l_discount FROM {lineitem}) DISTRIBUTE BY read_id) GROUP BY ALL""",
        **_tables(spark, d, "lineitem"),
    )


def mods(spark: SparkSession, d: str) -> DataFrame:
    return tiny(spark, d).select("feature_id").distinct().selectExpr("feature_id", "length(feature_id) * 2 + ascii(right(feature_id, 1)) % 2 AS module")


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("species"), dna.projected(F.col("text")).alias("sequence"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), dna.projected(F.col("text")).alias("sequence"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return sql("SELECT s.s_suppkey AS id, s.s_nationkey AS experiment, abs(s.s_acctbal) / 10000 AS true_w, q / 3000 AS est_w FROM {supplier} s JOIN (SELECT l_suppkey, avg(l_extendedprice) AS q FROM {lineitem} GROUP BY 1) ON l_suppkey = s.s_suppkey", **_tables(spark, d, "supplier", "lineitem"))
