"""Function tables ``(function_id, feature_id, value)`` from gene annotations, and what groups make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.functions import special
from loamspark.functions.frames import sql
from loamspark.operators import composition, differential

# Marker genes of plant-growth promotion and their orthologues.
PGPR_MARKERS = {
    "nifH": "K02588", "nifD": "K02586", "nifK": "K02591", "pqqC": "K06137", "gcd": "K00111", "acdS": "K01505", "ipdC": "K04103",
    "acsA": "K14187", "budB": "K01652", "entA": "K02361", "entB": "K01252", "entC": "K02362", "phzF": "K18000",
}
# Classes of carbohydrate-active enzymes.
CAZY_CLASSES = ("GH", "GT", "PL", "CE", "AA", "CBM")


def markers(spark, pairs: dict[str, str] = PGPR_MARKERS) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), "trait string, ko_id string")


def ko_table(genes: DataFrame) -> DataFrame:
    """Presence of every orthologue in every genome."""
    return sql("SELECT DISTINCT ko_id AS function_id, feature_id, 1D AS value FROM {g} WHERE ko_id IS NOT NULL", g=genes)


def cazy_table(genes: DataFrame) -> DataFrame:
    """Genes of every family in every genome; the whole annotation is the key."""
    return sql("SELECT cazy_id AS function_id, feature_id, cast(count(*) AS DOUBLE) AS value FROM {g} WHERE cazy_id IS NOT NULL GROUP BY ALL", g=genes)


def trait_table(genes: DataFrame, traits: DataFrame) -> DataFrame:
    """Presence of every trait's marker in every annotated genome; absent ones are kept as 0."""
    return sql(
        """WITH h AS (SELECT DISTINCT t.trait, g.feature_id FROM {g} g JOIN {t} t ON t.ko_id = g.ko_id)
           SELECT t.trait AS function_id, f.feature_id, CASE WHEN h.trait IS NULL THEN 0D ELSE 1D END AS value
           FROM {t} t CROSS JOIN (SELECT DISTINCT feature_id FROM {g}) f LEFT JOIN h ON h.trait = t.trait AND h.feature_id = f.feature_id""",
        g=genes, t=traits,
    )


def all_tables(genes: DataFrame, traits: DataFrame) -> DataFrame:
    """The three tables in one scan of the genes, told apart by ``function_type``."""
    return sql(
        """WITH x AS (SELECT g.feature_id, e.kind, e.id FROM {g} g LATERAL VIEW explode(array(named_struct('kind', 'ko', 'id', g.ko_id), named_struct('kind', 'cazy', 'id', g.cazy_id))) AS e WHERE e.id IS NOT NULL),
                c AS (SELECT kind, id, feature_id, count(*) AS n FROM x GROUP BY ALL)
           SELECT kind AS function_type, id AS function_id, feature_id, CASE WHEN kind = 'ko' THEN 1D ELSE cast(n AS DOUBLE) END AS value FROM c
           UNION ALL SELECT 'pgpr', t.trait, c.feature_id, 1D FROM c JOIN {t} t ON t.ko_id = c.id WHERE c.kind = 'ko'""",
        g=genes, t=traits,
    )


def build(kind: str, genes: DataFrame, traits: DataFrame | None = None) -> DataFrame:
    if kind == "ko":
        return ko_table(genes)
    if kind == "cazy":
        return cazy_table(genes)
    if kind == "pgpr":
        return trait_table(genes, traits if traits is not None else markers(genes.sparkSession))
    raise ValueError(f"no such function table: {kind}")


def cazyme_summary(table: DataFrame) -> DataFrame:
    """Genes, families and genomes of every known class."""
    known = table.withColumn("cls", F.regexp_extract("function_id", "^[A-Z]+", 0)).where(F.col("cls").isin(*CAZY_CLASSES) & (F.col("value") > 0))
    return known.groupBy("cls").agg(F.sum("value").alias("genes"), F.count_distinct("function_id").alias("families"), F.count_distinct("feature_id").alias("genomes"))


def project(functions: DataFrame, table: DataFrame) -> DataFrame:
    """Function by sample: the sum of function values times abundances over shared features; every function with every sample."""
    return sql(
        """WITH p AS (SELECT f.function_id, t.sample_id, sum(f.value * t.value) AS v FROM {f} f JOIN {t} t ON t.feature_id = f.feature_id GROUP BY ALL)
           SELECT f.function_id AS feature_id, s.sample_id, coalesce(p.v, 0D) AS value
           FROM (SELECT DISTINCT function_id FROM {f}) f CROSS JOIN (SELECT DISTINCT sample_id FROM {t}) s LEFT JOIN p ON p.function_id = f.function_id AND p.sample_id = s.sample_id""",
        f=functions, t=table,
    )


def differential_pathway(functions: DataFrame, table: DataFrame, meta: DataFrame, group1: str, group2: str) -> DataFrame:
    return differential.differential(project(functions, table), meta, group1, group2)


def redundancy(functions: DataFrame, stats: DataFrame) -> DataFrame:
    """Carriers of every function, and in every group the Shannon index of their mean abundances; 0 with one carrier at most."""
    return sql(
        """WITH c AS (SELECT function_id, feature_id FROM {f} WHERE value > 0),
                n AS (SELECT function_id, count(*) AS carriers FROM c GROUP BY function_id),
                a AS (SELECT c.function_id, s.grp, sum(s.mean_value) AS t, coalesce(sum(s.mean_value * ln(s.mean_value)) FILTER (WHERE s.mean_value > 0), 0D) AS x FROM c JOIN {s} s ON s.feature_id = c.feature_id GROUP BY ALL)
           SELECT n.function_id, g.grp, n.carriers, CASE WHEN n.carriers > 1 AND a.t > 0 THEN ln(a.t) - a.x / a.t ELSE 0D END AS shannon
           FROM n CROSS JOIN (SELECT DISTINCT grp FROM {s}) g LEFT JOIN a ON a.function_id = n.function_id AND a.grp = g.grp""",
        f=functions, s=stats,
    )


def redundancy_comparison(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean and population deviation of the Shannon index by group, and Mann-Whitney's U of every two groups."""
    summary = rows.groupBy("grp").agg(F.avg("shannon").alias("mean_shannon"), F.stddev_pop("shannon").alias("sd_shannon"))
    return summary, differential.mann_whitney(rows.select("grp", F.col("shannon").alias("value")))


def first_carriers(traits: DataFrame, order: DataFrame, n: int = 30) -> DataFrame:
    """``feature_id, position`` of the first ``n`` features with any trait, in the input's order ``(feature_id, position)``."""
    carriers = traits.where(F.col("value") > 0).select("feature_id").distinct()
    return order.join(carriers, "feature_id", "left_semi").orderBy("position", "feature_id").limit(n).select("feature_id", "position")


def trait_counts(traits: DataFrame, stats: DataFrame) -> DataFrame:
    """Carriers of every trait in every group, each genome in the group of its highest mean; the others of the group beside them."""
    home = composition.argmax(stats, "feature_id", "mean_value", "grp")
    return sql(
        """WITH h AS (SELECT h.feature_id, h.grp FROM {h} h LEFT SEMI JOIN {t} t ON t.feature_id = h.feature_id),
                n AS (SELECT g.grp, count(h.feature_id) AS n FROM (SELECT DISTINCT grp FROM {s}) g LEFT JOIN h ON h.grp = g.grp GROUP BY g.grp),
                c AS (SELECT t.function_id, h.grp, count(*) AS c FROM {t} t JOIN h ON h.feature_id = t.feature_id WHERE t.value > 0 GROUP BY ALL)
           SELECT f.function_id AS trait, n.grp, coalesce(c.c, 0) AS carriers, n.n - coalesce(c.c, 0) AS others
           FROM (SELECT DISTINCT function_id FROM {t}) f CROSS JOIN n LEFT JOIN c ON c.function_id = f.function_id AND c.grp = n.grp""",
        t=traits, h=home, s=stats,
    )


def trait_chi2(counts: DataFrame) -> DataFrame:
    """The chi-squared statistic of every trait's carriers by group; null where an expected count is 0."""
    return sql(
        """WITH k AS (SELECT *, sum(carriers) OVER (PARTITION BY trait) AS c, sum(carriers + others) OVER (PARTITION BY trait) AS n, carriers + others AS g FROM {c})
           SELECT trait, CASE WHEN min(c * g) > 0 AND min((n - c) * g) > 0 THEN sum(try_divide(pow(carriers - try_divide(c * g, n), 2), try_divide(c * g, n)) + try_divide(pow(others - try_divide((n - c) * g, n), 2), try_divide((n - c) * g, n))) END AS chi2, count(*) - 1 AS df FROM k GROUP BY trait""",
        c=counts,
    )


def trait_enrichment(counts: DataFrame) -> DataFrame:
    """p of the chi-squared test (two groups: Fisher's, two-sided), 1 where there is none, and q."""
    if counts.select("grp").distinct().count() == 2:
        wide = sql(
            """SELECT trait, max(carriers) FILTER (WHERE r = 1) AS a, max(carriers) FILTER (WHERE r = 2) AS b, max(others) FILTER (WHERE r = 1) AS c, max(others) FILTER (WHERE r = 2) AS d
               FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY grp) AS r FROM {c}) GROUP BY trait""",
            c=counts,
        )
        return composition.benjamini_hochberg(fisher(wide, "two-sided"))
    return composition.benjamini_hochberg(trait_chi2(counts).withColumn("p", F.coalesce(special.chi2_p(F.col("chi2"), F.col("df")), F.lit(1.0))))


def fisher(tables: DataFrame, alternative: str = "greater") -> DataFrame:
    """``p`` of the 2x2 tables in columns a, b, c, d (a b over c d), from the hypergeometric distribution: counts of a or more, or (two-sided) all that are not likelier."""
    return tables.withColumn("p", special.fisher_p(*(F.col(c).cast("long") for c in "abcd"), alternative == "greater"))


def keystone_traits(keystones: DataFrame, traits: DataFrame) -> DataFrame:
    """The 2x2 table of keystones (``feature_id, is_keystone``) with any trait, and Fisher's p that they are enriched."""
    table = sql(
        """SELECT count_if(is_keystone AND w) AS a, count_if(is_keystone AND NOT w) AS b, count_if(NOT is_keystone AND w) AS c, count_if(NOT is_keystone AND NOT w) AS d
           FROM (SELECT k.is_keystone, h.feature_id IS NOT NULL AS w FROM {k} k LEFT JOIN (SELECT DISTINCT feature_id FROM {t} WHERE value > 0) h ON h.feature_id = k.feature_id)""",
        k=keystones, t=traits,
    )
    return fisher(table)
