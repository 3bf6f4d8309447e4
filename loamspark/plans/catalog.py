"""Queries of the library's own operators over the supplied tables, with DuckDB SQL that states each result anew.

The SQL is written from the definitions, over dense tables where the operators are sparse, so the two agree only if both are right.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.functions import dna
from loamspark.operators import composition as co
from loamspark.operators import differential as di
from loamspark.operators import distances as ds
from loamspark.operators import evaluation as ev
from loamspark.operators import functional as fu
from loamspark.operators import kmers as km
from loamspark.operators import mixture as mx
from loamspark.operators import network as nw
from loamspark.operators import ordination as od
from loamspark.operators import simulate as si
from loamspark.plans import fixtures as fx
from loamspark.plans.fixtures import views
from loamspark.session import saved, table_folder
from loamspark.sources.tabular import genome_id

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select([(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) if kind == "double" or kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes])


def query(name: str, oracle: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Registers a query; its doubles, and the named ones of the SQL, are rounded to six places."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda s, d: rounded(f(s, d))
        if oracle:
            cols = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0 AS {c}" for c in doubles.split())
            ORACLE_SQL[name] = f"SELECT * {f'REPLACE ({cols})' if cols else ''} FROM (\n{oracle}\n)"
        return f

    return add


# Filters and projections

query("fil_01_normalize", f"{views('ab')} SELECT feature_id, sample_id, value / sum(value) OVER (PARTITION BY sample_id) AS p FROM ab", "p")(lambda s, d: co.normalize(fx.ab(s, d)))
query("fil_02_low_abundance", f"{views('sp')} SELECT * FROM sp WHERE feature_id IN (SELECT feature_id FROM sp GROUP BY 1 HAVING sum(value) > 800)", "value")(lambda s, d: co.filter_low_abundance(fx.sp(s, d), 800.0))
query("fil_03_prevalence", f"{views('sp')} SELECT * FROM sp WHERE feature_id IN (SELECT feature_id FROM sp WHERE value > 0 GROUP BY 1 HAVING count(*) >= 0.25 * (SELECT count(DISTINCT sample_id) FROM sp))", "value")(lambda s, d: co.filter_prevalence(fx.sp(s, d), 0.25))
query("fil_04_subset_samples", f"{views('tiny')} SELECT * FROM tiny WHERE sample_id IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)", "value")(
    lambda s, d: co.subset_samples(fx.tiny(s, d), [r[0] for r in fx.table(s, d, "supplier").where("s_acctbal > 9000").select("s_nationkey").distinct().collect()])
)
query("fil_05_groups", f"{views('meta')} SELECT grp, count(*) AS n, string_agg(CAST(sample_id AS VARCHAR), ';' ORDER BY CAST(sample_id AS VARCHAR)) AS samples FROM meta GROUP BY 1")(lambda s, d: co.sample_groups(fx.meta(s, d), "grp"))
query(
    "fil_16_genome_ids",
    "SELECT doc_id, replace(trim(regexp_replace(regexp_replace(source || '.k' || doc_id || '_k141_' || n_chars, '_k[0-9]+_[0-9]+$', ''), '_[0-9]+$', '')), '.', '_') AS genome FROM documents",
)(lambda s, d: fx.table(s, d, "documents").select("doc_id", genome_id(F.expr("concat(source, '.k', doc_id, '_k141_', n_chars)")).alias("genome")))
query("fil_07_min_length", f"{views('reads')} SELECT id, length(sequence) AS n FROM reads WHERE length(sequence) >= 50")(lambda s, d: km.long_enough(fx.reads(s, d), 50).select("id", F.length("sequence").cast("long").alias("n")))
query(
    "fil_12_significance",
    f"{views('truth')} SELECT id, CASE WHEN true_w < 0.5 AND est_w - 12 > 0.25 THEN 'up' WHEN true_w < 0.5 AND est_w - 12 < -0.25 THEN 'down' ELSE 'NS' END AS class FROM truth",
)(lambda s, d: di.significance(fx.truth(s, d).selectExpr("id", "true_w AS q", "est_w - 12 AS lfc"), 0.5, 0.25).select("id", "class"))

# Diversity and group aggregates

query(
    "agg_05_alpha_diversity",
    f"""{views('ab')}, p AS (SELECT sample_id, value / sum(value) OVER (PARTITION BY sample_id) AS p FROM ab WHERE value > 0)
SELECT sample_id, -sum(p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson, count(*) AS richness, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0.0 END AS evenness FROM p GROUP BY 1""",
    "shannon simpson evenness",
)(lambda s, d: co.alpha_diversity(fx.ab(s, d)))
query("agg_06_aggregate_rank", f"{views('sp', 'tax')} SELECT phylum AS feature_id, sample_id, sum(value) AS value FROM sp JOIN tax USING (feature_id) GROUP BY ALL", "value")(lambda s, d: co.aggregate_rank(fx.sp(s, d), fx.tax(s, d), "phylum"))
query("agg_07_rank_table", f"{views('sp', 'tax')} SELECT genus AS feature_id, sample_id, sum(value) AS value FROM sp JOIN tax USING (feature_id) GROUP BY ALL", "value")(lambda s, d: co.aggregate_rank(fx.sp(s, d), fx.tax(s, d), "genus"))
_STATS = f"{views('dsp', 'meta')}, stats AS (SELECT feature_id, grp, avg(value) AS mean_value, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS prevalence FROM dsp JOIN meta USING (sample_id) GROUP BY ALL)"
_STATS_AB = _STATS.replace("FROM dsp JOIN", "FROM dab JOIN").replace(views("dsp", "meta"), views("dab", "meta"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    return co.group_stats(fx.lines(s, d), fx.meta(s, d), repeated=True)


query("agg_08_group_means", f"{_STATS} SELECT feature_id, grp, mean_value FROM stats", "mean_value")(lambda s, d: _stats(s, d).select("feature_id", "grp", "mean_value"))
query("agg_09_group_prevalence", f"{_STATS} SELECT feature_id, grp, prevalence FROM stats", "prevalence")(lambda s, d: _stats(s, d).select("feature_id", "grp", F.col("prevalence").cast("double").alias("prevalence")))
_CORE = f"{_STATS}, core AS (SELECT t AS threshold, grp, feature_id FROM stats JOIN (SELECT unnest([0.2, 0.3, 0.4, 0.5]) AS t) ON prevalence >= t)"
query("agg_10_core_features", f"{_CORE} SELECT CAST(threshold AS DOUBLE) AS threshold, grp, feature_id FROM core", "threshold")(lambda s, d: co.core_features(_stats(s, d), (0.2, 0.3, 0.4, 0.5)))
query("set_01_shared_core", f"{_CORE} SELECT CAST(threshold AS DOUBLE) AS threshold, feature_id FROM core GROUP BY ALL HAVING count(DISTINCT grp) = (SELECT count(DISTINCT grp) FROM stats)", "threshold")(
    lambda s, d: co.shared_core(co.core_features(_stats(s, d), (0.2, 0.3, 0.4, 0.5)), fx.meta(s, d).select("grp").distinct().count())
)
query(
    "agg_11_phylum_composition",
    f"""{views('sp', 'tax', 'meta')}, x AS (SELECT phylum AS taxon, sample_id, sum(value) AS v FROM sp JOIN tax USING (feature_id) GROUP BY ALL), p AS (SELECT taxon, sample_id, v / sum(v) OVER (PARTITION BY sample_id) AS p FROM x),
g AS (SELECT t.taxon, s.sample_id, coalesce(p.p, 0.0) AS p FROM (SELECT DISTINCT taxon FROM p) t CROSS JOIN (SELECT DISTINCT sample_id FROM p) s LEFT JOIN p ON p.taxon = t.taxon AND p.sample_id = s.sample_id)
SELECT taxon, grp, avg(p) AS mean_share, stddev_pop(p) AS sd_share FROM g JOIN meta USING (sample_id) GROUP BY ALL""",
    "mean_share sd_share",
)(lambda s, d: co.phylum_composition(fx.sp(s, d), fx.tax(s, d), fx.meta(s, d)))
query("agg_12_taxonomy_breakdown", f"{views('tax')} SELECT phylum, count(*) AS n FROM tax GROUP BY 1")(lambda s, d: co.taxonomy_breakdown(fx.tax(s, d), "phylum"))
query("st_16_indicator", f"{_STATS}, x AS (SELECT *, mean_value / sum(mean_value) OVER (PARTITION BY feature_id) AS spec FROM stats) SELECT feature_id, grp AS best_group, spec AS specificity, prevalence AS fidelity, spec * prevalence AS indval FROM x QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY round(spec * prevalence, 9) DESC, grp) = 1", "specificity fidelity indval")(
    lambda s, d: co.indicator(_stats(s, d)).select("feature_id", "best_group", "specificity", F.col("fidelity").cast("double").alias("fidelity"), "indval")
)
_PERM = "own AS (SELECT sample_id, grp, row_number() OVER (ORDER BY sample_id) AS rn FROM {m}), dealt AS (SELECT perm, sample_id, row_number() OVER (PARTITION BY perm ORDER BY md5(perm || ':' || sample_id)) AS rn FROM {m} CROSS JOIN (SELECT unnest(range(1, {n})) AS perm)), perms AS (SELECT d.perm, d.sample_id, o.grp FROM dealt d JOIN own o USING (rn) UNION ALL SELECT 0, sample_id, grp FROM {m})"
query(
    "st_16_indicator_test",
    f"""{views('dab', 'meta')}, {_PERM.format(m='meta', n=20)}, m AS (SELECT perm, feature_id, grp, avg(value) AS v, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS f FROM dab JOIN perms USING (sample_id) GROUP BY ALL),
i AS (SELECT perm, feature_id, max(iv) AS iv FROM (SELECT perm, feature_id, v / sum(v) OVER (PARTITION BY perm, feature_id) * f AS iv FROM m) GROUP BY ALL)
SELECT o.feature_id, o.iv AS indval, (count(*) FILTER (WHERE i.perm > 0 AND i.iv >= o.iv - 1e-9) + 1) / 20.0 AS p FROM i JOIN (SELECT feature_id, iv FROM i WHERE perm = 0) o USING (feature_id) GROUP BY ALL""",
    "indval p",
)(lambda s, d: co.indicator_test(fx.ab(s, d), fx.meta(s, d), 19))
query(
    "st_17_specificity",
    f"""{_STATS_AB}, x AS (SELECT feature_id, grp, mean_value / sum(mean_value) OVER (PARTITION BY feature_id) AS p, count(*) OVER (PARTITION BY feature_id) AS c FROM stats)
SELECT feature_id, 1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(max(c)) AS score, arg_max(grp, p) AS best_group FROM x GROUP BY 1""",
    "score",
)(lambda s, d: co.specificity(co.group_stats(fx.ab(s, d), fx.meta(s, d))))
query("win_04_top_per_group", f"{_STATS} SELECT feature_id, grp, mean_value, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(mean_value, 6) DESC, feature_id) AS rn FROM stats) WHERE rn <= 10", "mean_value")(
    lambda s, d: co.top_n(_stats(s, d).select("feature_id", "grp", F.round("mean_value", 6).alias("mean_value")), 10, "grp", "mean_value DESC, feature_id")
)
query("srt_06_top_taxa", f"{views('ab')} SELECT feature_id, sum(value) AS total FROM ab GROUP BY 1 ORDER BY total DESC, feature_id LIMIT 10", "total")(lambda s, d: co.top_features(fx.ab(s, d), 10))
query("agg_44_group_membership", f"{_STATS} SELECT members, count(*) AS n FROM (SELECT feature_id, string_agg(grp, ';' ORDER BY grp) AS members FROM stats WHERE mean_value > 0 GROUP BY 1) GROUP BY 1")(
    lambda s, d: co.membership(_stats(s, d))
)
query(
    "agg_40_alpha_by_group",
    f"""{views('ab', 'meta')}, p AS (SELECT sample_id, value / sum(value) OVER (PARTITION BY sample_id) AS p FROM ab WHERE value > 0), a AS (SELECT sample_id, -sum(p * ln(p)) AS h, 1 - sum(p * p) AS s, count(*) AS r FROM p GROUP BY 1)
SELECT grp, count(*) AS n, avg(h) AS mean_shannon, avg(s) AS mean_simpson, avg(r) AS mean_richness, avg(CASE WHEN r > 1 THEN h / ln(r) ELSE 0.0 END) AS mean_evenness, median(h) AS median_shannon FROM a JOIN meta USING (sample_id) GROUP BY 1""",
    "mean_shannon mean_simpson mean_richness mean_evenness median_shannon",
)(lambda s, d: co.alpha_by_group(co.alpha_diversity(fx.ab(s, d)), fx.meta(s, d)))

# Tests between groups

query("st_03_clr", f"{views('dab')} SELECT feature_id, sample_id, ln(value + 1) - avg(ln(value + 1)) OVER (PARTITION BY sample_id) AS clr FROM dab", "clr")(lambda s, d: di.clr(fx.ab(s, d)))


def _welch(dense: str) -> str:
    return f"""z AS (SELECT feature_id, sample_id, ln(value + 1) - avg(ln(value + 1)) OVER (PARTITION BY sample_id) AS x FROM {dense}),
g AS (SELECT feature_id, avg(x) FILTER (WHERE grp = 'EUROPE') AS m1, avg(x) FILTER (WHERE grp = 'ASIA') AS m2, var_samp(x) FILTER (WHERE grp = 'EUROPE') AS v1, var_samp(x) FILTER (WHERE grp = 'ASIA') AS v2, count(*) FILTER (WHERE grp = 'EUROPE') AS n1, count(*) FILTER (WHERE grp = 'ASIA') AS n2 FROM z JOIN meta USING (sample_id) GROUP BY 1)
SELECT feature_id, m1 - m2 AS lfc, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS df, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS effect FROM g"""


query("st_05_differential", f"{views('dab', 'meta')}, {_welch('dab')}", "lfc t df effect")(lambda s, d: di.differential(fx.ab(s, d), fx.meta(s, d), "EUROPE", "ASIA"))
query("st_05_differential_test")(lambda s, d: di.differential_test(fx.sp(s, d), fx.meta(s, d), "EUROPE", "ASIA"))
_RANKED = "SELECT f.feature_id, s.sample_id, coalesce(t.value, 0.0) AS value FROM (SELECT DISTINCT feature_id FROM x) f CROSS JOIN (SELECT DISTINCT sample_id FROM x) s LEFT JOIN x t ON t.feature_id = f.feature_id AND t.sample_id = s.sample_id"
query("st_06_rank_differential", f"{views('sp', 'tax', 'meta')}, x AS (SELECT phylum AS feature_id, sample_id, sum(value) AS value FROM sp JOIN tax USING (feature_id) GROUP BY ALL), r AS ({_RANKED}), {_welch('r')}", "lfc t df effect")(
    lambda s, d: di.differential(co.aggregate_rank(fx.sp(s, d), fx.tax(s, d), "phylum"), fx.meta(s, d), "EUROPE", "ASIA")
)


def _kw(dense: str) -> str:
    return f"""r AS (SELECT feature_id, grp, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature_id, value) AS t, count(*) OVER (PARTITION BY feature_id) AS n FROM {dense} JOIN meta USING (sample_id)),
a AS (SELECT feature_id, grp, sum(r) AS s, count(*) AS c, max(n) AS n FROM r GROUP BY ALL), c AS (SELECT feature_id, 1 - sum(CAST(t AS DOUBLE) * t - 1) / (power(max(n), 3) - max(n)) AS c FROM r GROUP BY 1),
k AS (SELECT feature_id, (12.0 / (max(n) * (max(n) + 1.0)) * sum(s * s / a.c) - 3 * (max(n) + 1.0)) AS h FROM a GROUP BY 1)"""


query("st_12_kruskal_wallis", f"{views('dsp', 'meta')}, {_kw('dsp')} SELECT feature_id, h / c AS h, CAST((SELECT count(DISTINCT grp) FROM meta) - 1 AS BIGINT) AS df FROM k JOIN c USING (feature_id)", "h")(lambda s, d: di.kruskal_wallis(fx.sp(s, d), fx.meta(s, d)))
query(
    "win_01_kruskal_fdr",
    f"""{views('dab', 'meta')}, {_kw('dab')}, p AS (SELECT feature_id, round(exp(-h / c / 2) * (1 + h / c / 2), 9) AS p FROM k JOIN c USING (feature_id)), o AS (SELECT *, row_number() OVER (ORDER BY p, feature_id) AS rn, count(*) OVER () AS n FROM p)
SELECT feature_id, p, least(1.0, min(p * n / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM o""",
    "p q",
)(lambda s, d: di.kruskal_wallis_test(fx.ab(s, d), fx.meta(s, d)).select("feature_id", "p", "q"))
query(
    "st_21_mann_whitney",
    f"""{views('tmeta')}, v AS (SELECT grp, s_acctbal AS value FROM supplier JOIN tmeta ON sample_id = s_nationkey), pairs AS (SELECT DISTINCT a.grp AS g1, b.grp AS g2 FROM v a JOIN v b ON a.grp < b.grp)
SELECT g1, g2, sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END) AS u FROM pairs JOIN v a ON a.grp = g1 JOIN v b ON b.grp = g2 GROUP BY ALL""",
    "u",
)(lambda s, d: di.mann_whitney(fx.table(s, d, "supplier").join(fx.tmeta(s, d), F.col("sample_id") == F.col("s_nationkey")).select("grp", F.col("s_acctbal").alias("value"))).select("g1", "g2", "u"))

# Distances and permutation tests

query("st_01_bray_curtis", f"{views('dist')} SELECT * FROM dist", "d")(lambda s, d: ds.bray_curtis(fx.tiny(s, d)))
query("st_02_jaccard", f"{views('dsp')} SELECT a.sample_id AS s1, b.sample_id AS s2, 1 - sum(CASE WHEN a.value > 0 AND b.value > 0 THEN 1.0 ELSE 0 END) / sum(CASE WHEN a.value > 0 OR b.value > 0 THEN 1.0 ELSE 0 END) AS d FROM dsp a JOIN dsp b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY ALL", "d")(lambda s, d: ds.jaccard(fx.sp(s, d)))
_F = """w AS (SELECT p.perm, sum(CASE WHEN p.grp = q.grp THEN d * d / c.n ELSE 0 END) AS ssw, sum(d * d) AS dd FROM dist JOIN perms p ON p.sample_id = s1 JOIN perms q ON q.sample_id = s2 AND q.perm = p.perm JOIN (SELECT grp, count(*) AS n FROM tmeta GROUP BY 1) c ON c.grp = p.grp GROUP BY 1),
k AS (SELECT count(*) AS n, count(DISTINCT grp) AS g FROM tmeta), f AS (SELECT perm, 1 - ssw / (dd / n) AS r2, ((dd / n - ssw) / (g - 1)) / (ssw / (n - g)) AS f FROM w CROSS JOIN k)"""
query("st_10_permanova", f"{views('dist', 'tmeta')}, {_PERM.format(m='tmeta', n=100)}, {_F} SELECT max(o.f) AS f, max(o.r2) AS r2, (count(*) FILTER (WHERE f.perm > 0 AND f.f >= o.f - 1e-9) + 1) / 100.0 AS p FROM f CROSS JOIN (SELECT f, r2 FROM f WHERE perm = 0) o", "f r2 p")(lambda s, d: ds.permanova(ds.bray_curtis(fx.tiny(s, d)), fx.tmeta(s, d), 99))
query(
    "st_11_anosim",
    f"""{views('dist', 'tmeta')}, {_PERM.format(m='tmeta', n=100)}, k AS (SELECT s1, s2, rank() OVER (ORDER BY round(d, 12)) + (count(*) OVER (PARTITION BY round(d, 12)) - 1) / 2.0 AS r, count(*) OVER () AS m FROM dist),
x AS (SELECT p.perm, (avg(r) FILTER (WHERE p.grp <> q.grp) - avg(r) FILTER (WHERE p.grp = q.grp)) / (max(m) / 2.0) AS r FROM k JOIN perms p ON p.sample_id = s1 JOIN perms q ON q.sample_id = s2 AND q.perm = p.perm GROUP BY 1)
SELECT max(o.r) AS r, (count(*) FILTER (WHERE x.perm > 0 AND x.r >= o.r - 1e-9) + 1) / 100.0 AS p FROM x CROSS JOIN (SELECT r FROM x WHERE perm = 0) o""",
    "r p",
)(lambda s, d: ds.anosim(ds.bray_curtis(fx.tiny(s, d)), fx.tmeta(s, d), 99))
query(
    "st_14_pairwise_permanova",
    f"""{views('dist', 'tmeta')}, pairs AS (SELECT a.grp AS g1, b.grp AS g2 FROM (SELECT DISTINCT grp FROM tmeta) a JOIN (SELECT DISTINCT grp FROM tmeta) b ON a.grp < b.grp), m AS (SELECT g1, g2, sample_id, grp, row_number() OVER (PARTITION BY g1, g2 ORDER BY sample_id) AS rn FROM pairs JOIN tmeta ON grp = g1 OR grp = g2),
x AS (SELECT g1, g2, perm, sample_id, row_number() OVER (PARTITION BY g1, g2, perm ORDER BY md5(perm || ':' || sample_id)) AS rn FROM m CROSS JOIN (SELECT unnest(range(1, 20)) AS perm)), l AS (SELECT x.g1, x.g2, x.perm, x.sample_id, m.grp FROM x JOIN m USING (g1, g2, rn) UNION ALL SELECT g1, g2, 0, sample_id, grp FROM m),
c AS (SELECT g1, g2, grp, count(*) AS n FROM m GROUP BY ALL), w AS (SELECT a.g1, a.g2, a.perm, sum(d * d) AS dd, sum(CASE WHEN a.grp = b.grp THEN d * d / c.n ELSE 0 END) AS ssw FROM dist JOIN l a ON a.sample_id = s1 JOIN l b ON b.sample_id = s2 AND b.g1 = a.g1 AND b.g2 = a.g2 AND b.perm = a.perm JOIN c ON c.g1 = a.g1 AND c.g2 = a.g2 AND c.grp = a.grp GROUP BY ALL),
t AS (SELECT g1, g2, sum(n) AS n FROM c GROUP BY ALL), f AS (SELECT g1, g2, perm, (dd / n - ssw) / (ssw / (n - 2)) AS f, 1 - ssw / (dd / n) AS r2 FROM w JOIN t USING (g1, g2)), r AS (SELECT f.g1, f.g2, max(o.f) AS f, max(o.r2) AS r2, (count(*) FILTER (WHERE f.perm > 0 AND f.f >= o.f - 1e-9) + 1) / 20.0 AS p FROM f JOIN (SELECT g1, g2, f, r2 FROM f WHERE perm = 0) o ON o.g1 = f.g1 AND o.g2 = f.g2 GROUP BY f.g1, f.g2),
s AS (SELECT *, row_number() OVER (ORDER BY p, g1, g2) AS rn, count(*) OVER () AS m FROM r) SELECT g1, g2, f, r2, p, least(1.0, min(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM s""",
    "f r2 p q",
)(lambda s, d: ds.pairwise_permanova(ds.bray_curtis(fx.tiny(s, d)), fx.tmeta(s, d).select("sample_id", "grp"), 19))
query(
    "st_15_variance_partition",
    f"""{views('dist', 'tmeta')}, l AS (SELECT 'full' AS k, sample_id, grp || '|' || block AS g FROM tmeta UNION ALL SELECT 'grp', sample_id, block FROM tmeta UNION ALL SELECT 'block', sample_id, grp FROM tmeta), c AS (SELECT k, g, count(*) AS n FROM l GROUP BY ALL),
w AS (SELECT a.k, 1 - sum(CASE WHEN a.g = b.g THEN d * d / c.n ELSE 0 END) / (sum(d * d) / (SELECT count(*) FROM tmeta)) AS r2 FROM dist JOIN l a ON a.sample_id = s1 JOIN l b ON b.sample_id = s2 AND b.k = a.k JOIN c ON c.k = a.k AND c.g = a.g GROUP BY 1),
p AS (SELECT k AS component, greatest(0.0, (SELECT r2 FROM w WHERE k = 'full') - r2) AS fraction FROM w WHERE k <> 'full') SELECT * FROM p UNION ALL SELECT 'shared', greatest(0.0, (SELECT r2 FROM w WHERE k = 'full') - (SELECT sum(fraction) FROM p)) UNION ALL SELECT 'residual', 1 - r2 FROM w WHERE k = 'full'""",
    "fraction",
)(lambda s, d: ds.variance_partition(ds.bray_curtis(fx.tiny(s, d)), fx.tmeta(s, d), ["grp", "block"]))
query(
    "st_08_gower_centred",
    f"""{views('dist')}, x AS (SELECT s1 AS a, s2 AS b, -d * d / 2 AS e FROM dist UNION ALL SELECT s2, s1, -d * d / 2 FROM dist UNION ALL SELECT sample_id, sample_id, 0.0 FROM (SELECT DISTINCT sample_id FROM tiny))
SELECT a, b, e - avg(e) OVER (PARTITION BY a) - avg(e) OVER (PARTITION BY b) + avg(e) OVER () AS g FROM x""",
    "g",
)(lambda s, d: ds.gower_centred(ds.bray_curtis(fx.tiny(s, d))))

query("st_07_rarefaction")(lambda s, d: od.rarefaction(fx.ab(s, d), depths=8, draws=5))
query("st_07_expected_richness", f"{views('ab')}, t AS (SELECT sample_id, sum(value) AS t FROM ab GROUP BY 1) SELECT sample_id, sum(1 - power(1 - value / t, 100)) AS richness FROM ab JOIN t USING (sample_id) GROUP BY 1", "richness")(lambda s, d: od.expected_richness(fx.ab(s, d), 100))


def _axes_sql(axes: int = 3, squarings: int = 14) -> str:
    """The axes in SQL: powers of the centred matrix, shifted so that its largest eigenvalue leads, tend to the leading axis' projector; then that axis is taken out."""
    steps = ["""x AS (SELECT s1 AS a, s2 AS b, -d * d / 2 AS e FROM dist UNION ALL SELECT s2, s1, -d * d / 2 FROM dist UNION ALL SELECT sample_id, sample_id, 0.0 FROM (SELECT DISTINCT sample_id FROM tiny)),
g1 AS MATERIALIZED (SELECT a, b, e - avg(e) OVER (PARTITION BY a) - avg(e) OVER (PARTITION BY b) + avg(e) OVER () AS g FROM x)"""]
    for k in range(1, axes + 1):
        steps.append(f"q{k}_0 AS MATERIALIZED (SELECT a, b, g + CASE WHEN a = b THEN (SELECT max(r) FROM (SELECT sum(abs(g)) AS r FROM g{k} GROUP BY a)) ELSE 0 END AS m FROM g{k})")
        for i in range(squarings):
            steps.append(f"q{k}_{i + 1} AS MATERIALIZED (SELECT p.a, q.b, sum(p.m * q.m) / (SELECT sum(m * m) FROM q{k}_{i}) AS m FROM q{k}_{i} p JOIN q{k}_{i} q ON q.a = p.b GROUP BY ALL)")
        steps.append(f"l{k} AS MATERIALIZED (SELECT sum(g * m) AS l FROM g{k} JOIN q{k}_{squarings} USING (a, b))")
        steps.append(f"v{k} AS MATERIALIZED (SELECT a AS sample_id, {k} AS axis, m / sqrt(d) * sqrt(l) AS value, l FROM q{k}_{squarings} JOIN (SELECT a AS top, m AS d FROM q{k}_{squarings} WHERE a = b ORDER BY m DESC LIMIT 1) ON b = top CROSS JOIN l{k})")
        steps.append(f"g{k + 1} AS MATERIALIZED (SELECT a, b, g - l * m AS g FROM g{k} JOIN q{k}_{squarings} USING (a, b) CROSS JOIN l{k})")
    return f"{views('dist', 'tmeta')}, {', '.join(steps)}"


query("st_08_axes", f"{_axes_sql()} {' UNION ALL '.join(f'SELECT sample_id, axis, value FROM v{k}' for k in (1, 2, 3))}", "value")(lambda s, d: od.pcoa(ds.bray_curtis(fx.tiny(s, d)), 3).select("sample_id", "axis", "value"))
query(
    "st_13_dispersion",
    f"""{_axes_sql(2)}, p AS (SELECT sample_id, grp, v1.value AS x, v2.value AS y FROM v1 JOIN v2 USING (sample_id) JOIN tmeta USING (sample_id)), c AS (SELECT grp, avg(x) AS x, avg(y) AS y FROM p GROUP BY 1),
z AS (SELECT grp, sqrt(power(p.x - c.x, 2) + power(p.y - c.y, 2)) AS z FROM p JOIN c USING (grp)), a AS (SELECT grp, count(*) AS n, avg(z) AS m FROM z GROUP BY 1),
t AS (SELECT (SELECT sum(n * power(m - (SELECT avg(z) FROM z), 2)) FROM a) / ((SELECT count(*) FROM a) - 1) AS between_, (SELECT sum(power(z - m, 2)) FROM z JOIN a USING (grp)) / ((SELECT count(*) FROM z) - (SELECT count(*) FROM a)) AS within) SELECT between_ / within AS f FROM t""",
    "f",
)(lambda s, d: od.permdisp(ds.bray_curtis(fx.tiny(s, d)), fx.tmeta(s, d).select("sample_id", "grp"), 9).select("f"))
query("st_08_pcoa")(lambda s, d: od.pcoa(ds.bray_curtis(fx.tiny(s, d)), 3))
query("st_09_nmds")(lambda s, d: od.nmds(ds.bray_curtis(fx.tiny(s, d)), 2))
query("st_13_permdisp")(lambda s, d: od.permdisp(ds.bray_curtis(fx.tiny(s, d)), fx.tmeta(s, d).select("sample_id", "grp"), 99))

# Functions

query("agg_13_ko_presence", f"{views('genes')} SELECT DISTINCT ko_id AS function_id, feature_id, 1.0 AS value FROM genes", "value")(lambda s, d: fu.build("ko", fx.genes(s, d)))
query("agg_14_cazy_counts", f"{views('genes')} SELECT cazy_id AS function_id, feature_id, CAST(count(*) AS DOUBLE) AS value FROM genes WHERE cazy_id IS NOT NULL GROUP BY ALL", "value")(lambda s, d: fu.build("cazy", fx.genes(s, d)))
_TRAIT = "tr AS (SELECT t.trait AS function_id, f.feature_id, CASE WHEN EXISTS (SELECT 1 FROM genes g WHERE g.ko_id = t.ko_id AND g.feature_id = f.feature_id) THEN 1.0 ELSE 0.0 END AS value FROM traits t CROSS JOIN (SELECT DISTINCT feature_id FROM genes) f)"
query("agg_15_traits", f"{views('genes', 'traits')}, {_TRAIT} SELECT * FROM tr", "value")(lambda s, d: fu.build("pgpr", fx.genes(s, d), fx.traits(s, d)))
query(
    "agg_16_all_tables",
    f"""{views('genes', 'traits')} SELECT DISTINCT 'ko' AS function_type, ko_id AS function_id, feature_id, 1.0 AS value FROM genes UNION ALL SELECT 'cazy', cazy_id, feature_id, count(*) FROM genes WHERE cazy_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT DISTINCT 'pgpr', trait, feature_id, 1.0 FROM genes JOIN traits USING (ko_id)""",
    "value",
)(lambda s, d: fu.all_tables(fx.genes(s, d), fx.traits(s, d)))
query("agg_17_cazyme_summary", f"{views('genes')}, c AS (SELECT cazy_id, feature_id, regexp_extract(cazy_id, '^[A-Z]+') AS cls, count(*) AS n FROM genes WHERE cazy_id IS NOT NULL GROUP BY ALL) SELECT cls, CAST(sum(n) AS DOUBLE) AS genes, count(DISTINCT cazy_id) AS families, count(DISTINCT feature_id) AS genomes FROM c WHERE cls <> 'XX' GROUP BY 1", "genes")(lambda s, d: fu.cazyme_summary(fu.cazy_table(fx.genes(s, d))))
_PROJ = "pj AS (SELECT c.cazy_id AS feature_id, sp.sample_id, sum(c.n * sp.value) AS value FROM (SELECT cazy_id, feature_id, count(*) AS n FROM genes WHERE cazy_id IS NOT NULL GROUP BY ALL) c JOIN sp USING (feature_id) GROUP BY ALL), dpj AS (SELECT f.feature_id, s.sample_id, coalesce(p.value, 0.0) AS value FROM (SELECT DISTINCT cazy_id AS feature_id FROM genes WHERE cazy_id IS NOT NULL) f CROSS JOIN (SELECT DISTINCT sample_id FROM sp) s LEFT JOIN pj p ON p.feature_id = f.feature_id AND p.sample_id = s.sample_id)"
query("jn_03_projection", f"{views('genes', 'sp')}, {_PROJ} SELECT * FROM dpj", "value")(lambda s, d: fu.project(fu.cazy_table(fx.genes(s, d)), fx.sp(s, d)))
query("st_18_differential_pathway", f"{views('genes', 'sp', 'meta')}, {_PROJ}, {_welch('dpj')}", "lfc t df effect")(lambda s, d: fu.differential_pathway(fu.cazy_table(fx.genes(s, d)), fx.sp(s, d), fx.meta(s, d), "EUROPE", "ASIA"))
_RED = f"""{views('dsp', 'meta', 'genes')}, st AS (SELECT feature_id, grp, avg(value) AS v FROM dsp JOIN meta USING (sample_id) GROUP BY ALL), ca AS (SELECT DISTINCT cazy_id AS function_id, feature_id FROM genes WHERE cazy_id IS NOT NULL), n AS (SELECT function_id, count(*) AS carriers FROM ca GROUP BY 1),
x AS (SELECT function_id, grp, v / sum(v) OVER (PARTITION BY function_id, grp) AS p FROM ca JOIN st USING (feature_id)), red AS (SELECT x.function_id, grp, max(carriers) AS carriers, CASE WHEN max(carriers) > 1 THEN -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) ELSE 0.0 END AS shannon FROM x JOIN n USING (function_id) GROUP BY ALL)"""
query("agg_18_redundancy", f"{_RED} SELECT function_id, grp, carriers, coalesce(shannon, 0.0) AS shannon FROM red", "shannon")(lambda s, d: fu.redundancy(fu.cazy_table(fx.genes(s, d)), _stats(s, d)))
query("agg_20_redundancy_summary", f"{_RED} SELECT grp, avg(coalesce(shannon, 0.0)) AS mean_shannon, stddev_pop(coalesce(shannon, 0.0)) AS sd_shannon FROM red GROUP BY 1", "mean_shannon sd_shannon")(lambda s, d: fu.redundancy_comparison(fu.redundancy(fu.cazy_table(fx.genes(s, d)), _stats(s, d)))[0])
_COUNTS = f"""{views('dsp', 'meta', 'genes', 'traits')}, {_TRAIT}, st AS (SELECT feature_id, grp, avg(value) AS v FROM dsp JOIN meta USING (sample_id) GROUP BY ALL), home AS (SELECT feature_id, grp FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY v DESC, grp) AS rn FROM st) WHERE rn = 1 AND feature_id IN (SELECT feature_id FROM genes)),
cn AS (SELECT function_id AS trait, grp, CAST(sum(value) AS BIGINT) AS carriers, CAST(count(*) - sum(value) AS BIGINT) AS others FROM tr JOIN home USING (feature_id) GROUP BY ALL)"""


def _counts(s: SparkSession, d: str) -> DataFrame:
    return fu.trait_counts(fu.trait_table(fx.genes(s, d), fx.traits(s, d)), _stats(s, d))


query("agg_19_trait_counts", f"{_COUNTS} SELECT * FROM cn")(_counts)
query(
    "st_19_trait_chi2",
    f"""{_COUNTS}, k AS (SELECT *, sum(carriers) OVER (PARTITION BY trait) AS c, sum(carriers + others) OVER (PARTITION BY trait) AS n, carriers + others AS g FROM cn)
SELECT trait, sum(power(carriers - c * g / n, 2) / (c * g / n) + power(others - (n - c) * g / n, 2) / ((n - c) * g / n)) AS chi2 FROM (SELECT trait, grp, CAST(carriers AS DOUBLE) AS carriers, CAST(others AS DOUBLE) AS others, CAST(c AS DOUBLE) AS c, CAST(n AS DOUBLE) AS n, CAST(g AS DOUBLE) AS g FROM k) GROUP BY 1""",
    "chi2",
)(lambda s, d: fu.trait_chi2(_counts(s, d)).select("trait", F.col("chi2").cast("double").alias("chi2")))
# Two groups: Fisher's two-sided p from log-gammas, and q.
query(
    "st_19_trait_fisher",
    f"""{_COUNTS.replace("JOIN meta USING (sample_id)", "JOIN (SELECT sample_id, balance AS grp FROM meta) USING (sample_id)")}, w AS (SELECT trait, max(carriers) FILTER (WHERE grp = 'high') AS a, max(carriers) FILTER (WHERE grp = 'low') AS b, max(others) FILTER (WHERE grp = 'high') AS c, max(others) FILTER (WHERE grp = 'low') AS d FROM cn GROUP BY 1),
k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM w),
h AS (SELECT trait, a, k, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) AS h FROM k),
p AS (SELECT trait, least(1.0, sum(h) FILTER (WHERE h <= own * (1 + 1e-7))) AS p FROM (SELECT *, max(h) FILTER (WHERE k = a) OVER (PARTITION BY trait) AS own FROM h) GROUP BY 1),
r AS (SELECT trait, p, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS e FROM p)
SELECT trait, p, least(1.0, min(e) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r""",
    "p q",
)(lambda s, d: fu.trait_enrichment(fu.trait_counts(fu.trait_table(fx.genes(s, d), fx.traits(s, d)), co.group_stats(fx.lines(s, d), fx.meta(s, d).selectExpr("sample_id", "balance AS grp"), repeated=True))).select("trait", "p", "q"))
query(
    "st_20_fisher_greater",
    """WITH t AS (SELECT count(*) FILTER (WHERE k AND w) AS a, count(*) FILTER (WHERE k AND NOT w) AS b, count(*) FILTER (WHERE NOT k AND w) AS c, count(*) FILTER (WHERE NOT k AND NOT w) AS d FROM (SELECT p_retailprice > 1500 AS k, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3) AS w FROM part))
SELECT a, b, c, d, (SELECT sum(exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1))) FROM (SELECT unnest(range(0, 100000)) AS k) WHERE k >= a AND k <= least(a + b, a + c)) AS p FROM t""",
    "p",
)(
    lambda s, d: fu.keystone_traits(
        fx.table(s, d, "part").select(F.col("p_partkey").alias("feature_id"), (F.col("p_retailprice") > 1500).alias("is_keystone")),
        fx.table(s, d, "lineitem").where("l_suppkey = 3").select(F.col("l_partkey").alias("feature_id"), F.lit(1.0).alias("value")),
    )
)

# Networks


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return nw.phi(fx.tiny(s, d))


def _net(s: SparkSession, d: str) -> DataFrame:
    return nw.network(_pairs(s, d), 20.0)


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return fx.tiny(s, d).select("feature_id").distinct()


query("gr_01_phi", f"{views('phi')} SELECT * FROM phi", "phi")(_pairs)
query("gr_02_network", f"{views('net')} SELECT * FROM net", "phi")(_net)
query("gr_03_network_at", f"{views('phi')} SELECT * FROM phi WHERE phi <= 0.5", "phi")(lambda s, d: nw.network_at(_pairs(s, d), 0.5))
query("gr_04_sensitivity", f"{views('phi')}, t AS (SELECT p / 1.0 AS percentile, (SELECT quantile_cont(phi, 0.05) FROM phi) AS a FROM (SELECT unnest(range(1, 21)) AS p)) SELECT percentile, x.lim AS \"limit\", count(*) AS edges FROM (" + " UNION ALL ".join(f"SELECT {p}.0 AS percentile, quantile_cont(phi, {p / 100}) AS lim FROM phi" for p in range(1, 21)) + ") x JOIN phi ON phi <= x.lim GROUP BY ALL", 'percentile "limit"')(lambda s, d: nw.sensitivity(_pairs(s, d)))
query("gr_05_degrees", f"{views('net')}, e AS (SELECT src AS n FROM net UNION ALL SELECT dst FROM net) SELECT f.feature_id, count(e.n) AS degree, count(e.n) / ((SELECT count(DISTINCT feature_id) FROM tiny) - 1.0) AS degree_centrality FROM (SELECT DISTINCT feature_id FROM tiny) f LEFT JOIN e ON e.n = f.feature_id GROUP BY 1", "degree_centrality")(
    lambda s, d: nw.degrees(_nodes(s, d), _net(s, d)).withColumn("degree_centrality", F.col("degree_centrality").cast("double"))
)
query("agg_45_network_summary", f"{views('net')} SELECT n, n * (n - 1) / 2.0 AS possible, e AS edges, e / (n * (n - 1) / 2.0) AS density FROM (SELECT count(DISTINCT feature_id) AS n FROM tiny) CROSS JOIN (SELECT count(*) AS e FROM net)", "possible density")(
    lambda s, d: nw.summary(_nodes(s, d), _net(s, d)).withColumns({"possible": F.col("possible").cast("double"), "density": F.col("density").cast("double")})
)


def _walks(levels: int = 12) -> str:
    """CTEs of the network's walks by length, and of its shortest paths: f(s, v, d, ways)."""
    steps = ["e AS MATERIALIZED (SELECT src AS v, dst AS u FROM net UNION SELECT dst, src FROM net)", "n AS (SELECT DISTINCT feature_id AS v FROM tiny)", "w0 AS (SELECT v AS s, v, 1.0::DOUBLE AS ways FROM n)"]
    steps += [f"w{i + 1} AS MATERIALIZED (SELECT w.s, e.u AS v, sum(w.ways) AS ways FROM w{i} w JOIN e ON e.v = w.v GROUP BY ALL)" for i in range(levels)]
    steps.append("f AS MATERIALIZED (SELECT s, v, min(d) AS d, arg_min(ways, d) AS ways FROM (" + " UNION ALL ".join(f"SELECT s, v, {i} AS d, ways FROM w{i}" for i in range(levels + 1)) + ") GROUP BY s, v)")
    return f"{views('net')}, {', '.join(steps)}"


query(
    "gr_06_betweenness",
    f"""{_walks()}, b AS (SELECT a.v, sum(a.ways * c.ways / f.ways) AS b FROM f a JOIN f c ON c.s = a.v JOIN f ON f.s = a.s AND f.v = c.v AND f.d = a.d + c.d WHERE a.s <> a.v AND c.v <> a.v AND a.s <> c.v GROUP BY a.v)
SELECT v AS feature_id, coalesce(b, 0) / (((SELECT count(*) FROM n) - 1.0) * ((SELECT count(*) FROM n) - 2.0)) AS betweenness FROM n LEFT JOIN b USING (v)""",
    "betweenness",
)(lambda s, d: nw.shortest_paths(_nodes(s, d), _net(s, d)).select("feature_id", "betweenness"))
query(
    "gr_07_closeness",
    f"""{_walks()} SELECT n.v AS feature_id, coalesce(sum(f.d > 0) / nullif(sum(f.d), 0) * sum(f.d > 0) / ((SELECT count(*) FROM n) - 1.0), 0) AS closeness FROM n LEFT JOIN f ON f.s = n.v GROUP BY n.v""",
    "closeness",
)(lambda s, d: nw.shortest_paths(_nodes(s, d), _net(s, d)).select("feature_id", "closeness"))
query("gr_06_topology")(lambda s, d: nw.topology(_nodes(s, d), _net(s, d)))
query(
    "gr_08_modularity_of_modules",
    f"""{views('net', 'mods')}, e AS (SELECT m.module AS x, n.module AS y, phi AS w FROM net JOIN mods m ON m.feature_id = src JOIN mods n ON n.feature_id = dst), t AS (SELECT sum(w) AS t FROM e), k AS (SELECT module, sum(w) AS d FROM (SELECT x AS module, w FROM e UNION ALL SELECT y, w FROM e) GROUP BY 1)
SELECT (SELECT sum(w) FROM e WHERE x = y) / t - (SELECT sum(power(d / (2 * t), 2)) FROM k) AS q FROM t""",
    "q",
)(lambda s, d: nw.modularity(_net(s, d), fx.mods(s, d)))
query(
    "gr_10_keystones",
    f"""{views('net')}, e AS (SELECT src AS n FROM net UNION ALL SELECT dst FROM net), b AS (SELECT f.feature_id, CAST(count(e.n) AS DOUBLE) AS b FROM (SELECT DISTINCT feature_id FROM tiny) f LEFT JOIN e ON e.n = f.feature_id GROUP BY 1), m AS (SELECT b.feature_id, b, a FROM b JOIN (SELECT feature_id, avg(value) AS a FROM dense GROUP BY 1) USING (feature_id))
SELECT feature_id, b AS betweenness, a AS mean_abundance, b / (SELECT max(b) FROM m) * (1 - a / (SELECT max(a) FROM m)) AS score, b >= (SELECT quantile_cont(b, 0.5) FROM m) AND a <= (SELECT quantile_cont(a, 0.5) FROM m) AS is_keystone FROM m""",
    "betweenness mean_abundance score",
)(lambda s, d: nw.keystones(nw.degrees(_nodes(s, d), _net(s, d)).select("feature_id", F.col("degree").cast("double").alias("betweenness")), fx.tiny(s, d)))
query("gr_10_keystones_by_betweenness")(lambda s, d: nw.keystones(nw.topology(_nodes(s, d), _net(s, d)), fx.tiny(s, d)))


def _group_phi(names: str) -> str:
    return f"SELECT a.feature_id AS src, b.feature_id AS dst, var_samp(ln(a.value + 1) - ln(b.value + 1)) AS phi FROM dense a JOIN dense b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id JOIN tmeta t ON t.sample_id = a.sample_id WHERE t.grp = '{names}' GROUP BY ALL"


def _group_net(s: SparkSession, d: str, name: str) -> DataFrame:
    return nw.network(nw.phi(fx.tiny(s, d).join(fx.tmeta(s, d).where(F.col("grp") == name), "sample_id", "left_semi")), 20.0)


query(
    "gr_11_compare_networks",
    f"""{views('dense', 'tmeta')}, a AS ({_group_phi('ASIA')}), b AS ({_group_phi('EUROPE')}), x AS (SELECT src, dst FROM a WHERE phi <= (SELECT quantile_cont(phi, 0.2) FROM a)), y AS (SELECT src, dst FROM b WHERE phi <= (SELECT quantile_cont(phi, 0.2) FROM b))
SELECT src, dst, 'conserved' AS status FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT src, dst, 'lost' FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT src, dst, 'gained' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""",
)(lambda s, d: nw.compare(_group_net(s, d, "ASIA"), _group_net(s, d, "EUROPE")))
query(
    "gr_12_roles",
    f"""{views('net', 'mods')}, e AS (SELECT src AS n, dst AS m FROM net UNION ALL SELECT dst, src FROM net), k AS (SELECT e.n, y.module AS near, count(*) AS k FROM e JOIN mods y ON y.feature_id = e.m GROUP BY ALL),
s AS (SELECT f.feature_id, f.module, coalesce(sum(k.k), 0) AS k, coalesce(sum(k.k) FILTER (WHERE k.near = f.module), 0) AS own, coalesce(sum(k.k * k.k), 0) AS sq FROM mods f LEFT JOIN k ON k.n = f.feature_id GROUP BY ALL),
w AS (SELECT *, avg(own) OVER (PARTITION BY module) AS mu, stddev_pop(own) OVER (PARTITION BY module) AS sd FROM s), r AS (SELECT feature_id, k, CASE WHEN sd > 1e-12 THEN (own - mu) / sd ELSE 0.0 END AS z, CASE WHEN k > 0 THEN 1 - sq / (k * k * 1.0) ELSE 0.0 END AS participation FROM w)
SELECT feature_id, z, participation, CASE WHEN k = 0 THEN 'peripheral' WHEN z >= 2.5 THEN 'hub' WHEN participation >= 0.62 THEN 'bridge' ELSE 'peripheral' END AS role FROM r""",
    "z participation",
)(lambda s, d: nw.roles(fx.mods(s, d), _net(s, d)))
query(
    "agg_21_module_composition",
    f"""{views('mods')}, t AS (SELECT 'Brand#' || CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR) AS feature_id, p_type AS phylum FROM part), c AS (SELECT module, coalesce(phylum, 'Unclassified') AS phylum, count(*) AS n FROM mods LEFT JOIN t USING (feature_id) GROUP BY ALL)
SELECT module, CAST(sum(n) OVER (PARTITION BY module) AS BIGINT) AS size, phylum AS dominant, n / CAST(sum(n) OVER (PARTITION BY module) AS DOUBLE) AS fraction FROM c QUALIFY row_number() OVER (PARTITION BY module ORDER BY n DESC, phylum) = 1""",
    "fraction",
)(lambda s, d: nw.module_composition(fx.mods(s, d), fx.table(s, d, "part").selectExpr("concat('Brand#', row_number() OVER (ORDER BY p_partkey)) AS feature_id", "p_type AS phylum")).withColumn("fraction", F.col("fraction").cast("double")))
query("gr_13_null_model")(lambda s, d: nw.null_summary(nw.null_model(_net(s, d), 20), nw.modularity(_net(s, d), nw.modules(_nodes(s, d), _net(s, d)).select("feature_id", "module"), None).first()["q"]))

# K-mers

K, SCALE = 21, 1 / 64


def _seqs_k(s: SparkSession, d: str, scale: float = 1.0) -> DataFrame:
    return km.hashes(fx.seqs(s, d), K, scale=scale)


def _reads_k(s: SparkSession, d: str) -> DataFrame:
    return km.hashes(fx.reads(s, d), K)


LIMIT = dna.below(SCALE)
query("km_01_kmers", f"{views('reads_k')} SELECT id, CAST(pos AS INTEGER) AS pos, hash FROM reads_k")(_reads_k)
query("km_06_sketch", f"{views('seqs_k')} SELECT DISTINCT id, hash FROM seqs_k WHERE hash < '{LIMIT}'")(lambda s, d: km.sketch(_seqs_k(s, d, SCALE), SCALE))
_SK = f"{views('seqs_k', 'reads_k')}, x AS (SELECT DISTINCT id, hash FROM reads_k WHERE hash < '{LIMIT}'), y AS (SELECT DISTINCT id, hash FROM seqs_k WHERE hash < '{LIMIT}')"
query("km_08_containment", f"{_SK} SELECT a, b, shared, shared / (SELECT count(*) FROM x WHERE id = a) AS containment, shared / ((SELECT count(*) FROM x WHERE id = a) + (SELECT count(*) FROM y WHERE id = b) - shared) AS jaccard FROM (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM x JOIN y USING (hash) GROUP BY ALL)", "containment jaccard")(
    lambda s, d: km.containment(km.sketch(_reads_k(s, d), SCALE), km.sketch(_seqs_k(s, d, SCALE), SCALE)).select("a", "b", "shared", F.col("containment").cast("double").alias("containment"), F.col("jaccard").cast("double").alias("jaccard"))
)
query("km_11_position_containment", f"{views('seqs_k', 'reads_k')}, o AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM reads_k a JOIN (SELECT DISTINCT id, hash FROM seqs_k) b USING (hash) GROUP BY ALL) SELECT a, b, shared, shared / (SELECT count(*) FROM reads_k WHERE id = a) AS containment FROM o", "containment")(
    lambda s, d: km.containment(_reads_k(s, d), _seqs_k(s, d), distinct=False, jaccard=False).select("a", "b", "shared", F.col("containment").cast("double").alias("containment"))
)
query("set_04_merged_sketch", f"{views('seqs_k')} SELECT DISTINCT hash FROM seqs_k WHERE hash < '{LIMIT}'")(lambda s, d: km.merge(km.sketch(_seqs_k(s, d, SCALE), SCALE)))
_COARSE = f"""{views('seqs_k', 'reads_k')}, ix AS (SELECT DISTINCT species, hash FROM seqs_k JOIN seqs USING (id) WHERE hash < '{LIMIT}'), h AS (SELECT DISTINCT id, hash FROM reads_k), u AS (SELECT * FROM h WHERE hash < '{LIMIT}' OR id NOT IN (SELECT id FROM h WHERE hash < '{LIMIT}')),
nu AS (SELECT id, count(*) AS n FROM u GROUP BY 1), s AS (SELECT u.id, species, count(*) / max(nu.n) AS containment FROM u JOIN ix USING (hash) JOIN nu ON nu.id = u.id GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY containment DESC, species) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY containment DESC, species) <= 3)"""


def _coarse(s: SparkSession, d: str) -> DataFrame:
    return km.coarse_index(fx.seqs(s, d).select("id", "species"), _seqs_k(s, d, SCALE), SCALE)


query("km_13_coarse_query", f"{_COARSE} SELECT id, species, containment, CAST(rank AS INTEGER) AS rank FROM best", "containment")(lambda s, d: km.coarse_query(_reads_k(s, d), _coarse(s, d), SCALE).withColumn("containment", F.col("containment").cast("double")))
_GENES = "gn AS (SELECT id, 'g' || i AS gene, i * 300 AS start_, i * 300 + 200 AS end_ FROM (SELECT id, unnest(range(0, CAST(floor(length(sequence) / 300.0) AS BIGINT) + 1)) AS i FROM seqs))"


def _genes(s: SparkSession, d: str) -> DataFrame:
    g = fx.seqs(s, d).selectExpr("id", "explode(sequence(0, cast(floor(length(sequence) / 300.0) AS INT))) AS i")
    return g.selectExpr("id", "concat('g', i) AS gene", "i * 300 AS start", "i * 300 + 200 AS `end`")


_FINE = f"{_GENES}, fi AS (SELECT k.id, k.hash, g.gene FROM seqs_k k LEFT JOIN gn g ON g.id = k.id AND g.start_ <= k.pos AND k.pos < g.end_)"
query("jn_13_genes_at", f"{views('seqs_k')}, {_FINE} SELECT gene, count(*) AS n FROM fi GROUP BY 1")(lambda s, d: km.genes_at(_seqs_k(s, d), _genes(s, d)).groupBy("gene").agg(F.count("*").alias("n")))
_HITS = """h2 AS (SELECT DISTINCT id, hash FROM reads_k), v AS (SELECT h2.id, f.id AS strain, f.gene, count(*) AS votes FROM h2 JOIN fi f USING (hash) GROUP BY ALL), top AS (SELECT id, strain, gene FROM v QUALIFY row_number() OVER (PARTITION BY id, strain ORDER BY votes DESC, gene IS NULL, gene) = 1),
n2 AS (SELECT id, count(*) AS n FROM h2 GROUP BY 1), dd AS (SELECT h2.id, f.strain, count(*) / max(n2.n) AS containment FROM h2 JOIN (SELECT DISTINCT id AS strain, hash FROM fi) f USING (hash) JOIN n2 ON n2.id = h2.id GROUP BY ALL), hits AS (SELECT dd.id, dd.strain, containment, gene FROM dd JOIN top USING (id, strain) WHERE containment >= 0.1)"""


def _fine(s: SparkSession, d: str, reads: DataFrame) -> DataFrame:
    """The part of the fine index that the reads' k-mers meet."""
    return km.genes_at(km.met(_seqs_k(s, d), reads), _genes(s, d)).select("id", "hash", "gene")


def _fine_hits(s: SparkSession, d: str) -> DataFrame:
    reads = saved(_reads_k(s, d), "reads")
    return km.fine_query(reads, _fine(s, d, reads)).withColumn("containment", F.col("containment").cast("double"))


query("km_16_fine_query", f"{views('seqs_k', 'reads_k')}, {_FINE}, {_HITS} SELECT * FROM hits", "containment")(_fine_hits)


def _classified(s: SparkSession, d: str) -> DataFrame:
    """Classification of reads that are all there: only the index rows that their k-mers meet are saved, not the references' whole index."""
    reads, strains = saved(_reads_k(s, d), "reads"), fx.seqs(s, d).select("id", "species")
    fine = saved(_fine(s, d, reads).join(strains, "id"), "fine")
    return km.classify(reads, strains, _coarse(s, d), fine, SCALE, folder=table_folder(s)).withColumn("containment", F.col("containment").cast("double"))


_CLASS = f"{_COARSE}, {_FINE}, {_HITS}, cl AS (SELECT hits.*, species FROM hits JOIN seqs ON seqs.id = hits.strain WHERE (hits.id, species) IN (SELECT id, species FROM best))"
query("km_17_classify", f"{_CLASS} SELECT * FROM cl", "containment")(_classified)
query(
    "agg_23_classification_summary",
    f"""{_CLASS}, r AS (SELECT reads.id, length(sequence) < 50 AS short, CASE WHEN length(sequence) < 50 THEN 0 ELSE (SELECT count(*) FROM cl WHERE cl.id = reads.id) END AS n FROM reads)
SELECT count(*) AS total, count(*) FILTER (WHERE n > 0) AS classified, count(*) FILTER (WHERE n = 0) AS unclassified, count(*) FILTER (WHERE short) AS too_short, coalesce(avg(n) FILTER (WHERE n > 0), 0.0) AS mean_candidates, count(*) FILTER (WHERE n > 0) / count(*) AS classified_fraction, count(*) FILTER (WHERE n = 0) / count(*) AS unclassified_fraction FROM r""",
    "mean_candidates classified_fraction unclassified_fraction",
)(lambda s, d: km.classification_summary(fx.reads(s, d), _classified(s, d)).withColumns({c: F.col(c).cast("double") for c in ("mean_candidates", "classified_fraction", "unclassified_fraction")}))

# Mixtures

S_ = "(SELECT DISTINCT species FROM cand)"


def _unrolled(steps: int) -> str:
    """The EM of a mixture for some steps from equal weights, as one chain of views."""
    out = [views("cand"), "p0 AS (SELECT s.species, m.marker, 1.0 / (SELECT count(DISTINCT species) FROM cand) AS w, CAST(1.0 AS DOUBLE) AS d, CAST(1.0 AS DOUBLE) AS b FROM (SELECT DISTINCT species FROM cand) s CROSS JOIN (SELECT DISTINCT marker FROM cand) m)"]
    for i in range(steps):
        out += [
            f"e{i} AS MATERIALIZED (SELECT read_id, marker, species, x / sum(x) OVER (PARTITION BY read_id) AS g, ln(sum(x) OVER (PARTITION BY read_id)) AS ll FROM (SELECT c.read_id, c.marker, c.species, p.w * p.d * p.b * c.containment AS x FROM cand c JOIN p{i} p USING (species, marker)))",
            f"n{i} AS (SELECT species, sum(g) AS g, greatest(sum(g) - 0.5, 1e-10) AS w FROM e{i} GROUP BY 1), w{i} AS (SELECT species, g, w / sum(w) OVER () AS w FROM n{i})",
            f"d{i} AS (SELECT w.species, w.w, exp(greatest(w.g, 1) * ln(w.g / x.den) / (greatest(w.g, 1) + 4)) AS d FROM w{i} w JOIN (SELECT e.species, sum(w.w * p.b) AS den FROM e{i} e JOIN w{i} w USING (species) JOIN p{i} p ON p.species = e.species AND p.marker = e.marker GROUP BY 1) x USING (species)), s{i} AS (SELECT species, w, d / exp(avg(ln(d)) OVER ()) AS d FROM d{i})",
            f"b{i} AS (SELECT p.species, p.marker, s.w, s.d, CASE WHEN x.g > 0 THEN exp(greatest(x.g, 1) * ln(x.g / (s.w * s.d * t.n)) / (greatest(x.g, 1) + 4)) ELSE 1.0 END AS b FROM p{i} p JOIN s{i} s USING (species) JOIN (SELECT marker, count(DISTINCT read_id) AS n FROM cand GROUP BY 1) t ON t.marker = p.marker LEFT JOIN (SELECT species, marker, sum(g) AS g FROM e{i} GROUP BY ALL) x ON x.species = p.species AND x.marker = p.marker)",
            f"p{i + 1} AS MATERIALIZED (SELECT species, marker, w, d, b / exp(avg(ln(b)) OVER (PARTITION BY species)) AS b FROM b{i})",
        ]
    return ",\n".join(out)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    """The candidates' profiles as a saved table: every step reads them, and a lost executor costs none of their making."""
    return saved(mx.profiles(fx.cand(s, d)), "candidates")


def _steps(s: SparkSession, d: str, n: int) -> tuple[DataFrame, DataFrame]:
    c = _candidates(s, d)
    return c, mx.fit(c, max_iter=n, tolerance=0.0, restarts=1)[0]


query("em_01_mixture_steps", f"{_unrolled(3)} SELECT species, marker, w, d, b FROM p3", "w d b")(lambda s, d: _steps(s, d, 3)[1])
_E2 = f"{_unrolled(2)}, g2 AS MATERIALIZED (SELECT read_id, marker, species, x, sum(x) OVER (PARTITION BY read_id) AS t, x / sum(x) OVER (PARTITION BY read_id) AS g, w FROM (SELECT c.read_id, c.marker, c.species, p.w * p.d * p.b * c.containment AS x, p.w FROM cand c JOIN p2 p USING (species, marker)))"
query("em_02_log_likelihood", f"{_E2} SELECT sum(ll) AS ll, count(*) AS reads FROM (SELECT read_id, ln(max(t)) AS ll FROM g2 GROUP BY 1)", "ll")(lambda s, d: mx.log_likelihood(mx.responsibilities(*_steps(s, d, 2))))
query("em_10_wald_intervals", f"{_E2} SELECT species, max(w) AS w, greatest(max(w) - 1.96 * sqrt(max(w) * (1 - max(w)) / (sum(g) + 1)), 0) AS lo, least(max(w) + 1.96 * sqrt(max(w) * (1 - max(w)) / (sum(g) + 1)), 1) AS hi FROM g2 GROUP BY 1", "w lo hi")(lambda s, d: (lambda c, p: mx.intervals(mx.responsibilities(c, p), p))(*_steps(s, d, 2)))
query(
    "em_11_observed_intervals",
    f"""{_E2}, r AS (SELECT DISTINCT read_id FROM cand), w AS (SELECT DISTINCT species, w FROM p2), a AS (SELECT w.species, w.w, coalesce(g.g, 0.0) AS g FROM w CROSS JOIN r LEFT JOIN g2 g ON g.species = w.species AND g.read_id = r.read_id),
i AS (SELECT species, max(w) AS w, greatest(sum(power(g / w - (1 - g) / (1 - w), 2) - g * (1 - g) * power(1 / w + 1 / (1 - w), 2)), 1e-10) AS i FROM a GROUP BY 1) SELECT species, w, greatest(w - 1.96 / sqrt(i), 0) AS lo, least(w + 1.96 / sqrt(i), 1) AS hi FROM i""",
    "w lo hi",
)(lambda s, d: (lambda c, p: mx.observed_intervals(mx.responsibilities(c, p), p))(*_steps(s, d, 2)))
query(
    "em_12_likelihood_ratio",
    f"""{_E2}, w AS (SELECT DISTINCT species, w FROM p2), l AS (SELECT read_id, max(t) AS t FROM g2 GROUP BY 1), n AS (SELECT w.species, l.read_id, ln(l.t) AS ll, (SELECT sum(x) FROM g2 z WHERE z.read_id = l.read_id AND z.species <> w.species) AS rest, w.w FROM w CROSS JOIN l)
SELECT species, greatest(2 * sum(ll - CASE WHEN rest > 0 THEN ln(rest / (1 - w)) ELSE -100 END), 0) AS lrt FROM n GROUP BY 1""",
    "lrt",
)(lambda s, d: mx.likelihood_ratio(*_steps(s, d, 2)))
query("em_01_mixture_fit")(lambda s, d: mx.fit(fx.cand(s, d))[0])
_OWN = re.sub(r"\bcand\b", "own", _unrolled(2).replace(views("cand") + ",\n", ""))
_REFIT = " UNION ALL ".join(f"SELECT {k} AS species, (WITH own AS MATERIALIZED (SELECT * FROM cand WHERE species <> {k}), {_OWN} SELECT sum(ll) FROM (SELECT ln(sum(p.w * p.d * p.b * c.containment)) AS ll FROM own c JOIN p2 p USING (species, marker) GROUP BY c.read_id)) AS ll" for k in range(6))
query(
    "em_13_refit_steps",
    f"{_E2}, a AS (SELECT sum(ll) AS ll FROM (SELECT read_id, ln(max(t)) AS ll FROM g2 GROUP BY 1)), r AS ({_REFIT}) SELECT species, greatest(2 * (a.ll - r.ll), 0) AS lrt FROM r CROSS JOIN a",
    "lrt",
)(lambda s, d: (lambda c, p: mx.refit_ratio(c, p, mx.log_likelihood(mx.responsibilities(c, p)).first()["ll"], 2, 0.0))(*_steps(s, d, 2)))


def _refits(s: SparkSession, d: str) -> DataFrame:
    c = _candidates(s, d)
    params, ll, _ = mx.fit(c)
    return mx.ratio_p(mx.refit_ratio(c, params, ll))


query("em_13_refit_ratio")(_refits)
_HIT = "hit AS (SELECT read_id, marker, species FROM cand WHERE containment >= 0.7)"
query("agg_24_report_counts", f"{views('cand')}, {_HIT} SELECT species, count(*) AS reads, 100.0 * count(*) / (SELECT count(DISTINCT read_id) FROM hit) AS read_pct FROM hit GROUP BY 1", "read_pct")(lambda s, d: mx.report_counts(fx.cand(s, d).where("containment >= 0.7")).withColumn("read_pct", F.col("read_pct").cast("double")))
query("agg_25_marker_agreement", f"{views('cand')}, {_HIT}, hc AS (SELECT marker, species, count(*) AS n FROM hit GROUP BY ALL), t AS (SELECT marker, species FROM (SELECT marker, species, row_number() OVER (PARTITION BY marker ORDER BY n DESC, species) AS rn FROM hc) WHERE rn = 1) SELECT avg(CASE WHEN a.species = b.species THEN 1.0 ELSE 0.0 END) AS agreement FROM t a JOIN t b ON a.marker < b.marker", "agreement")(lambda s, d: mx.marker_agreement(fx.cand(s, d).where("containment >= 0.7")))
query(
    "agg_26_verdict",
    f"""{_unrolled(2)} SELECT CASE WHEN bool_or(species = 1 AND w >= 0.001) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM p2""",
)(lambda s, d: mx.verdict(_steps(s, d, 2)[1].select("species", "w").distinct(), s.createDataFrame([(1, "HARAM"), (2, "HALAL")], "species int, status string"), 1.0, 100, 100))
query("fil_11_prune", f"{_unrolled(1)}, w AS (SELECT DISTINCT species, CASE WHEN w < 0.17 THEN 0.0 ELSE w END AS w FROM p1) SELECT species, w / sum(w) OVER () AS w FROM w", "w")(lambda s, d: mx.prune(_steps(s, d, 1)[1].select("species", "w").distinct(), 0.17))
query(
    "agg_28_calibration",
    """WITH o AS (SELECT l_suppkey % 7 AS sample_id, l_partkey % 4 AS species, l_linenumber % 3 AS marker, CAST(count(*) AS DOUBLE) AS r FROM lineitem GROUP BY ALL), x AS (SELECT sample_id, species, marker, ln(r / sum(r) OVER (PARTITION BY sample_id, marker) / (0.1 + 0.1 * species)) AS x FROM o),
d AS (SELECT sample_id, species, avg(x) AS x FROM x GROUP BY ALL), dm AS (SELECT species, avg(x) AS mu, var_pop(x) AS v FROM d GROUP BY 1), bm AS (SELECT x.species, marker, avg(x.x - d.x) AS mu, var_pop(x.x - d.x) AS v FROM x JOIN d USING (sample_id, species) GROUP BY ALL)
SELECT (SELECT avg(mu) FROM dm) AS d_mu, greatest((SELECT sqrt(avg(v)) FROM dm), 0.1) AS d_sigma, (SELECT avg(mu) FROM bm) AS b_mu, greatest((SELECT sqrt(avg(v)) FROM bm), 0.1) AS b_sigma""",
    "d_mu d_sigma b_mu b_sigma",
)(
    lambda s, d: mx.calibrate(
        fx.table(s, d, "lineitem").selectExpr("l_suppkey % 7 AS sample_id", "l_partkey % 4 AS species", "l_linenumber % 3 AS marker").groupBy("sample_id", "species", "marker").agg(F.count("*").cast("double").alias("obs_reads")).withColumn("true_w", 0.1 + 0.1 * F.col("species"))
    )
)
query("agg_27_fragment_rate", f"{views('seqs')} SELECT 1 / avg(length(sequence)) AS rate FROM seqs", "rate")(lambda s, d: mx.fragment_rate(fx.seqs(s, d).select(F.length("sequence").alias("length"))))

query("sim_01_reads")(lambda s, d: si.reads(fx.seqs(s, d).where(F.length("sequence") >= 200).select("id", "sequence"), 50, 150, 0.01))
query("km_27_primer_hits", f"{views('seqs')}, w AS (SELECT id, pos, substr(sequence, CAST(pos + 1 AS INTEGER), 6) AS x FROM (SELECT id, sequence, unnest(range(0, greatest(length(sequence) - 5, 0))) AS pos FROM seqs)) SELECT id, count(*) AS n FROM w WHERE regexp_matches(x, '^[AG]C[ACGT]TA[CT]$') GROUP BY 1")(lambda s, d: km.primer_hits(fx.seqs(s, d), "RCNTAY", 0).groupBy("id").agg(F.count("*").alias("n")))


# Evaluation

query("agg_29_regression", f"{views('truth')} SELECT count(*) AS n, avg(abs(est_w - true_w)) AS mae, 1 - sum(power(est_w - true_w, 2)) / sum(power(true_w - (SELECT avg(true_w) FROM truth), 2)) AS r2, avg(est_w - true_w) AS bias, stddev_samp(est_w - true_w) AS sd, avg(est_w - true_w) - 1.96 * stddev_samp(est_w - true_w) AS loa_lo, avg(est_w - true_w) + 1.96 * stddev_samp(est_w - true_w) AS loa_hi FROM truth", "mae r2 bias sd loa_lo loa_hi")(lambda s, d: ev.regression(fx.truth(s, d)))
_CONF = "SELECT tp, fp, fn, tn, 2.0 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity, tp / (tp + fp) AS precision_, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM (SELECT count(*) FILTER (WHERE t AND e) AS tp, count(*) FILTER (WHERE NOT t AND e) AS fp, count(*) FILTER (WHERE t AND NOT e) AS fn, count(*) FILTER (WHERE NOT t AND NOT e) AS tn FROM (SELECT quality > 0 AS t, n_chars > 800 AS e FROM documents JOIN labels USING (doc_id)))"
query("agg_30_detection", _CONF, "f1 sensitivity specificity precision_ accuracy")(
    lambda s, d: ev.detection(fx.table(s, d, "documents").join(fx.table(s, d, "labels"), "doc_id").select(F.col("quality").alias("truth"), F.col("n_chars").alias("estimate")), 800.0).select("tp", "fp", "fn", "tn", *[F.col(c).cast("double").alias(c) for c in ("f1", "sensitivity", "specificity", "precision_", "accuracy")])
)
query("agg_31_grouped_errors", f"{views('truth')} SELECT experiment, count(*) AS n, avg(abs(est_w - true_w)) AS mae, stddev_samp(est_w - true_w) AS sd FROM truth GROUP BY 1", "mae sd")(lambda s, d: ev.grouped_errors(fx.truth(s, d), "experiment"))
query("agg_34_totals", "SELECT coalesce(event_type, 'total') AS dataset, count(*) AS n, sum(value) AS value FROM events GROUP BY ROLLUP (event_type)", "value")(lambda s, d: ev.totals(fx.table(s, d, "events"), "event_type", "value"))
query(
    "agg_35_abundance_metrics",
    """WITH t AS (SELECT l_partkey % 50 AS id, sum(l_quantity) AS w FROM lineitem WHERE l_linenumber < 4 GROUP BY 1), e AS (SELECT l_partkey % 60 AS id, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1), j AS (SELECT coalesce(t.w, 0) / (SELECT sum(w) FROM t) AS t, coalesce(e.w, 0) / (SELECT sum(w) FROM e) AS e FROM t FULL OUTER JOIN e USING (id))
SELECT sum(abs(t - e)) AS l1, sum(abs(t - e)) / sum(t + e) AS bray_curtis, sqrt(avg(power(t - e, 2))) AS rmse, max(abs(t - e)) AS max_error, corr(t, e) AS pearson FROM j""",
    "l1 bray_curtis rmse max_error pearson",
)(
    lambda s, d: ev.abundance_metrics(
        fx.table(s, d, "lineitem").where("l_linenumber < 4").groupBy((F.col("l_partkey") % 50).alias("id")).agg(F.sum("l_quantity").alias("w")), fx.table(s, d, "lineitem").groupBy((F.col("l_partkey") % 60).alias("id")).agg(F.sum("l_extendedprice").alias("w"))
    )
)
query(
    "agg_33_set_detection",
    """WITH a AS (SELECT DISTINCT l_suppkey AS sample_id, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS sample_id, l_partkey AS id FROM lineitem WHERE l_discount > 0.05)
SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS tp, count(*) FILTER (WHERE a.id IS NULL) AS fp, count(*) FILTER (WHERE b.id IS NULL) AS fn FROM a FULL OUTER JOIN b ON a.sample_id = b.sample_id AND a.id = b.id GROUP BY 1""",
)(lambda s, d: ev.set_detection(*[fx.table(s, d, "lineitem").where(w).select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("id")) for w in ("l_returnflag = 'R'", "l_discount > 0.05")]))
query("st_24_power_law", "SELECT regr_slope(ln(l_extendedprice), ln(l_quantity)) AS slope, regr_intercept(ln(l_extendedprice), ln(l_quantity)) AS intercept FROM lineitem", "slope intercept")(lambda s, d: ev.power_law(fx.table(s, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))))
query(
    "st_23_ellipse",
    """WITH c AS (SELECT s_nationkey % 5 AS grp, var_samp(s_acctbal) AS a, covar_samp(s_acctbal, s_suppkey) AS b, var_samp(s_suppkey) AS d FROM supplier GROUP BY 1 HAVING count(*) > 2)
SELECT grp, sqrt(5.991 * ((a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b))) AS major, sqrt(5.991 * greatest((a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b), 0)) AS minor, atan2((a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b) - a, b) AS angle FROM c""",
    "major minor angle",
)(lambda s, d: ev.ellipse(fx.table(s, d, "supplier").selectExpr("s_nationkey % 5 AS grp", "s_acctbal AS x", "cast(s_suppkey AS DOUBLE) AS y"), "grp"))
query("agg_39_mean_quality", "SELECT doc_id AS id, (SELECT avg(ascii(c) - 33) FROM (SELECT unnest(string_split(md5(text), '')) AS c)) AS mean_quality FROM documents", "mean_quality")(lambda s, d: km.mean_quality(fx.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("quality"))).withColumn("mean_quality", F.col("mean_quality").cast("double")))


def entry(spark: SparkSession, d: str = "/root/testdata/sf0.001") -> DataFrame:
    """Differential abundance between two groups of suppliers, with p and q."""
    return rounded(di.differential_test(fx.ab(spark, d), fx.meta(spark, d), "EUROPE", "AFRICA"))
