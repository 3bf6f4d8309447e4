"""Queries of marker classification, summaries, joint inference and simulation; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.operators import differential as di
from loamspark.operators import functional as fu
from loamspark.operators import joint as jt
from loamspark.operators import markers as mk
from loamspark.operators import mixture as mx
from loamspark.operators import strains as st
from loamspark.operators import summaries as su
from loamspark.plans import fixtures as fx
from loamspark.plans.catalog import query
from loamspark.plans.fixtures import views
from loamspark.session import saved

# Marker classification: documents are the references of twelve species and three markers, benchmark items the reads and, by their beginnings, the primers.

_SCALE = 0.05


def _refs(s: SparkSession, d: str) -> DataFrame:
    return fx.seqs(s, d).selectExpr("id % 12 AS species", "id div 12 % 3 AS marker", "sequence").where(F.length("sequence") >= 21)


def marker_index(s: SparkSession, d: str, reads: DataFrame | None = None) -> mk.Index:
    return mk.build(_refs(s, d), fx.reads(s, d).selectExpr("id % 3 AS marker", "substring(sequence, 1, cast(15 + id % 60 AS INT)) AS sequence"), scale=_SCALE, reads=reads)


def _windows(source: str, k: int) -> str:
    """Canonical k-mers of a view's sequences in SQL, not hashed."""
    return f"SELECT * EXCLUDE x, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT * EXCLUDE sequence, substr(sequence, CAST(pos + 1 AS INTEGER), {k}) AS x FROM (SELECT *, unnest(range(0, greatest(length(sequence) - {k - 1}, 0))) AS pos FROM {source}))"


_MARKERS = f"""{views("seqs", "reads", "seqs_k", "reads_k")}, refs AS (SELECT id % 12 AS species, id // 12 % 3 AS marker, sequence FROM seqs WHERE length(sequence) >= 21),
pr AS (SELECT id % 3 AS marker, substr(sequence, 1, CAST(15 + id % 60 AS INTEGER)) AS sequence FROM reads), pk AS (SELECT DISTINCT marker, kmer FROM ({_windows("pr", 15)})),
r15 AS MATERIALIZED ({_windows("reads", 15)}), r21 AS MATERIALIZED ({_windows("reads", 21)}), fk AS MATERIALIZED (SELECT DISTINCT species, marker, kmer FROM ({_windows("refs", 21)})),
det AS (SELECT id, marker, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, marker) AS rn FROM (SELECT r.id, p.marker, count(*) / max(n.n) AS score FROM r15 r JOIN pk p USING (kmer) JOIN (SELECT id, count(*) AS n FROM r15 GROUP BY 1) n ON n.id = r.id GROUP BY ALL)) WHERE rn = 1 AND score >= 0.1),
lim AS (SELECT lpad(lower(hex(CAST(floor(18446744073709551615::HUGEINT / 20) AS UBIGINT))), 16, '0') AS h),
ck AS (SELECT DISTINCT id % 12 AS species, hash FROM seqs_k, lim WHERE hash < lim.h), qk AS (SELECT DISTINCT id, hash FROM reads_k, lim WHERE hash < lim.h),
long AS (SELECT id, CAST(floor((length(sequence) - 20) * {_SCALE}) AS INTEGER) > 2 AS long FROM reads),
cs AS (SELECT q.id, c.species, count(*) / max(n.n) AS c FROM qk q JOIN ck c USING (hash) JOIN (SELECT id, count(*) AS n FROM qk GROUP BY 1) n ON n.id = q.id GROUP BY ALL HAVING count(*) / max(n.n) >= 0.05),
fine AS (SELECT r.id, f.species, f.marker, count(*) / max(n.n) AS containment FROM r21 r JOIN fk f USING (kmer) JOIN (SELECT id, count(*) AS n FROM r21 GROUP BY 1) n ON n.id = r.id GROUP BY ALL),
ok AS (SELECT f.* FROM fine f JOIN long l USING (id) WHERE containment >= 0.3 AND (NOT l.long OR EXISTS (SELECT 1 FROM cs WHERE cs.id = f.id AND cs.species = f.species))),
fixed AS (SELECT id, arg_min(marker, species * 1000000 - containment * 1000 + marker / 1e6) AS marker FROM ok GROUP BY 1),
hits AS (SELECT o.id, o.marker, o.species, o.containment FROM ok o LEFT JOIN det d USING (id) JOIN fixed x USING (id) WHERE o.marker = coalesce(d.marker, x.marker))"""


def _hits(s: SparkSession, d: str) -> DataFrame:
    """The reads' hits, saved: the summary reads them three times."""
    reads = fx.reads(s, d)
    return saved(mk.classify(reads, marker_index(s, d, reads)), "hits")


query("km_20_fine_index_sizes", f"{_MARKERS} SELECT species, marker, count(*) AS n FROM fk GROUP BY ALL")(lambda s, d: mk.fine_sizes(_refs(s, d)))
query("km_21_detect_marker", f"{_MARKERS} SELECT id, marker, score FROM det", "score")(lambda s, d: mk.detect_marker(fx.reads(s, d), marker_index(s, d)))
query("km_22_classify_marker_reads", f"{_MARKERS} SELECT * FROM hits", "containment")(_hits)
query(
    "agg_22_marker_summary",
    f"{_MARKERS} SELECT 'total' AS kind, NULL::BIGINT AS key, count(*) AS n FROM reads UNION ALL SELECT 'classified', NULL, count(DISTINCT id) FROM hits UNION ALL SELECT 'marker', marker, count(DISTINCT id) FROM hits GROUP BY marker UNION ALL SELECT 'species', species, count(*) FROM hits GROUP BY species",
)(lambda s, d: mk.summary(fx.reads(s, d), _hits(s, d)))

# Summaries

query(
    "agg_42_taxa_by_group",
    f"""{views("sp", "meta", "tax")}, v AS (SELECT sample_id, phylum, sum(value) AS v FROM sp JOIN tax USING (feature_id) GROUP BY ALL), top AS (SELECT phylum FROM v GROUP BY 1 ORDER BY sum(v) DESC, phylum LIMIT 3),
g AS (SELECT s.sample_id, p.phylum, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT sample_id FROM sp) s CROSS JOIN (SELECT DISTINCT phylum FROM tax) p LEFT JOIN v ON v.sample_id = s.sample_id AND v.phylum = p.phylum),
o AS (SELECT sample_id, CASE WHEN phylum IN (FROM top) THEN phylum ELSE 'Other' END AS taxon, sum(v) AS v FROM g GROUP BY ALL) SELECT grp, taxon, avg(v) AS mean_value FROM o JOIN meta USING (sample_id) GROUP BY ALL""",
    "mean_value",
)(lambda s, d: su.taxa_by_group(fx.sp(s, d), fx.tax(s, d).select("feature_id", F.col("phylum").alias("taxon")), fx.meta(s, d), 3))
query(
    "agg_43_class_by_group",
    f"""{views("genes", "sp", "meta")}, c AS (SELECT cazy_id, feature_id, count(*) AS n FROM genes WHERE cazy_id IS NOT NULL GROUP BY ALL), p AS (SELECT regexp_extract(cazy_id, '^[A-Za-z]+') AS class, sample_id, sum(n * value) AS v FROM c JOIN sp USING (feature_id) GROUP BY ALL),
n AS (SELECT grp, count(*) AS n FROM meta WHERE sample_id IN (SELECT sample_id FROM sp) GROUP BY 1) SELECT grp, class, sum(v) / max(n) AS value FROM p JOIN meta USING (sample_id) JOIN n USING (grp) GROUP BY ALL""",
    "value",
)(lambda s, d: su.class_by_group(fu.project(fu.cazy_table(fx.genes(s, d)), fx.sp(s, d)).withColumnRenamed("feature_id", "function_id"), fx.meta(s, d)))
_PHI = "t AS (SELECT DISTINCT l_suppkey AS strain, 'g' || (l_partkey % 40) AS gene FROM lineitem WHERE l_returnflag = 'R'), e AS (SELECT DISTINCT l_suppkey AS strain, 'g' || (l_partkey % 40) AS gene FROM lineitem WHERE l_discount > 0.05), grid AS (SELECT strain, gene FROM (SELECT DISTINCT l_suppkey AS strain FROM lineitem) CROSS JOIN (SELECT DISTINCT gene FROM {})), "


def _carried(s: SparkSession, d: str, where: str) -> DataFrame:
    rows = fx.table(s, d, "lineitem").selectExpr("l_suppkey AS strain", "concat('g', l_partkey % 40) AS gene", "l_returnflag", "l_discount")
    return su.reference_genes(rows, rows.where(where))


query("agg_41_reference_genes", f"WITH {_PHI.format('t')} x AS (SELECT 1) SELECT grid.strain, grid.gene, CASE WHEN t.gene IS NULL THEN 0.0 ELSE 1.0 END AS phi FROM grid LEFT JOIN t USING (strain, gene)", "phi")(lambda s, d: _carried(s, d, "l_returnflag = 'R'"))
query(
    "agg_36_gene_attribution",
    f"""WITH {_PHI.format("t")} eg AS (SELECT DISTINCT gene FROM e), y AS (SELECT (strain, gene) IN (FROM (SELECT (strain, gene) FROM t)) AS t, (strain, gene) IN (FROM (SELECT (strain, gene) FROM e)) AS e FROM grid WHERE gene IN (FROM eg)),
c AS (SELECT count(*) FILTER (WHERE t AND e) AS tp, count(*) FILTER (WHERE e AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT e) AS fn, count(*) FILTER (WHERE NOT t AND NOT e) AS tn FROM y)
SELECT *, tp / (tp + fp) AS precision_, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM c""",
    "precision_ recall f1 accuracy",
)(lambda s, d: su.gene_attribution(_carried(s, d, "l_returnflag = 'R'"), _carried(s, d, "l_discount > 0.05")))
query(
    "agg_49_compare_modes",
    """WITH r AS (SELECT l_linenumber AS e, abs(l_discount - 0.05) AS a, abs(l_tax - 0.05) AS b, l_discount - 0.05 AS x, l_tax - 0.05 AS y FROM lineitem), m AS (SELECT e AS experiment, avg(a) AS mae_one, avg(b) AS mae_other, avg(x) AS bias_one, avg(y) AS bias_other FROM r GROUP BY 1)
SELECT *, mae_other - mae_one AS mae_change, CASE WHEN mae_one < mae_other THEN 'standard' WHEN mae_other < mae_one THEN 'advanced' ELSE 'tie' END AS better FROM m""",
    "mae_one mae_other bias_one bias_other mae_change",
)(
    lambda s, d: su.compare_modes(
        fx.table(s, d, "lineitem").selectExpr("l_linenumber AS experiment", "inline(array(struct('standard' AS mode, l_discount AS est_w), struct('advanced' AS mode, l_tax AS est_w)))").withColumn("true_w", F.lit(0.05)), "standard", "advanced"
    )
)

# The likeliest rate of degradation, all runs' trial points in one plan a round; the logarithm of a sum of exponentials has its maximum at an end, as the grid shows.

_LENGTHS = "ln AS (SELECT s AS species, m AS marker, 100 + 20 * s + 50 * m AS length FROM range(6) a(s) CROSS JOIN range(3) b(m))"
query(
    "em_07_likelihood_rate",
    f"""{views("cand")}, {_LENGTHS}, g AS (SELECT 1e-6 + i * (0.1 - 1e-6) / 64 AS rate FROM range(65) r(i)), rr AS (SELECT 0 AS run UNION ALL SELECT 1),
l AS (SELECT run, rate, read_id, ln(sum(CASE WHEN run = 0 THEN 1 / 6.0 ELSE (species + 1) / 21.0 END * exp(-rate * length) * containment)) AS ll FROM cand JOIN ln USING (species, marker) CROSS JOIN g CROSS JOIN rr GROUP BY ALL)
SELECT run, arg_max(rate, ll) AS rate, max(ll) AS ll FROM (SELECT run, rate, sum(ll) AS ll FROM l GROUP BY ALL) GROUP BY run""",
    "rate ll",
)(lambda s, d: _fitted_rates(s, d))


def _fitted_rates(s: SparkSession, d: str) -> DataFrame:
    cand = saved(mx.profiles(fx.cand(s, d)), "candidates")
    lengths = s.sql("SELECT s.id AS species, m.id AS marker, 100 + 20 * s.id + 50 * m.id AS length FROM range(6) s CROSS JOIN range(3) m")
    runs = cand.select("species", "marker").distinct().select(F.explode(F.array(F.lit(0), F.lit(1))).alias("run"), "species", "marker")
    params = runs.select("run", "species", "marker", F.when(F.col("run") == 0, 1 / 6).otherwise((F.col("species") + 1) / 21).alias("w"), F.lit(1.0).alias("d"), F.lit(1.0).alias("b"))
    found = mx.likelihood_rates(cand, params, lengths)
    return s.createDataFrame(found).select(F.col("run").cast("int").alias("run"), "rate", "ll")


# Joint inference: the mixture's candidates, whose markers are genes and the last of them none.

_EVEN = f"""{views("cand")}, k AS (SELECT count(DISTINCT species) AS k FROM cand), x AS (SELECT read_id, species AS strain, nullif(marker, 2) AS gene, containment AS c, containment / (k + 1) * CASE WHEN marker = 2 THEN 1 ELSE 0.5 END AS x FROM cand CROSS JOIN k WHERE containment >= 0.05),
t AS (SELECT read_id, avg(c) * 0.25 / max(k + 1) AS pool, sum(x) + avg(c) * 0.25 / max(k + 1) AS total, count(*) AS n FROM x CROSS JOIN k GROUP BY 1),
e AS MATERIALIZED (SELECT strain, gene, sum(x / total) AS g, sum(pool / total / n) AS m, sum(ln(total) / n) AS ll, sum(1.0 / n) AS reads FROM x JOIN t USING (read_id) GROUP BY ALL)"""


def joint_candidates(s: SparkSession, d: str) -> DataFrame:
    return fx.cand(s, d).selectExpr("read_id", "species AS strain", "nullif(marker, 2) AS gene", "containment")


def _even_shares(s: SparkSession, d: str) -> DataFrame:
    rows = jt.saved_profiles(joint_candidates(s, d))
    params, mobile = jt.start(jt.cells(rows), [jt.Run("0")], jt.Settings())
    return jt.expected(rows, *jt.tables(rows, params, mobile, 2)).drop("run", "s")


def _one_update(s: SparkSession, d: str) -> DataFrame:
    rows = jt.saved_profiles(joint_candidates(s, d))
    done = jt.fit_runs(rows, [jt.Run("0")], jt.Settings(max_iter=1))
    return jt.tables(rows, done.params, done.mobile, 2)[0].select("strain", "gene", "pi", "phi", F.lit(done.mobile["0"]).alias("mobile"))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    rows = jt.saved_profiles(joint_candidates(s, d))
    done = jt.fit_runs(rows, jt.restarts())
    assigned = jt.assign(rows, done, 2).groupBy("strain", "gene", "is_mobile").agg(F.sum("reads").alias("reads"), F.sum(F.col("reads") * F.col("posterior")).alias("posterior"))
    return assigned.withColumn("converged", F.lit(done.converged[done.best]))


query("em_17_joint_shares", f"{_EVEN} SELECT strain, gene, g, m, ll, reads FROM e", "g m ll reads")(_even_shares)
query(
    "em_18_joint_update",
    f"""{_EVEN}, s AS (SELECT strain, sum(g) AS s, sum(g) FILTER (WHERE gene IS NOT NULL) AS genic FROM e GROUP BY 1), w AS (SELECT (SELECT sum(m) FROM e) AS m, (SELECT sum(g + m) FROM e) AS n)
SELECT e.strain, e.gene, s.s / w.n AS pi, CASE WHEN e.gene IS NOT NULL THEN (e.g + 0.5) / (s.genic + 1) END AS phi, w.m / w.n AS mobile FROM e JOIN s USING (strain) CROSS JOIN w""",
    "pi phi mobile",
)(_one_update)


def _joint_steps_sql(runs: str, steps: int) -> str:
    """CTEs of ``steps`` EM steps from an even start, written out: p{i}(run, strain, gene, pi, phi), m{i}(run, mobile) and e{i}, the sums of step i.

    ``runs`` selects run, strain, fix_pi and fix_phi from ``c``, the candidates, and ``o``, the strains in the order of their containments.
    """
    out = [
        "c AS MATERIALIZED (SELECT read_id, species AS strain, nullif(marker, 2) AS gene, containment AS c FROM cand WHERE containment >= 0.05)",
        "o AS (SELECT strain, row_number() OVER (ORDER BY sum(c) DESC, strain) AS nth FROM c GROUP BY strain)",
        f"u AS MATERIALIZED ({runs})",
        "n AS (SELECT run, count(*) + 1 AS n, any_value(fix_pi) AS fix_pi, any_value(fix_phi) AS fix_phi FROM u GROUP BY run)",
        "gn AS (SELECT count(DISTINCT gene) AS genes FROM c)",
        "p0 AS MATERIALIZED (SELECT u.run, u.strain, g.gene, 1.0 / n.n AS pi, CASE WHEN g.gene IS NOT NULL THEN 0.5::DOUBLE END AS phi FROM u JOIN n USING (run) CROSS JOIN (SELECT DISTINCT gene FROM c) g)",
        "m0 AS MATERIALIZED (SELECT run, 1.0 / n AS mobile FROM n)",
    ]
    for i in range(steps):
        out += [
            f"x{i} AS (SELECT p.run, c.read_id, c.strain, c.gene, c.c, greatest(p.pi, 1e-300) * greatest(c.c, 1e-300) * greatest(coalesce(p.phi, 1), 1e-300) AS x FROM c JOIN p{i} p ON p.strain = c.strain AND p.gene IS NOT DISTINCT FROM c.gene)",
            f"y{i} AS (SELECT *, max(x) OVER w AS own, count(*) OVER w AS k FROM x{i} WINDOW w AS (PARTITION BY run, read_id, strain))",
            f"z{i} AS (SELECT *, sum(own / k) OVER w AS total, avg(c) OVER w AS mean, count(*) OVER w AS kk FROM y{i} WINDOW w AS (PARTITION BY run, read_id))",
            f"t{i} AS MATERIALIZED (SELECT z.*, m.mobile * 0.5 * mean / greatest(genes, 1) AS pool, total + m.mobile * 0.5 * mean / greatest(genes, 1) AS whole FROM z{i} z JOIN m{i} m USING (run) CROSS JOIN gn)",
            f"e{i} AS MATERIALIZED (SELECT run, strain, gene, sum(own / whole) AS g, sum(own / whole / k) AS s, sum(pool / whole / kk) AS m, sum(ln(whole) / kk) AS ll, sum(1.0 / kk) AS reads FROM t{i} GROUP BY ALL)",
            f"s{i} AS (SELECT run, strain, sum(s) AS s, coalesce(sum(g) FILTER (WHERE gene IS NOT NULL), 0) AS genic FROM e{i} GROUP BY ALL)",
            f"r{i} AS (SELECT u.run, u.strain, CASE WHEN u.fix_pi THEN 1.0 ELSE greatest(coalesce(s.s, 0), 1e-10) END AS raw, coalesce(s.genic, 0) AS genic FROM u LEFT JOIN s{i} s ON s.run = u.run AND s.strain = u.strain)",
            f"w{i} AS (SELECT r.run, any_value(q.pool) AS pool, sum(r.raw) + any_value(q.pool) AS whole FROM r{i} r JOIN (SELECT e.run, CASE WHEN any_value(n.fix_pi) THEN 1.0 ELSE greatest(sum(e.m), 1e-10) END AS pool FROM e{i} e JOIN n USING (run) GROUP BY e.run) q ON q.run = r.run GROUP BY r.run)",
            f"m{i + 1} AS MATERIALIZED (SELECT run, pool / whole AS mobile FROM w{i})",
            f"""p{i + 1} AS MATERIALIZED (SELECT p.run, p.strain, p.gene, r.raw / w.whole AS pi, CASE WHEN p.gene IS NULL THEN NULL WHEN n.fix_phi THEN p.phi
                ELSE least(greatest(greatest(coalesce(e.g, 0) + 0.5, 1e-10) / greatest(r.genic + 1, greatest(coalesce(e.g, 0) + 0.5, 1e-10) + 1e-10), 1e-6), 1 - 1e-6) END AS phi
                FROM p{i} p JOIN r{i} r ON r.run = p.run AND r.strain = p.strain JOIN w{i} w ON w.run = p.run JOIN n ON n.run = p.run LEFT JOIN e{i} e ON e.run = p.run AND e.strain = p.strain AND e.gene IS NOT DISTINCT FROM p.gene)""",
        ]
    return f"{views('cand')}, {', '.join(out)}"


_ONE_RUN = "SELECT DISTINCT '0' AS run, strain, false AS fix_pi, false AS fix_phi FROM c"
_CHOICES = "SELECT k.nth AS run, o.strain, false AS fix_pi, false AS fix_phi FROM o k JOIN o ON o.nth <= k.nth"
_PARTS = "SELECT DISTINCT run, strain, run = 'function_only' AS fix_pi, run = 'strain_only' AS fix_phi FROM c CROSS JOIN (VALUES ('joint'), ('strain_only'), ('function_only')) v(run)"


def _steps(s: SparkSession, d: str, runs: list[jt.Run], steps: int) -> tuple[DataFrame, jt.Fit]:
    rows = jt.saved_profiles(joint_candidates(s, d))
    return rows, jt.fit_runs(rows, runs, jt.Settings(max_iter=steps, tolerance=0.0))


def _fit_steps(s: SparkSession, d: str) -> DataFrame:
    rows, done = _steps(s, d, [jt.Run("0")], 4)
    return jt.tables(rows, done.params, done.mobile, 2)[0].select("strain", "gene", "pi", "phi", F.lit(done.mobile["0"]).alias("mobile"))


def _part_steps(s: SparkSession, d: str) -> DataFrame:
    rows, done = _steps(s, d, jt.ABLATIONS, 3)
    return jt.tables(rows, done.params, done.mobile, 2)[0].select("run", "strain", "gene", "pi", "phi")


def _assigned_steps(s: SparkSession, d: str) -> DataFrame:
    rows, done = _steps(s, d, [jt.Run("0")], 3)
    return jt.assign(rows, done, 2).groupBy("strain", "gene", "is_mobile").agg(F.sum("reads").alias("reads"), F.sum(F.col("reads") * F.col("posterior")).alias("posterior"))


query("em_16_joint_steps", f"{_joint_steps_sql(_ONE_RUN, 4)} SELECT strain, gene, pi, phi, mobile FROM p4 JOIN m4 USING (run)", "pi phi mobile")(_fit_steps)
query(
    "em_23_choice_steps",
    f"""{_joint_steps_sql(_CHOICES, 3)}, l AS (SELECT run, sum(ll) AS ll, sum(reads) AS reads FROM e2 GROUP BY run), f AS (SELECT run, sum(0.5 * ln(phi) + 0.5 * ln(1 - phi)) AS prior, count(DISTINCT strain) AS k FROM p2 GROUP BY run),
b AS (SELECT run::INTEGER AS k, ll + prior AS ll, -2 * (ll + prior) + (k - 1 + k * genes + 1) * ln(greatest(reads, 1)) AS bic FROM l JOIN f USING (run) CROSS JOIN gn) SELECT *, bic = min(bic) OVER () AS chosen, false AS converged FROM b""",
    "ll bic",
)(lambda s, d: jt.select_strains(joint_candidates(s, d), jt.Settings(max_iter=3, tolerance=0.0), n=1))
query("em_26_ablation_steps", f"{_joint_steps_sql(_PARTS, 3)} SELECT run, strain, gene, pi, phi FROM p3", "pi phi")(_part_steps)
query(
    "em_24_assigned_steps",
    f"""{_joint_steps_sql(_ONE_RUN, 4)}, r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY own DESC, strain, x DESC, gene NULLS FIRST) AS rn FROM t3)
SELECT strain, gene, pool > own AS is_mobile, count(*) AS reads, sum(own / whole) AS posterior FROM r WHERE rn = 1 GROUP BY ALL""",
    "posterior",
)(_assigned_steps)
query("em_16_joint_fit")(lambda s, d: jt.fit(joint_candidates(s, d)))
query("em_23_select_strains")(lambda s, d: jt.select_strains(joint_candidates(s, d)))
query("em_24_assigned_reads")(_assigned)
query("em_26_ablation")(lambda s, d: jt.ablate(joint_candidates(s, d)))
query(
    "em_20_identifiability",
    """WITH w AS (SELECT p_type AS strain, count(*) AS reads, count(*) / (SELECT count(*) FROM part) AS pi FROM part GROUP BY 1), f AS (SELECT strain, reads / power(pi, 2) + 1e-6 AS f FROM w)
SELECT x.strain AS a, y.strain AS b, least(x.f, y.f) AS score FROM f x JOIN f y ON x.strain < y.strain""",
    "score",
)(lambda s, d: jt.identifiability(fx.table(s, d, "part").groupBy(F.col("p_type").alias("strain")).agg(F.count("*").alias("reads")).selectExpr("strain", "reads", "reads / sum(reads) OVER () AS pi")))

# Simulated strains: the supplied tables give genomes and places, so that SQL can tell the same reads and genes.

_ORIGIN = "o AS (SELECT l_orderkey * 10 + l_linenumber AS read_id, doc_id AS strain, CAST(l_partkey * 37 % length(sequence) AS INTEGER) AS start FROM lineitem JOIN seqs ON doc_id = l_suppkey WHERE length(sequence) >= 100), gn AS (SELECT p_size % 2 = 0 AS is_mobile, s.doc_id AS strain, p_brand AS gene, CAST(p_partkey * 11 % 2000 AS INTEGER) AS start, CAST(p_partkey * 11 % 2000 + 80 AS INTEGER) AS \"end\" FROM part JOIN (SELECT DISTINCT l_suppkey AS doc_id, l_partkey FROM lineitem) s ON l_partkey = p_partkey)"


def _origins(s: SparkSession, d: str) -> DataFrame:
    lines, docs = fx.table(s, d, "lineitem"), fx.seqs(s, d).select("id", F.length("sequence").alias("size")).where("size >= 100")
    return lines.join(docs, lines["l_suppkey"] == docs["id"]).selectExpr("l_orderkey * 10 + l_linenumber AS read_id", "id AS strain", "cast(l_partkey * 37 % size AS INT) AS start")


def _places(s: SparkSession, d: str) -> DataFrame:
    carried = fx.table(s, d, "lineitem").selectExpr("l_suppkey AS strain", "l_partkey AS p_partkey").distinct()
    return fx.table(s, d, "part").join(carried, "p_partkey").selectExpr("strain", "p_brand AS gene", "cast(p_partkey * 11 % 2000 AS INT) AS start", "cast(p_partkey * 11 % 2000 + 80 AS INT) AS `end`")


_SEQS = views("seqs").replace("doc_id AS id", "doc_id")
query("sim_03_fragments", f"{_SEQS}, {_ORIGIN} SELECT read_id, strain, start, substr(sequence || substr(sequence, 1, 100), start + 1, 100) AS sequence FROM o JOIN seqs ON doc_id = strain")(lambda s, d: st.fragments(_origins(s, d), fx.seqs(s, d).withColumnRenamed("id", "strain"), 100))
query(
    "jn_15_overlapped_genes",
    f"{_SEQS}, {_ORIGIN} SELECT o.read_id, o.strain, o.start, arg_min(g.gene, (g.start, g.gene)) AS gene FROM o LEFT JOIN gn g ON g.strain = o.strain AND o.start < g.\"end\" AND o.start + 100 > g.start GROUP BY ALL",
)(lambda s, d: st.with_genes(_origins(s, d), _places(s, d), 100))
query("sim_06_flawed_reads")(lambda s, d: st.with_errors(st.fragments(_origins(s, d), fx.seqs(s, d).withColumnRenamed("id", "strain"), 100).withColumn("read_id", F.col("read_id").cast("string")), 0.005))
