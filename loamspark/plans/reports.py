"""Queries of report tables, group tests, group networks, mixed hashes and the mixture simulator; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.functions import dna
from loamspark.operators import composition as co
from loamspark.operators import differential as di
from loamspark.operators import evaluation as ev
from loamspark.operators import functional as fu
from loamspark.operators import kmers as km
from loamspark.operators import mixture as mx
from loamspark.operators import network as nw
from loamspark.operators import simulate as si
from loamspark.operators import summaries as su
from loamspark.plans import fixtures as fx
from loamspark.plans.catalog import _pairs, _reads_k, _seqs_k, _steps, _unrolled, query
from loamspark.plans.fixtures import views
from loamspark.session import saved
from loamspark.streaming import classify as sc

# Tests between groups of diversity

_ALPHA = "p AS (SELECT sample_id, value / sum(value) OVER (PARTITION BY sample_id) AS p FROM {t} WHERE value > 0), al AS (SELECT sample_id, -sum(p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson, CAST(count(*) AS DOUBLE) AS richness, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0.0 END AS evenness FROM p GROUP BY 1)"
_LONG = "v AS (SELECT measure, grp, value FROM (UNPIVOT al ON shannon, simpson, richness, evenness INTO NAME measure VALUE value) JOIN tmeta USING (sample_id))"
_U = "u AS (SELECT a.measure, a.grp AS g1, b.grp AS g2, sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END) AS u, count(DISTINCT a.value) + count(DISTINCT b.value) AS parts FROM v a JOIN v b ON a.measure = b.measure AND a.grp < b.grp GROUP BY ALL)"


def _alpha(s: SparkSession, d: str) -> DataFrame:
    return co.alpha_diversity(fx.tiny(s, d))


query("st_22_alpha_ranks", f"{views('tiny', 'tmeta')}, {_ALPHA.format(t='tiny')}, {_LONG}, {_U} SELECT measure, g1, g2, u FROM u", "u")(
    lambda s, d: di.mann_whitney(di.measures(_alpha(s, d)).join(fx.tmeta(s, d), "sample_id").select(F.col("feature_id").alias("measure"), "grp", "value"), "measure").select("measure", "g1", "g2", "u")
)
def _few(s: SparkSession, d: str) -> DataFrame:
    africa = fx.tmeta(s, d).where("grp = 'AFRICA'").select("sample_id", F.lit(True).alias("africa"))
    return fx.tiny(s, d).join(africa, "sample_id", "left").where("feature_id < 'Brand#2' OR africa IS NULL").drop("africa")


# All ways to choose the first group's places among both groups' ranks are numbers of so many bits.
query(
    "st_21_exact_p",
    f"""{views('tiny', 'tmeta')}, {_ALPHA.format(t='tiny')}, {_LONG}, {_U}, n AS (SELECT grp, count(*) AS n FROM v WHERE measure = 'shannon' GROUP BY 1), c AS (SELECT u.g1, u.g2, u.u, a.n AS n1, b.n AS n2 FROM u JOIN n a ON a.grp = g1 JOIN n b ON b.grp = g2 WHERE measure = 'shannon'),
w AS (SELECT c.*, list_sum(list_transform(range(0, n1 + n2), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) - n1 * (n1 + 1) / 2 AS x FROM c JOIN range(0, 65536) r(m) ON m < (1 << (n1 + n2)) AND bit_count(m) = n1)
SELECT g1, g2, u, least(1.0, 2.0 * count(*) FILTER (WHERE x >= greatest(u, n1 * n2 - u)) / count(*)) AS p FROM w GROUP BY g1, g2, u""",
    "u p",
)(lambda s, d: di.mann_whitney_test(_alpha(s, d).join(fx.tmeta(s, d), "sample_id").select("grp", F.col("shannon").alias("value"))).select("g1", "g2", "u", "p"))
# One region lacks half of the features, so that measures without ties differ between the groups.
query(
    "st_22_alpha_differences",
    f"""{views('tiny', 'tmeta')}, few AS (SELECT * FROM tiny WHERE feature_id < 'Brand#2' OR sample_id NOT IN (SELECT sample_id FROM tmeta WHERE grp = 'AFRICA')), {_ALPHA.format(t='few')}, {_LONG}, {_U},
n AS (SELECT grp, count(*) AS n FROM v WHERE measure = 'shannon' GROUP BY 1), k AS (SELECT measure, grp, rank() OVER (PARTITION BY measure ORDER BY value) AS r FROM v),
h AS (SELECT measure, 12.0 / ((SELECT sum(n) FROM n) * ((SELECT sum(n) FROM n) + 1)) * sum(s * s / c) - 3 * ((SELECT sum(n) FROM n) + 1) AS h FROM (SELECT measure, grp, sum(r) AS s, count(*) AS c FROM k GROUP BY ALL) GROUP BY 1),
c AS (SELECT u.measure, u.g1, u.g2, u.u, a.n AS n1, b.n AS n2 FROM u JOIN n a ON a.grp = g1 JOIN n b ON b.grp = g2 WHERE measure IN ('shannon', 'simpson')),
w AS (SELECT c.*, list_sum(list_transform(range(0, n1 + n2), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) - n1 * (n1 + 1) / 2 AS x FROM c JOIN range(0, 65536) r(m) ON m < (1 << (n1 + n2)) AND bit_count(m) = n1),
pp AS (SELECT measure, g1, g2, u, least(1.0, 2.0 * count(*) FILTER (WHERE x >= greatest(u, n1 * n2 - u)) / count(*)) AS p FROM w GROUP BY ALL),
q AS (SELECT *, p * count(*) OVER (PARTITION BY measure) / count(*) OVER (PARTITION BY measure ORDER BY p) AS e FROM pp),
f AS (SELECT measure, g1, g2, u, p, least(1.0, min(e) OVER (PARTITION BY measure ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM q)
SELECT f.*, h, exp(-h / 2) * (1 + h / 2) AS kw_p, CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE 'ns' END AS stars FROM f JOIN h USING (measure) WHERE exp(-h / 2) * (1 + h / 2) < 0.05""",
    "u p q h kw_p",
)(lambda s, d: di.alpha_tests(co.alpha_diversity(_few(s, d)), fx.tmeta(s, d)).where("measure IN ('shannon', 'simpson')"))
query("st_22_alpha_tests")(lambda s, d: di.alpha_tests(co.alpha_diversity(fx.ab(s, d)), fx.meta(s, d)))

# Networks of groups

_GPHI = "gt AS (SELECT grp, feature_id, sample_id, value FROM dense JOIN tmeta USING (sample_id)), gphi AS (SELECT a.grp, a.feature_id AS src, b.feature_id AS dst, var_samp(ln(a.value + 1) - ln(b.value + 1)) AS phi FROM gt a JOIN gt b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id GROUP BY ALL)"


def _group_pairs(s: SparkSession, d: str) -> DataFrame:
    return nw.phi_by_group(fx.tiny(s, d), fx.tmeta(s, d))


query("gr_15_group_phi", f"{views('dense', 'tmeta')}, {_GPHI} SELECT grp, src, dst, phi FROM gphi", "phi")(_group_pairs)
query("gr_15_group_networks", f"{views('dense', 'tmeta')}, {_GPHI} SELECT g.* FROM gphi g JOIN (SELECT grp, quantile_cont(phi, 0.1) AS t FROM gphi GROUP BY 1) c ON c.grp = g.grp WHERE phi <= c.t", "phi")(lambda s, d: nw.group_networks(_group_pairs(s, d), 10.0))
query("gr_15_fixed_networks", f"{views('dense', 'tmeta')}, {_GPHI} SELECT * FROM gphi WHERE phi <= 0.03", "phi")(lambda s, d: nw.group_networks(_group_pairs(s, d), limit=0.03))
query("gr_04_sensitivity_modules")(lambda s, d: nw.sensitivity_modules(_pairs(s, d)))
query("srt_01_edges_by_phi", f"{views('phi')} SELECT src, dst, phi FROM phi ORDER BY phi, src, dst LIMIT 50", "phi")(lambda s, d: _pairs(s, d).orderBy("phi", "src", "dst").limit(50))

# Evaluation

_MODES = "rows AS (SELECT experiment % 5 AS experiment, m AS mode, CASE WHEN id % 4 = 0 THEN 0.0 ELSE true_w END AS true_w, CASE WHEN id % (3 + length(m)) = 0 THEN 0.0 ELSE est_w / (10 + length(m)) END AS est_w FROM truth CROSS JOIN (SELECT unnest(['plain', 'advanced']) AS m)), big AS (SELECT CAST(experiment AS VARCHAR) AS experiment, * EXCLUDE experiment FROM rows UNION ALL SELECT 'all', * EXCLUDE experiment FROM rows)"
_METRICS = f"""{views('truth')}, {_MODES}, er AS (SELECT experiment, mode, count(*) AS n, avg(abs(est_w - true_w)) AS mae, 1 - sum(power(true_w - est_w, 2)) / (count(*) * var_pop(true_w)) AS r2, avg(est_w - true_w) AS bias, 3.92 * stddev_samp(est_w - true_w) AS loa_width FROM big WHERE true_w > 0 OR est_w > 0.001 GROUP BY ALL),
de AS (SELECT experiment, mode, count(*) FILTER (WHERE true_w > 0 AND est_w > 0.001) AS tp, count(*) FILTER (WHERE true_w > 0) AS t, count(*) FILTER (WHERE est_w > 0.001) AS e, count(*) FILTER (WHERE true_w <= 0) AS f, count(*) FILTER (WHERE true_w <= 0 AND est_w <= 0.001) AS tn FROM big GROUP BY ALL),
mt AS (SELECT er.*, tp / nullif(t, 0) AS sensitivity, tn / nullif(f, 0) AS specificity, CASE WHEN tp > 0 THEN 2.0 * tp / (t + e) END AS f1 FROM er JOIN de USING (experiment, mode))"""


def _metrics(s: SparkSession, d: str) -> DataFrame:
    rows = fx.truth(s, d).crossJoin(s.createDataFrame([("plain",), ("advanced",)], "mode string"))
    rows = rows.selectExpr("experiment % 5 AS experiment", "mode", "CASE WHEN id % 4 = 0 THEN 0D ELSE true_w END AS true_w", "CASE WHEN id % (3 + length(mode)) = 0 THEN 0D ELSE est_w / (10 + length(mode)) END AS est_w")
    return ev.mode_metrics(rows)


query("agg_49_mode_metrics", f"{_METRICS} SELECT * FROM mt", "mae r2 bias loa_width sensitivity specificity f1")(lambda s, d: _metrics(s, d).withColumns({c: F.col(c).cast("double") for c in ("sensitivity", "specificity", "f1")}))
query(
    "agg_49_compare_metrics",
    f"""{_METRICS} SELECT a.experiment, b.mae - a.mae AS mae_change, b.r2 - a.r2 AS r2_change, b.bias - a.bias AS bias_change, b.loa_width - a.loa_width AS loa_width_change, b.f1 - a.f1 AS f1_change,
CASE WHEN b.mae < a.mae THEN b.mode WHEN a.mae < b.mae THEN a.mode ELSE 'tie' END AS best_mae, CASE WHEN b.r2 > a.r2 THEN b.mode WHEN a.r2 > b.r2 THEN a.mode ELSE 'tie' END AS best_r2, CASE WHEN b.f1 > a.f1 THEN b.mode WHEN a.f1 > b.f1 THEN a.mode ELSE 'tie' END AS best_f1
FROM mt a JOIN mt b ON a.experiment = b.experiment AND a.mode = 'plain' AND b.mode = 'advanced'""",
    "mae_change r2_change bias_change loa_width_change f1_change",
)(lambda s, d: ev.compare_metrics(_metrics(s, d), "plain", "advanced"))
query(
    "jn_18_with_missing",
    """WITH e AS (SELECT l_suppkey AS sample_id, l_partkey % 20 AS species, sum(l_quantity) AS est_w FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), t AS (SELECT l_suppkey AS sample_id, l_partkey % 23 AS species, sum(l_quantity) - 30 AS true_w FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT coalesce(e.sample_id, t.sample_id) AS sample_id, coalesce(e.species, t.species) AS species, coalesce(true_w, 0.0) AS true_w, coalesce(est_w, 0.0) AS est_w, abs(coalesce(est_w, 0.0) - coalesce(true_w, 0.0)) AS abs_error
FROM e FULL OUTER JOIN t ON e.sample_id = t.sample_id AND e.species = t.species WHERE e.species IS NOT NULL OR true_w > 0""",
    "true_w est_w abs_error",
)(
    lambda s, d: ev.with_missing(
        fx.table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("sample_id"), (F.col("l_partkey") % 20).alias("species")).agg(F.sum("l_quantity").alias("est_w")),
        fx.table(s, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("sample_id"), (F.col("l_partkey") % 23).alias("species")).agg((F.sum("l_quantity") - 30).alias("true_w")),
    )
)
_DETECTED = "det AS (SELECT 'c' || (l_suppkey % 7) AS category, l_suppkey AS sample_id, 'sp' || (l_partkey % 9) AS species, sum(l_quantity) AS weight_pct, l_suppkey * 3 AS total_reads, l_suppkey * 2 + l_suppkey % 5 AS classified_reads FROM lineitem GROUP BY ALL)"


def _detected(s: SparkSession, d: str) -> DataFrame:
    keys = [F.expr("concat('c', l_suppkey % 7)").alias("category"), F.col("l_suppkey").alias("sample_id"), F.expr("concat('sp', l_partkey % 9)").alias("species")]
    rows = fx.table(s, d, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").alias("weight_pct"))
    return ev.sample_detections(rows.withColumns({"total_reads": F.expr("sample_id * 3"), "classified_reads": F.expr("sample_id * 2 + sample_id % 5")}))


query(
    "agg_32_sample_detections",
    f"WITH {_DETECTED}, k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY weight_pct DESC, species) AS rn FROM det) SELECT category, sample_id, coalesce(100.0 * max(classified_reads) / nullif(max(total_reads), 0), 0) AS rate, string_agg(species || ' (' || printf('%.1f', weight_pct) || '%)', ', ' ORDER BY rn) FILTER (WHERE rn <= 3) AS top_species FROM k GROUP BY ALL",
    "rate",
)(_detected)
query("agg_32_category_summary", f"WITH {_DETECTED}, r AS (SELECT DISTINCT category, sample_id, coalesce(100.0 * classified_reads / nullif(total_reads, 0), 0) AS rate FROM det) SELECT category, count(*) AS n, min(rate) AS class_min, max(rate) AS class_max, avg(rate) AS class_mean FROM r GROUP BY 1", "class_min class_max class_mean")(
    lambda s, d: ev.category_summary(_detected(s, d))
)
query(
    "agg_37_mobile_metrics",
    """WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 400), m AS (SELECT doc_id FROM labels WHERE quality = 1), x AS (SELECT count(*) AS tp FROM a JOIN m USING (doc_id)), y AS (SELECT tp, (SELECT count(*) FROM a) - tp AS fp, (SELECT count(*) FROM m) - tp AS fn FROM x)
SELECT tp, fp, fn, tp / (tp + fp) AS precision_, tp / (tp + fn) AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM y""",
    "precision_ recall f1",
)(
    lambda s, d: ev.mobile_metrics(fx.table(s, d, "documents").select(F.col("doc_id").alias("read_id"), (F.col("n_chars") > 400).alias("is_mobile")), fx.table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("read_id"))).withColumns(
        {c: F.col(c).cast("double") for c in ("precision_", "recall", "f1")}
    )
)

# Summaries of significant features, by limits that leave some out

_TESTS = "tests AS (SELECT feature_id, phylum AS taxon, (feature_id * 37 % 1000) / 1000.0 AS q, (feature_id * 91 % 400) / 100.0 - 2 AS effect FROM tax)"


def _tests(s: SparkSession, d: str) -> DataFrame:
    return fx.tax(s, d).selectExpr("feature_id", "(feature_id * 37 % 1000) / 1000D AS q", "(feature_id * 91 % 400) / 100D - 2 AS effect")


def _breakdown(s: SparkSession, d: str) -> DataFrame:
    return su.significant_by_taxon(_tests(s, d), fx.tax(s, d).select("feature_id", F.col("phylum").alias("taxon")), 0.05)


query("agg_46_breakdown", f"{views('tax')}, {_TESTS} SELECT taxon, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM tests WHERE q < 0.05 GROUP BY 1", "share")(lambda s, d: _breakdown(s, d).withColumn("share", F.col("share").cast("double")))
query(
    "agg_46_breakdown_text",
    f"{views('tax')}, {_TESTS}, c AS (SELECT taxon, count(*) AS n FROM tests WHERE q < 0.05 GROUP BY 1) SELECT 'Among ' || CAST(sum(n) AS BIGINT) || ' significant features: ' || string_agg(n || ' ' || taxon, ', ' ORDER BY n DESC, taxon) || '.' AS text FROM c",
)(lambda s, d: su.breakdown_text(_breakdown(s, d)))
query("srt_03_largest_effects", f"{views('tax')}, {_TESTS} SELECT feature_id, q, effect FROM tests WHERE q < 0.05 ORDER BY abs(effect) DESC, feature_id LIMIT 10", "q effect")(lambda s, d: su.top_effects(_tests(s, d), "effect"))

# Mixed hashes of k-mers, and reads of a mixture

_FACTORS = [f"{f}::UHUGEINT" for f in dna.FACTORS]


_CODE = "CAST(list_reduce(list_prepend(0::UBIGINT, list_transform(string_split({x}, ''), lambda c: CAST(instr('ACGT', c) - 1 AS UBIGINT))), lambda a, b: a * 4 + b) AS UBIGINT)"
_STEP = "SELECT id, {f} AS f, {b} AS b FROM ({t})"


def _mixed_sql() -> str:
    rows = f"SELECT id, {_CODE.format(x='x')} AS f, {_CODE.format(x='rx')} AS b FROM (SELECT id, x, reverse(translate(x, 'ACGT', 'TGCA')) AS rx FROM (SELECT id, substr(sequence, CAST(pos + 1 AS INTEGER), 15) AS x FROM (SELECT id, sequence, unnest(range(0, greatest(length(sequence) - 14, 0))) AS pos FROM reads)))"
    for i in range(3):
        rows = _STEP.format(**{c: f"xor({c}, {c} >> 33)" for c in ("f", "b")}, t=rows)
        if i < 2:
            rows = _STEP.format(**{c: f"CAST((CAST({c} AS UHUGEINT) * {_FACTORS[i]}) % 18446744073709551616::UHUGEINT AS UBIGINT)" for c in ("f", "b")}, t=rows)
    return f"{views('reads')} SELECT id, count(*) AS n, CAST(min(least(f, b)) AS VARCHAR) AS smallest, CAST(max(least(f, b)) AS VARCHAR) AS largest FROM ({rows}) GROUP BY id"


def _mixed_ends(s: SparkSession, d: str) -> DataFrame:
    text = F.lpad(F.conv(F.hex("hash"), 16, 10), 20, "0")
    ends = km.mixed_hashes(fx.reads(s, d), 15).groupBy("id").agg(F.count("*").alias("n"), F.min(text).alias("smallest"), F.max(text).alias("largest"))
    return ends.withColumns({c: F.regexp_replace(c, "^0+(?=.)", "") for c in ("smallest", "largest")})


query("km_05_mixed_hashes", _mixed_sql())(_mixed_ends)

_REFS = "refs AS (SELECT species, marker, max(sequence) AS sequence FROM (SELECT id % 6 AS species, id % 3 AS marker, sequence FROM seqs) GROUP BY ALL)"
_DRAW = "CAST(CAST('0x' || substr(md5('7:' || marker || ':' || n || ':{tag}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"


def _refs(s: SparkSession, d: str) -> DataFrame:
    return fx.seqs(s, d).groupBy((F.col("id") % 6).alias("species"), (F.col("id") % 3).alias("marker")).agg(F.max("sequence").alias("sequence"))


def _mixture(s: SparkSession, d: str) -> DataFrame:
    refs = _refs(s, d)
    species = refs.select("species").distinct()
    return si.mixture_reads(refs, species.selectExpr("species", "(species + 1) / 21D AS w"), 1000, 100, yields=species.selectExpr("species", "1 + species / 10D AS d"), bias=refs.selectExpr("species", "marker", "1 + marker / 5D - species / 20D AS b"), seed=7)


query(
    "sim_01_mixture_reads",
    f"""{views('seqs')}, {_REFS}, c AS (SELECT species, marker, sequence, sum(x) OVER (PARTITION BY marker ORDER BY species) / sum(x) OVER (PARTITION BY marker) AS c FROM (SELECT *, (species + 1) / 21.0 * (1 + species / 10.0) * (1 + marker / 5.0 - species / 20.0) AS x FROM refs)),
u AS (SELECT marker, n, {_DRAW.format(tag='s')} AS u, {_DRAW.format(tag='p')} AS p FROM (SELECT DISTINCT marker FROM refs) CROSS JOIN (SELECT unnest(range(0, 1000)) AS n)), k AS (SELECT u.marker, u.n, u.p, min(c.species) AS species FROM u JOIN c ON c.marker = u.marker AND u.u <= c.c GROUP BY ALL),
a AS (SELECT k.marker, k.n, k.species, sequence, CASE WHEN length(sequence) > 100 THEN CAST(floor(p * (length(sequence) - 100)) AS BIGINT) ELSE 0 END AS start FROM k JOIN refs USING (species, marker)) SELECT marker, n, species, start, substr(sequence, CAST(start + 1 AS INTEGER), 100) AS sequence FROM a""",
)(_mixture)

# A verdict that is left open

query("agg_26_verdict_open", f"{_unrolled(2)} SELECT CASE WHEN bool_or(species = 2 AND w >= 0.001) THEN 'INCONCLUSIVE' ELSE 'PASS' END AS verdict FROM p2")(
    lambda s, d: mx.verdict(_steps(s, d, 2)[1].select("species", "w").distinct(), s.createDataFrame([(1, "HALAL"), (2, "MASHBOOH")], "species int, status string"), 1.0, 100, 100)
)


query("agg_24_species_by_marker", f"""{views('cand')}, n AS (SELECT count(DISTINCT read_id) AS n FROM cand) SELECT species, count(*) FILTER (WHERE marker = 0) AS "0", count(*) FILTER (WHERE marker = 1) AS "1", count(*) FILTER (WHERE marker = 2) AS "2", 100.0 * count(*) / (SELECT n FROM n) AS read_pct FROM cand GROUP BY species""", "read_pct")(
    lambda s, d: mx.species_by_marker(fx.cand(s, d), [0, 1, 2])
)
query("agg_51_timings", "SELECT l_linenumber AS reads, count(*) AS n, avg(l_extendedprice / 1000) AS mean, stddev_samp(l_extendedprice / 1000) AS sd FROM lineitem GROUP BY 1", "mean sd")(
    lambda s, d: ev.timings(fx.table(s, d, "lineitem").selectExpr("l_linenumber AS reads", "l_extendedprice / 1000 AS seconds"), "reads")
)
query(
    "srt_04_top_specialists",
    f"""{views('dsp', 'meta')}, st AS (SELECT feature_id, grp, avg(value) AS v FROM dsp JOIN meta USING (sample_id) GROUP BY ALL), p AS (SELECT feature_id, v / nullif(sum(v) OVER (PARTITION BY feature_id), 0) AS p, count(*) OVER (PARTITION BY feature_id) AS c FROM st),
h AS (SELECT feature_id, round(1 + coalesce(sum(p * ln(p)) FILTER (WHERE p > 0), 0) / ln(max(c)), 9) AS score FROM p GROUP BY 1) SELECT feature_id, score, (SELECT count(*) FROM h WHERE score > 0.5) AS specialists, (SELECT count(*) FROM h WHERE score <= 0.5) AS generalists FROM h ORDER BY score DESC, feature_id LIMIT 15""",
    "score",
)(lambda s, d: co.specialists(co.specificity(co.group_stats(fx.lines(s, d), fx.meta(s, d), repeated=True)).select("feature_id", F.round("score", 9).alias("score"))))
query(
    "srt_08_first_carriers",
    f"""{views('genes', 'traits')} SELECT feature_id, feature_id * 7919 % 1000 AS position FROM (SELECT DISTINCT feature_id FROM genes JOIN traits USING (ko_id)) ORDER BY position, feature_id LIMIT 30""",
)(lambda s, d: fu.first_carriers(fu.trait_table(fx.genes(s, d), fx.traits(s, d)), fx.table(s, d, "part").selectExpr("p_partkey AS feature_id", "p_partkey * 7919 % 1000 AS position")))


# Streams: the benchmark's texts as reads, in as many batches as there are files


def _streamed(s: SparkSession, d: str) -> DataFrame:
    columns = fx.table(s, d, "benchmark").schema
    reads = s.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(f"{d}/benchmark.parquet*").select(F.col("item_id").alias("id"), dna.projected(F.col("text")).alias("sequence"))
    # The source is a table that is all there, so the index needs only the k-mers that its reads have.
    index = saved(km.met(_seqs_k(s, d), _reads_k(s, d)).join(fx.seqs(s, d).select("id", "species"), "id").select("species", "hash").distinct(), "index")
    return sc.latest(sc.counts(reads, index), ["id", "species"], "hashes", s)


query("str_01_distinct_hashes", f"{views('seqs_k', 'reads_k')}, i AS (SELECT DISTINCT species, hash FROM seqs_k JOIN seqs USING (id)) SELECT r.id, i.species, count(DISTINCT r.hash) AS hashes FROM reads_k r JOIN i USING (hash) GROUP BY ALL")(_streamed)
