import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamspark.functions import dna, graphs, special
from loamspark.operators import composition as co
from loamspark.operators import differential as di
from loamspark.operators import distances as ds
from loamspark.operators import functional as fu
from loamspark.operators import kmers as km
from loamspark.operators import mixture as mx
from loamspark.operators import network as nw
from loamspark.operators import ordination as od
from loamspark.operators import simulate as si
from loamspark.plans import catalog
from loamspark.sources import sequences, sinks, tabular

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    return "nan" if math.isnan(float(v)) else f"{float(v) + 0.0:.4f}"


@pytest.mark.parametrize("name", ["fil_01_normalize", "agg_05_alpha_diversity", "agg_16_all_tables", "st_02_jaccard", "gr_01_phi", "gr_12_roles", "jn_03_projection", "agg_18_redundancy", "km_13_coarse_query", "st_23_ellipse", "agg_34_totals"])
def test_queries_agree_with_sql(spark, small, oracle, name):
    df = catalog.QUERIES[name](spark, small)
    cur = oracle.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def ab(spark, rows):
    return spark.createDataFrame(rows, "feature_id string, sample_id string, value double")


def test_empty_and_zero_samples(spark):
    t = ab(spark, [("a", "s", 0.0), ("b", "s", 0.0), ("a", "t", 5.0)])
    got = {r.sample_id: tuple(r)[1:] for r in co.alpha_diversity(t).collect()}
    assert got == {"s": (0.0, 0.0, 0, 0.0), "t": (0.0, 0.0, 1, 0.0)}
    assert {(r.feature_id, r.sample_id): r.p for r in co.normalize(t).collect()} == {("a", "s"): 0.0, ("b", "s"): 0.0, ("a", "t"): 1.0}
    assert {(r.s1, r.s2): r.d for r in ds.bray_curtis(t).collect()} == {("s", "t"): 1.0}
    with pytest.raises(KeyError):
        co.subset_samples(t, ["t", "zzz"])
    with pytest.raises(KeyError):
        ds.permanova(ds.bray_curtis(t), spark.createDataFrame([("s", "g")], "sample_id string, grp string"), 3)
    with pytest.raises(ValueError):
        di.differential(t, spark.createDataFrame([("s", "g")], "sample_id string, grp string"), "g", "h")


def test_differential_counts_absent_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(2, (6, 10)).astype(float)
    x[0, :5] += 20
    rows = [(f"f{i}", f"s{j}", float(x[i, j])) for i in range(6) for j in range(10) if x[i, j]]
    meta = spark.createDataFrame([(f"s{j}", "a" if j < 5 else "b") for j in range(10)], "sample_id string, grp string")
    z = np.log(x + 1) - np.log(x + 1).mean(axis=0)
    got = {r.feature_id: r for r in di.differential_test(ab(spark, rows), meta, "a", "b").collect()}
    for i in range(6):
        a, b = z[i, :5], z[i, 5:]
        t = (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 5 + b.var(ddof=1) / 5)
        assert abs(got[f"f{i}"].t - t) < 1e-9 and abs(got[f"f{i}"].lfc - (a.mean() - b.mean())) < 1e-12
    assert got["f0"].p == min(r.p for r in got.values()) < 0.05
    assert all(r.q >= r.p for r in got.values())


def test_special_functions():
    assert abs(special.t_two_sided(2.0, 10.0) - 0.07338803477074037) < 1e-12
    assert abs(special.chi2_sf(3.841458820694124, 1.0) - 0.05) < 1e-12
    assert abs(special.chi2_sf(30.0, 4.0) - math.exp(-15) * 16) < 1e-15
    assert abs(special.norm_two_sided(1.959963984540054) - 0.05) < 1e-12
    assert abs(special.beta_ppf(0.5, 2.0, 2.0) - 0.5) < 1e-12


def test_exact_phi_and_networks(spark):
    rows = {"A": [10, 20, 30, 40], "B": [20, 40, 60, 80], "C": [5, 100, 3, 50]}
    t = ab(spark, [(f, f"s{j}", float(v)) for f, own in rows.items() for j, v in enumerate(own)])
    for r in nw.phi(t).collect():
        want = np.var(np.log((np.array(rows[r.src]) + 1) / (np.array(rows[r.dst]) + 1)), ddof=1)
        assert abs(r.phi - want) < 1e-10
    nodes = spark.createDataFrame([(f"M{i}",) for i in range(6)], "feature_id string")
    star = spark.createDataFrame([("M0", "M1", 0.1), ("M0", "M2", 0.2), ("M0", "M3", 0.15), ("M0", "M4", 0.18), ("M1", "M2", 0.25)], "src string, dst string, phi double")
    top = {r.feature_id: r for r in nw.topology(nodes, star).collect()}
    assert max(top, key=lambda k: top[k].betweenness) == "M0" and top["M5"].betweenness == 0 == top["M5"].closeness
    assert abs(top["M0"].betweenness - 5 / 10) < 1e-12 and abs(top["M0"].closeness - 4 / 4 * 4 / 5) < 1e-12
    assert {r.feature_id: r.degree for r in nw.degrees(nodes, star).collect()}["M0"] == 4
    none = star.limit(0)
    assert all(r.module == 0 and r.betweenness == 0 for r in nw.topology(nodes, none).collect())
    assert nw.modularity(none, nodes.withColumn("module", F.lit(0))).first()["q"] == 0


def test_greedy_modules_find_cliques():
    a, b = zip(*[(i, j) for c in (0, 5, 10) for i in range(c, c + 5) for j in range(i + 1, c + 5)], (4, 5), (9, 10))
    a, b = np.array(a), np.array(b)
    m = graphs.greedy_modules(15, a, b)
    assert len(set(m)) == 3 and all(len(set(m[c : c + 5])) == 1 for c in (0, 5, 10))
    x, y = graphs.rewire(a, b, np.random.default_rng(0))
    assert (np.bincount(np.append(a, b)) == np.bincount(np.append(x, y))).all() and graphs.modularity(15, x, y, m) < graphs.modularity(15, a, b, m)


def test_fisher(spark):
    t = spark.createDataFrame([(8, 2, 1, 5), (0, 0, 0, 0), (3, 1, 1, 3)], "a long, b long, c long, d long")
    got = {r.a: r.p for r in fu.fisher(t).collect()}
    assert abs(got[8] - 0.024475524475524476) < 1e-9 and abs(got[3] - 0.24285714285714285) < 1e-9 and got[0] == 1.0
    two = {r.a: r.p for r in fu.fisher(t, "two-sided").collect()}
    assert abs(two[8] - 0.034965034965034975) < 1e-9 and abs(two[3] - 0.4857142857142857) < 1e-9
    with pytest.raises(ValueError):
        fu.build("module", t)


def test_ordination(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (8, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y, part = od.principal(d, 2)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), d) and abs(part.sum() - 1) < 1e-9
    assert od.scaled(d)[1] < 0.01
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(8) for j in range(i + 1, 8)], "s1 int, s2 int, d double")
    assert od.pcoa(pairs).count() == 16 and od.nmds(pairs).count() == 16
    meta = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(8)], "sample_id int, grp string")
    r = od.permdisp(pairs, meta, 9).first()
    assert r.f >= 0 and 0.1 <= r.p <= 1
    assert od.isotonic(np.array([3.0, 1, 2, 5])).tolist() == [2, 2, 2, 5]


def test_kmers_and_primers(spark):
    s = spark.createDataFrame([("x", "ACGTN" + "ACGTTGCA" * 60), ("y", "AC"), ("z", None)], "id string, sequence string")
    seq = "ACGTN" + "ACGTTGCA" * 60
    got = sorted((r.pos, r.hash) for r in km.hashes(s, 5).collect())
    import hashlib

    want = []
    for i in range(len(seq) - 4):
        w = seq[i : i + 5]
        if "N" not in w:
            c = min(w, dna.revcomp_text(w))
            want.append((i, hashlib.md5((42).to_bytes(8, "little") + c.encode()).digest()[:8][::-1].hex()))
    assert got == want
    amp = km.amplicons(spark.createDataFrame([("a", "TT" + "ACGTAA" + "C" * 60 + "GGATTC" + "TT")], "id string, sequence string"), "ACGTAR", dna.revcomp_text("GGATTC"), 0).collect()
    assert [(r.start, r.end, r.strand) for r in amp] == [(2, 74, "+")]
    with pytest.raises(ValueError):
        dna.below(0)


def test_mixture_recovers_weights(spark):
    rng = np.random.default_rng(42)
    rows = []
    for r in range(1500):
        true = 0 if rng.random() < 0.7 else 1
        for sp in (0, 1):
            rows.append((r, r % 3, sp, 0.8 + 0.2 * rng.random() if sp == true else 0.2 * rng.random()))
    c = spark.createDataFrame(rows, "read_id long, marker int, species int, containment double").cache()
    params, ll, steps = mx.fit(c, max_iter=15)
    w = {r.species: r.w for r in params.collect()}
    assert abs(w[0] - 0.7) < 0.1 and abs(sum(w.values()) - 1) < 1e-9 and ll < 0 and steps <= 15
    lrt = {r.species: r.lrt for r in mx.likelihood_ratio(c, params).collect()}
    assert lrt[0] > 100 and lrt[1] > 100
    status = spark.createDataFrame([(0, "HALAL"), (1, "HARAM")], "species int, status string")
    weights = params.select("species", "w").distinct()
    assert mx.verdict(weights, status, 1.0, 1500, 1500).first()[0] == "FAIL"
    assert mx.verdict(weights.where("species = 0"), status, 1.0, 1500, 1500).first()[0] == "PASS"
    assert mx.verdict(weights.where("species = 0"), status, 0.3, 1500, 1500).first()[0] == "INCONCLUSIVE"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "ab.tsv").write_text("id\ts1\ts2\nf1\t100\t200\nf2\t300\t800\n\t1\t1\n")
    t = tabular.abundance(spark, str(tmp_path / "ab.tsv"))
    assert sorted(map(tuple, t.collect())) == [("f1", "s1", 100.0), ("f1", "s2", 200.0), ("f2", "s1", 300.0), ("f2", "s2", 800.0)]
    (tmp_path / "tax.tsv").write_text("mag_id\tphylum\tgenus\nf1\tP\t\nf2\t\tG\n")
    assert {r.feature_id: (r.phylum, r.genus, r.species) for r in tabular.taxonomy(spark, str(tmp_path / "tax.tsv")).collect()} == {"f1": ("P", "", ""), "f2": ("", "G", "")}
    (tmp_path / "genes.tsv").write_text("\tko_id\tcazy_hits\nM.1_k141_5\tK1\t\nM_2_00001\t\tGH13\n")
    assert sorted((r.feature_id, r.ko_id, r.cazy_id) for r in tabular.annotations(spark, str(tmp_path / "genes.tsv")).collect()) == [("M_1", "K1", None), ("M_2", None, "GH13")]
    (tmp_path / "Bos_taurus_COI.fa").write_text(">r1 first\nACGT\nacg\n>r2\nTT\n")
    assert sorted((r.species, r.marker, r.sequence) for r in sequences.fasta_directory(spark, str(tmp_path / "Bos_taurus_COI.fa")).collect()) == [("Bos_taurus", "COI", "ACGTACG"), ("Bos_taurus", "COI", "TT")]
    reads = spark.createDataFrame([("q", "ACGT", "IIII"), ("w", "AC", "##")], "read_id string, sequence string, quality string").coalesce(1)
    sequences.write_fastq(reads, str(tmp_path / "fq"))
    assert sorted(map(tuple, sequences.fastq(spark, str(tmp_path / "fq")).collect())) == sorted(map(tuple, reads.collect()))
    sinks.matrix(t, str(tmp_path / "m"), "feature_id", "sample_id", "value", 2)
    assert spark.read.csv(str(tmp_path / "m"), header=True).where("feature_id = 'f2'").first()["s2"] == "800.00"
    sim = si.reads(spark.createDataFrame([("x", "ACGT" * 50)], "id string, sequence string"), 5, 20, 0.0).collect()
    assert len(sim) == 5 and all(r.sequence in "ACGT" * 50 and r.errors == 0 for r in sim)
    assert si.composition("a:0.7, b:0.3,c") == {"a": 0.7, "b": 0.3}


def test_entry_without_the_corpus_part(spark, monkeypatch):
    import sys

    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = set(entry.queries())
    assert "agg_05_alpha_diversity" in names and not any(n.startswith("op") for n in names)


def test_group_stats_of_repeated_cells_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(co, "ROWS", 100)
    rng = np.random.default_rng(4)
    rows = [(f"f{a}", int(b), float(c)) for a, b, c in zip(rng.integers(0, 30, 1500), rng.integers(0, 20, 1500), rng.integers(0, 3, 1500), strict=True)] + [("alone", 99, 2.0), ("f1", 0, None)]
    meta = {b: (None if b == 7 else f"g{b % 3}") for b in [*range(18), 500]}
    table, groups = spark.createDataFrame(rows, "feature_id string, sample_id int, value double"), spark.createDataFrame(list(meta.items()), "sample_id int, grp string")
    cells = {}
    for f, b, v in rows:
        cells[f, b] = cells.get((f, b), 0.0) + (v or 0.0)
    own = {g: [b for b in meta if meta[b] == g and any(x == b for _, x, _ in rows)] for g in set(meta.values())}
    want = {(f, g): (sum(cells.get((f, b), 0.0) for b in own[g]) / len(own[g]), sum(cells.get((f, b), 0.0) > 0 for b in own[g]) / len(own[g])) for f in {f for f, _, _ in rows} for g in own if g}
    for limit in (500_000, 0):
        monkeypatch.setattr(co, "BROADCAST", limit)
        for stats in (co.group_stats(table, groups, repeated=True), co.group_stats(table.groupBy("feature_id", "sample_id").agg(F.sum("value").alias("value")), groups)):
            got = {(r.feature_id, r.grp): (r.mean_value, r.prevalence) for r in stats.collect() if r.grp}
            assert sorted(got) == sorted(k for k in want if k[1]) and all(got[k] == pytest.approx(want[k]) for k in got)
    assert co.summed(table).rdd.getNumPartitions() == 16


def test_group_stats_queries_deal_cells_out_by_their_number(spark, small, monkeypatch):
    monkeypatch.setattr(co, "ROWS", 500)
    seen = []
    monkeypatch.setattr(co, "summed", lambda table, f=co.summed: seen.append(f(table).rdd.getNumPartitions()) or f(table))
    assert catalog.QUERIES["agg_08_group_means"](spark, small).count() and seen[0] >= spark.read.parquet(f"{small}/lineitem.parquet").count() / 500
