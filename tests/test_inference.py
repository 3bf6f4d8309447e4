import numpy as np
import pytest
from pyspark.sql import functions as F

from loamspark.functions.frames import sql
from loamspark.operators import functional as fu
from loamspark.operators import joint as jt
from loamspark.operators import markers as mk
from loamspark.operators import network as nw
from loamspark.operators import strains as st

CAND = "read_id int, strain string, gene string, containment double"


def sequence(seed, n):
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), n))


def test_sql_keeps_cached_data(spark):
    cached = spark.range(10).cache()
    cached.count()
    out = sql("WITH x AS (SELECT id FROM {t} WHERE id >= {m}) SELECT count(*) AS n FROM x", t=cached, m=4)
    assert "InMemory" in out._jdf.queryExecution().withCachedData().toString()
    assert out.first().n == 6
    assert cached.storageLevel.useMemory
    cached.unpersist()


def test_marker_is_detected_or_fixed_by_the_first_species(spark):
    a, b, c = sequence(1, 200), sequence(2, 200), sequence(3, 200)
    refs = spark.createDataFrame([(0, 0, a), (1, 1, a), (1, 0, b), (2, 1, b + c), (3, 0, None)], "species int, marker int, sequence string")
    primers = spark.createDataFrame([(0, c[:40]), (1, "ACG")], "marker int, sequence string")
    index = mk.build(refs, primers, scale=1.0)
    rows = [("fixed", a[:100]), ("known", c[:40] + b[:60]), ("long", b[50:150]), ("none", sequence(9, 100)), ("short", "ACGT"), ("null", None)]
    reads = spark.createDataFrame(rows, "id string, sequence string")
    got = {(r.id, r.marker, r.species): round(r.containment, 2) for r in mk.classify(reads, index).collect()}
    assert got == {("fixed", 0, 0): 1.0, ("known", 0, 1): 0.5, ("long", 0, 1): 1.0}
    each = {(r.id, r.marker, r.species) for r in mk.classify(reads, index, one_marker=False).collect()}
    assert {("fixed", 0, 0), ("fixed", 1, 1), ("long", 0, 1), ("long", 1, 2)} <= each
    totals = {(r.kind, r.key): r.n for r in mk.summary(reads, mk.classify(reads, index)).collect()}
    assert totals[("total", None)] == 6 and totals[("classified", None)] == 3 and totals[("species", 1)] == 2


def brute_shares(rows, pi, phi, mobile, genes):
    """Sums of shares, read by read."""
    g, pool, ll = {}, 0.0, 0.0
    for read in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == read]
        best = {}
        for _, s, k, c in own:
            best[s] = max(best.get(s, 0.0), pi[s] * c * (phi[s, k] if k else 1.0))
        m = mobile * 0.5 * np.mean([r[3] for r in own]) / genes
        total = sum(best.values()) + m
        ll += np.log(total)
        pool += m / total
        for _, s, k, _ in own:
            g[s, k] = g.get((s, k), 0.0) + best[s] / total
    return g, pool, ll


def test_shares_match_brute_force_with_repeated_strains(spark):
    rows = [(1, "a", "g", 0.9), (1, "a", "h", 0.4), (1, "b", None, 0.5), (2, "b", "g", 0.7), (3, "a", None, 0.2), (4, "b", "g", 0.7), (5, "a", "g", 0.01)]
    kept = jt.profiles(spark.createDataFrame(rows, CAND)).cache()
    assert kept.agg(F.max("reads")).first()[0] == 2
    run = jt.Run("r", seed=3)
    params, mobile = jt.start(jt.cells(kept), [run], jt.Settings())
    sums = jt.expected(kept, *jt.tables(kept, params, mobile, 2)).collect()
    phi = {(r.strain, r.gene): r.phi for r in params.itertuples()}
    g, pool, ll = brute_shares([r for r in rows if r[3] >= 0.05], dict(zip(params["strain"], params["pi"], strict=True)), phi, mobile["r"], 2)
    assert {(r.strain, r.gene): r.g for r in sums} == pytest.approx(g)
    assert (sum(r.m for r in sums), sum(r.ll for r in sums), sum(r.reads for r in sums)) == pytest.approx((pool, ll, 4))
    kept.unpersist()


def test_joint_fit_of_planted_weights_and_of_nothing(spark):
    # Genes tell nothing here, so a's weight is the fixed point of the mean share of three reads in four that favour it nine to one.
    pi, rows = 0.5, []
    for _ in range(200):
        pi = 0.75 * 9 * pi / (9 * pi + 1 - pi) + 0.25 * pi / (pi + 9 * (1 - pi))
    for i in range(600):
        s, o = ("a", "b") if i % 4 else ("b", "a")
        rows += [(i, s, f"g{i % 3}", 0.9), (i, o, f"g{i % 3}", 0.1)]
    found = {r.strain: r for r in jt.fit(spark.createDataFrame(rows, CAND), 2, jt.Settings(mobile=False, max_iter=30)).collect()}
    assert found["a"].pi == pytest.approx(pi, abs=0.01) and found["a"].lo < found["a"].pi < found["a"].hi
    assert found["a"].phi_lo < found["a"].phi_hi
    assert jt.fit(spark.createDataFrame([], CAND), 2).count() == 0
    chosen = {r.k: r.chosen for r in jt.select_strains(spark.createDataFrame(rows, CAND), jt.Settings(max_iter=4)).collect()}
    assert sum(chosen.values()) == 1


def test_simulated_strains_and_reads(spark):
    s = st.Scenario(strains=3, genome_length=6000, genes=4, gene_length=500, reads=400, error=0.0, hidden=0.34, abundances=(1, 1, 2))
    made = st.simulate(spark, s)
    genomes = {r.strain: r.sequence for r in made["genomes"].collect()}
    truth = {r.read_id: r for r in made["truth"].collect()}
    reads = {r.read_id: r for r in made["reads"].collect()}
    genes = sorted((r.start, r.gene, r.end, r.strain) for r in made["genes"].collect())
    assert len(truth) == len(reads) == 400 and made["references"].count() == 2
    for i, t in truth.items():
        circular = genomes[t.strain] + genomes[t.strain][:150]
        assert reads[i].sequence == circular[t.start : t.start + 150] and len(reads[i].quality) == 150
        assert t.gene == next((g for at, g, end, strain in genes if strain == t.strain and t.start < end and t.start + 150 > at), None)
    assert sum(t.strain == "strain_002" for t in truth.values()) / 400 == pytest.approx(0.5, abs=0.1)
    flawed = st.with_errors(made["reads"].select("read_id", "sequence"), 0.05).collect()
    assert all(len(r.sequence) == len(r.quality) for r in flawed) and any(r.sequence != reads[r.read_id].sequence for r in flawed)
    assert sorted(map(tuple, flawed)) == sorted(map(tuple, st.with_errors(made["reads"].select("read_id", "sequence").repartition(3), 0.05).collect()))
    with pytest.raises(ValueError):
        st.weights(st.Scenario(strains=2, abundances=(1.0,)))


def test_no_division_by_zero(spark):
    counts = spark.createDataFrame([("t", "g1", 0, 5), ("t", "g2", 0, 4), ("u", "g1", 3, 2), ("u", "g2", 1, 3)], "trait string, grp string, carriers long, others long")
    found = {r.trait: r.chi2 for r in fu.trait_chi2(counts).collect()}
    assert found["t"] is None and found["u"] > 0
    one = spark.createDataFrame([("a", "s", 1.0), ("b", "s", 2.0)], "feature_id string, sample_id string, value double")
    assert [r.phi for r in nw.phi(one).collect()] == [None]


def test_overlapped_genes_are_the_first_of_all_pairs_without_a_join(spark):
    rng = np.random.default_rng(8)
    reads = [(f"r{i:03d}", f"s{i % 3}", int(x)) for i, x in enumerate(rng.integers(0, 2500, 300))] + [("r000", "s0", 7), ("r000", "s0", 7), ("alone", "s9", 5), ("none", None, 5)]
    genes = [(f"s{i % 3}", f"g{rng.integers(40)}", int(x), int(x + rng.choice([0, 1, 80, 3000]))) for i, x in enumerate(rng.integers(0, 2500, 40))] + [("s0", None, 0, 9000), (None, "g0", 0, 9000)]
    made = spark.createDataFrame(reads, "read_id string, strain string, start int").repartition(3), spark.createDataFrame(genes, "strain string, gene string, start int, `end` int")
    for length, bins in ((100, 1000), (100, 64), (1, 10)):
        want = {(r, s, at, min([(x, g) for t, g, x, end in genes if t == s and t and g and at < end and at + length > x], default=(0, None))[1]) for r, s, at in reads}
        got = st.with_genes(*made, length, bins)
        assert got.dtypes == [("read_id", "string"), ("strain", "string"), ("start", "int"), ("gene", "string")]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and {g for *_, g in want} != {None}
    assert "Join" not in st.with_genes(*made, 100)._jdf.queryExecution().executedPlan().toString()


def _flawed_alone(raw, rate, rng):
    """A read with errors by the definition, each step on this read alone."""
    n, letters = len(raw), np.frombuffer(b"ACGT", np.uint8)
    at = rate * (0.5 + np.arange(n) / max(n - 1, 1)) if n > 1 else np.full(n, rate)
    kind = np.where(rng.random(n) < at, 1 + np.searchsorted([0.9, 0.95], rng.random(n), side="right"), 0)
    base, place = raw.copy(), np.repeat(np.arange(n), np.where(kind == 2, 2, np.where(kind == 3, 0, 1)))
    swap = kind == 1
    base[swap] = letters[(np.searchsorted(letters, base[swap]) + rng.integers(1, 4, int(swap.sum()))) % 4]
    added = (kind[place] == 2) & np.r_[True, place[1:] != place[:-1]][: len(place)]
    out = base[place]
    out[added] = letters[rng.integers(0, 4, int(added.sum()))]
    q = -10 * np.log10(np.maximum(at[place], 1e-9)) + rng.normal(0, 2.0, len(place)) - np.where(added | swap[place], rng.uniform(5, 15, len(place)), 0.0)
    return out.tobytes(), (np.clip(np.rint(q), 2, 41).astype(np.uint8) + 33).tobytes()


def test_reads_that_get_errors_at_once_are_those_of_each_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACGTN"), n)) for n in rng.choice([0, 1, 2, 50, 100, 100, 900], 120)]
    ids = ["", "é", *(str(x) for x in rng.integers(0, 10**9, 118))]
    for rate, seed in ((0.005, 42), (0.3, 0), (0.9, 2**40 + 5), (0.0, 1)):
        want = [_flawed_alone(np.frombuffer(t.encode(), np.uint8), rate, np.random.default_rng([seed, *i.encode()])) for i, t in zip(ids, texts, strict=True)]
        assert list(zip(*st._flawed(ids, [t.encode() for t in texts], rate, seed), strict=True)) == want
        rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "read_id string, sequence string").repartition(2)
        assert sorted(map(tuple, st.with_errors(rows, rate, seed).collect())) == sorted((i, a.decode(), b.decode()) for i, (a, b) in zip(ids, want, strict=True))
