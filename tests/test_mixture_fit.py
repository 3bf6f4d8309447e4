import math

import numpy as np
import pytest

from loamspark.operators import mixture as mx
from loamspark.plans import fixtures

SCHEMA = "read_id long, marker int, species int, containment double"


def rows(n=400, species=3, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for r in range(n):
        for sp in rng.choice(species, rng.integers(1, species + 1), replace=False):
            out.append((r, r % 2, int(sp), float(rng.choice([0.1, 0.5, 0.9]))))
    return out


def plain(data, steps, species=3, markers=2):
    """The same steps read by read."""
    w, d, b = np.full(species, 1 / species), np.ones(species), np.ones((species, markers))
    reads = {}
    for r, m, s, c in data:
        reads.setdefault(r, []).append((m, s, c))
    for _ in range(steps + 1):
        g, count, ll, seen = np.zeros((species, markers)), np.zeros((species, markers)), 0.0, np.zeros(markers)
        for own in reads.values():
            x = np.array([w[s] * d[s] * b[s, m] * c for m, s, c in own])
            ll += math.log(x.sum())
            seen[own[0][0]] += 1
            for (m, s, _), v in zip(own, x / x.sum(), strict=True):
                g[s, m] += v
                count[s, m] += 1
        last = (w.copy(), d.copy(), b.copy(), ll)
        w = np.maximum(g.sum(1) - 0.5, 1e-10)
        w /= w.sum()
        den, eff = (w[:, None] * b * count).sum(1), np.maximum(g.sum(1), 1)
        d = np.exp(eff * np.log(g.sum(1) / den) / (eff + 4))
        d /= np.exp(np.log(d).mean())
        each = np.maximum(g, 1)
        b = np.exp(each * np.log(np.maximum(g / (w * d)[:, None] / seen, 1e-10)) / (each + 4))
        b /= np.exp(np.log(b).mean(1))[:, None]
    return last


def test_profiles_give_the_steps_of_single_reads(spark):
    data = rows()
    c = spark.createDataFrame(data, SCHEMA)
    made = mx.profiles(c)
    assert made.select("read_id").distinct().count() < 400 and made.select("read_id", "reads").distinct().groupBy().sum("reads").first()[0] == 400
    w, d, b, ll = plain(data, 4)
    for source in (c, made):
        params, got, steps = mx.fit(source, max_iter=4, tolerance=0.0, restarts=1)
        assert steps == 4 and got == pytest.approx(ll, rel=1e-9)
        for r in params.collect():
            assert (r.w, r.d, r.b) == pytest.approx((w[r.species], d[r.species], b[r.species, r.marker]), rel=1e-9)


def test_small_products_do_not_vanish(spark):
    c = spark.createDataFrame([(1, 0, 0, 1e-250), (1, 0, 1, 1e-250), (2, 0, 0, 1.0), (2, 1, 1, 1.0)], SCHEMA)
    params = spark.createDataFrame([(s, m, 0.5, 1e-60, 1e-60) for s in (0, 1) for m in (0, 1)], "species int, marker int, w double, d double, b double")
    got = {(r.read_id, r.species): r for r in mx.responsibilities(c, params).collect()}
    assert got[1, 0].gamma == pytest.approx(0.5) and got[1, 0].ll == pytest.approx(math.log(1e-250) + 2 * math.log(1e-60))


def test_restarts_are_repeatable_and_the_best_is_kept(spark):
    c = spark.createDataFrame(rows(), SCHEMA)
    begin = mx.starts(mx.uniform(c).toPandas(), 3)
    assert begin.equals(mx.starts(mx.uniform(c).toPandas(), 3)) and sorted(begin["run"].unique()) == [0, 1, 2]
    for _, own in begin.groupby("run"):
        assert own.drop_duplicates("species")["w"].sum() == pytest.approx(1)
    done = mx.fit_runs(c, begin)[1]
    params, ll, steps = mx.fit(c)
    assert ll == pytest.approx(done["ll"].max()) and done["converged"].all() and steps <= 200
    assert mx.fit_runs(c, begin, max_iter=2)[1]["converged"].tolist() == [False] * 3


def test_refits_without_a_species(spark):
    data = [(r, r % 2, 0, 0.9) for r in range(60)] + [(r, r % 2, 1, 0.2) for r in range(60)] + [(r, r % 2, 1, 0.8) for r in range(60, 100)]
    c = spark.createDataFrame(data, SCHEMA)
    params, ll, _ = mx.fit(c, restarts=1)
    got = {r.species: r for r in mx.ratio_p(mx.refit_ratio(c, params, ll)).collect()}
    assert got[0].lrt > 10 and got[0].p < 0.01
    # Without 1 its own 40 reads drop out, and the other 60 are explained by 0 alone: the ratio is not positive.
    assert got[1].lrt == 0 and got[1].p == 1
    one = c.where("species = 0")
    only = mx.fit(one, restarts=1)
    alone = mx.ratio_p(mx.refit_ratio(one, only[0], only[1])).first()
    assert alone.lrt == math.inf and alone.p == 0


def test_degradation_and_one_marker(spark):
    c = spark.createDataFrame(rows(), SCHEMA)
    lengths = spark.createDataFrame([(s, m, 100 + 50 * s) for s in range(3) for m in range(2)], "species int, marker int, length int")
    params, ll, _ = mx.fit(c, lengths=lengths, degradation=True, restarts=1, max_iter=3, tolerance=0.0)
    assert ll < 0 and params.count() == 6
    one = c.where("marker = 0")
    mito = spark.createDataFrame([(0, 100.0), (1, 400.0), (2, 200.0)], "species int, mito_cn double")
    d = {r.species: r.d for r in mx.fit(one, mito=mito)[0].collect()}
    assert d == pytest.approx({0: 0.5, 1: 2.0, 2: 1.0})


def test_bic_counts_weights_yields_biases_and_the_rate():
    assert mx.bic(-10.0, 3, 2, 100) == pytest.approx(20 + (2 + 3 + 6) * math.log(100))
    assert mx.bic(-10.0, 3, 2, 100, True) == pytest.approx(20 + 12 * math.log(100))


def test_no_candidates(spark):
    params, ll, steps = mx.fit(spark.createDataFrame([], SCHEMA))
    assert params.count() == 0 and ll == 0 and steps == 0


def test_narrowing_finds_peaks_and_ends():
    peaks = {"a": 0.03123456, "b": 1e-6, "c": 0.1, "d": 0.07}
    asked = []

    def values(trials):
        asked.append(len(trials))
        return np.array([-((x - peaks[r]) ** 2) for r, x in zip(trials["run"], trials["rate"], strict=True)])

    found = mx.narrowed(values, list(peaks), 1e-6, 0.1).set_index("run")["rate"]
    assert {r: found[r] for r in peaks} == pytest.approx(peaks, abs=1e-7)
    assert len(asked) <= 10 and asked[0] == 4 * 17


def test_likeliest_rates_of_several_runs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, m, s, float(rng.uniform(0.3, 1))) for i in range(80) for m in (i % 2,) for s in range(3)]
    cand = spark.createDataFrame(rows, "read_id int, marker int, species int, containment double")
    lengths = spark.createDataFrame([(s, m, 50 * (s + 1) * (m + 1)) for s in range(3) for m in range(2)], "species int, marker int, length int")
    params = spark.createDataFrame([(run, s, m, (0.2, 0.3, 0.5)[(s + run) % 3], 1.0, 1.0) for run in (0, 1) for s in range(3) for m in range(2)], "run int, species int, marker int, w double, d double, b double")

    def ll(run, rate):
        reads = {}
        for i, m, s, c in rows:
            reads[i] = reads.get(i, 0) + (0.2, 0.3, 0.5)[(s + run) % 3] * np.exp(-rate * 50 * (s + 1) * (m + 1)) * c
        return sum(np.log(v) for v in reads.values())

    found = mx.likelihood_rates(cand, params, lengths, tolerance=1e-4).set_index("run")
    for run in (0, 1):
        grid = np.linspace(1e-6, 0.1, 50)
        assert found.loc[run, "rate"] == pytest.approx(max(grid, key=lambda x: ll(run, x)), abs=1e-4)
        assert found.loc[run, "ll"] == pytest.approx(ll(run, found.loc[run, "rate"]), rel=1e-12)


def test_profiles_of_the_tables_deal_candidates_by_read_once(spark, small):
    plan = mx.profiles(fixtures.cand(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(read_id") == 1 and "Exchange hashpartitioning(read_id" in plan and plan.count("Exchange ") == 2
