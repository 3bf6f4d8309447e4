import itertools
import math

import numpy as np
import pytest

from loamspark.functions import special
from loamspark.operators import differential as di
from loamspark.operators import evaluation as ev
from loamspark.operators import kmers as km
from loamspark.operators import network as nw
from loamspark.operators import simulate as si
from loamspark.operators import summaries as su


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (2, 3), (4, 4), (3, 6), (1, 7)])
def test_exact_mann_whitney_against_all_orders(n1, n2):
    us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        far = max(u, n1 * n2 - u)
        assert special.mann_whitney_exact(u, n1, n2) == pytest.approx(min(1.0, 2 * sum(x >= far for x in us) / len(us)))


def test_mann_whitney_exact_normal_and_equal(spark):
    rows = [("m", "a", float(i)) for i in range(3)] + [("m", "b", 10.0 + i) for i in range(3)] + [("t", "a", 1.0), ("t", "a", 2.0), ("t", "b", 2.0), ("t", "b", 3.0), ("e", "a", 1.0), ("e", "b", 1.0), ("e", "b", None)]
    got = {r.k: r for r in di.mann_whitney_test(spark.createDataFrame(rows, "k string, grp string, value double"), "k").collect()}
    assert got["m"].u == 0 and got["m"].p == pytest.approx(0.1)
    assert got["t"].p == pytest.approx(float(special.norm_two_sided(np.array([got["t"].z]))[0])) and got["e"].p == 1.0 and (got["e"].n1, got["e"].n2) == (1, 1)


def test_alpha_tests_only_where_groups_differ(spark):
    alpha = spark.createDataFrame([(i, (1.0 if i < 8 else 3.0) + i / 100, 0.5, 10, 0.9) for i in range(16)], "sample_id long, shannon double, simpson double, richness long, evenness double")
    meta = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(16)], "sample_id long, grp string")
    got = di.alpha_tests(alpha, meta).collect()
    assert [(r.measure, r.g1, r.g2, r.u, r.stars) for r in got] == [("shannon", "a", "b", 0.0, "***")]
    assert got[0].p == pytest.approx(2 / math.comb(16, 8))


def test_group_phi_counts_absent_features(spark):
    t = spark.createDataFrame([("x", 1, 2.0), ("y", 1, 4.0), ("x", 2, 1.0), ("z", 3, 5.0), ("x", 4, 3.0)], "feature_id string, sample_id long, value double")
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "sample_id long, grp string")
    got = {(r.grp, r.src, r.dst): r.phi for r in nw.phi_by_group(t, m).collect()}
    dense = {"a": {"x": [2, 1], "y": [4, 0], "z": [0, 0]}, "b": {"x": [0, 3], "y": [0, 0], "z": [5, 0]}}
    assert set(got) == {(g, a, b) for g in "ab" for a, b in (("x", "y"), ("x", "z"), ("y", "z"))}
    for (g, a, b), phi in got.items():
        assert phi == pytest.approx(np.var(np.log1p(dense[g][a]) - np.log1p(dense[g][b]), ddof=1))
    assert {r.grp for r in nw.phi_by_group(t, m, 0.9).collect()} == set()


def test_sensitivity_modules_of_two_triangles(spark):
    near = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]
    pairs = [(a, b, 0.1 if (a, b) in near else 1.0) for a, b in itertools.combinations("abcxyz", 2)]
    got = nw.sensitivity_modules(spark.createDataFrame(pairs, "src string, dst string, phi double"), [10.0, 100.0]).orderBy("percentile").collect()
    assert (got[0].edges, got[0].modules) == (6, 2) and got[0].modularity == pytest.approx(0.5) and got[1].edges == 15


def test_estimates_with_missing_species(spark):
    e = spark.createDataFrame([("s", "pig", 0.4), ("s", "ox", 0.6)], "sample_id string, species string, est_w double")
    t = spark.createDataFrame([("s", "pig", 0.5), ("s", "hen", 0.5), ("s", "dog", 0.0), ("q", "ox", 1.0)], "sample_id string, species string, true_w double")
    got = {(r.sample_id, r.species): (r.true_w, r.est_w) for r in ev.with_missing(e, t).collect()}
    assert got == {("s", "pig"): (0.5, 0.4), ("s", "ox"): (0.0, 0.6), ("s", "hen"): (0.5, 0.0), ("q", "ox"): (1.0, 0.0)}


def test_metrics_without_rows_or_spread(spark):
    schema = "experiment string, mode string, true_w double, est_w double"
    got = ev.mode_metrics(spark.createDataFrame([("x", "m", 0.5, 0.5), ("x", "m", 0.5, 0.5), ("y", "m", 0.0, 0.0)], schema))
    rows = {r.experiment: r for r in got.collect()}
    assert rows["x"].r2 == 1 and rows["x"].specificity is None and rows["y"].n == 0 and rows["y"].mae is None and rows["all"].f1 == 1
    assert ev.mode_metrics(spark.createDataFrame([], schema)).count() == 0
    none = ev.mobile_metrics(spark.createDataFrame([(1, False)], "read_id long, is_mobile boolean"), spark.createDataFrame([], "read_id long")).first()
    assert (none.tp, none.fp, none.fn, none.f1) == (0, 0, 0, 0.0)
    assert su.breakdown_text(spark.createDataFrame([], "taxon string, n long, share double")).count() == 0


def mixed(text):
    x = 0
    for c in text:
        x = (x << 2 | "ACGT".index(c)) & (2**64 - 1)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ x >> 33) * factor) & (2**64 - 1)
    return x ^ x >> 33


@pytest.mark.parametrize("k", [1, 15, 31, 32])
def test_mixed_hashes_against_whole_numbers(spark, k):
    rng = np.random.default_rng(k)
    s = "".join(rng.choice(list("ACGT"), 300)) + "N" + "T" * 40
    back = str.maketrans("ACGT", "TGCA")
    want = [(i, min(mixed(w), mixed(w.translate(back)[::-1]))) for i in range(len(s) - k + 1) if "N" not in (w := s[i : i + k])]
    rows = spark.createDataFrame([("r", s), ("short", ""), ("none", None)], "id string, sequence string")
    assert sorted((r.pos, r.hash & (2**64 - 1)) for r in km.mixed_hashes(rows, k).collect()) == want
    with pytest.raises(ValueError):
        km.mixed_hashes(rows, 33)


def test_mixture_reads_follow_weights_and_errors(spark):
    rng = np.random.default_rng(3)
    text = {(s, m): "".join(rng.choice(list("ACGT"), 60 if s == "ox" else 30)) for s in ("ox", "pig", "hen") for m in (0, 1)}
    refs = spark.createDataFrame([(s, m, t) for (s, m), t in text.items() if (s, m) != ("hen", 1)], "species string, marker int, sequence string")
    w = spark.createDataFrame([("ox", 0.5), ("pig", 0.5), ("hen", 0.0), ("elk", 1.0)], "species string, w double")
    d = spark.createDataFrame([("ox", 3.0)], "species string, d double")
    rows = si.mixture_reads(refs, w, 2000, 40, yields=d).collect()
    assert len(rows) == 4000 and {r.species for r in rows} == {"ox", "pig"}
    assert abs(sum(r.species == "ox" for r in rows) / 4000 - 0.75) < 0.03
    assert all(r.sequence == text[r.species, r.marker][r.start : r.start + 40] for r in rows) and all(r.start == 0 for r in rows if r.species == "pig")
    wrong = si.mixture_reads(refs, w, 2000, 40, error=0.1, yields=d).collect()
    assert [(r.marker, r.n, r.species, r.start) for r in wrong] == [(r.marker, r.n, r.species, r.start) for r in rows]
    changed = sum(a != b for r, o in zip(wrong, rows, strict=True) for a, b in zip(r.sequence, o.sequence, strict=True))
    assert abs(changed / sum(len(r.sequence) for r in rows) - 0.1) < 0.01 and set("".join(r.sequence for r in wrong)) == set("ACGT")
    assert si.known({"ox": 0.5, "yak": 0.5}, {"ox"}) == ({"ox": 0.5}, ["yak"])


def test_false_discovery_rates_of_ties_nulls_and_groups(spark):
    from loamspark.operators import composition as co

    rng = np.random.default_rng(5)
    ps = [None if x < 0.05 else 1.0 if x < 0.4 else 0.0 if x < 0.42 else float(rng.random() ** 6) for x in rng.random(400)]
    rows = [(i, "a" if i % 3 else None, p) for i, p in enumerate(ps)]
    table = spark.createDataFrame(rows, "i long, g string, p double")

    def plain(own):
        known = sorted((p, i) for i, p in own if p is not None)
        q, least = {i: None for i, _ in own}, 1.0
        for rank in range(len(known), 0, -1):
            least = min(least, known[rank - 1][0] * len(own) / rank)
            q[known[rank - 1][1]] = least
        return q

    got = {r.i: r.q for r in co.benjamini_hochberg(table).collect()}
    assert len(got) == 400 and got == pytest.approx(plain([(i, p) for i, _, p in rows]), nan_ok=True)
    want = {}
    for g in ("a", None):
        want |= plain([(i, p) for i, own, p in rows if own == g])
    assert {r.i: r.q for r in co.benjamini_hochberg(table, by=["g"]).collect()} == pytest.approx(want)
    assert co.benjamini_hochberg(table.limit(0)).count() == 0
