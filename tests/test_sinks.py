import json

import pytest

from loamspark.operators import markers as mk
from loamspark.sources import references, sinks, tabular


def lines(spark, path):
    return [r[0] for r in spark.read.text(str(path)).collect()]


def test_verdict_reports(spark, tmp_path):
    rows = spark.createDataFrame([("ox", "HALAL", 70.0, 65.0, 75.0, 60.0), ("ant", "HARAM", 30.0, 20.0, 35.0, 40.0), ("gone", "HALAL", 0.001, 0.0, 0.1, 0.001)], "species string, status string, weight_pct double, ci_lo double, ci_hi double, read_pct double")
    sinks.verdict_tsv(rows, str(tmp_path / "v"))
    assert lines(spark, tmp_path / "v") == ["species\tstatus\tweight_pct\tci_lo\tci_hi\tread_pct", "ant\tHARAM\t30.0000\t20.0000\t35.0000\t40.0000", "ox\tHALAL\t70.0000\t65.0000\t75.0000\t60.0000"]
    sinks.verdict_text(rows, "s1", "FAIL", 0, 0, 0.5, str(tmp_path / "t"))
    got = lines(spark, tmp_path / "t")
    assert got[1].strip() == "Verdict: FAIL" and "(0.0%)" in got[2] and "50.0%" in got[3] and [x.split()[0] for x in got[5:]] == ["ant", "ox"]
    sinks.statistic(spark, "ANOSIM", 0.25, 0.01, str(tmp_path / "s"), permutations=99)
    assert lines(spark, tmp_path / "s") == ["Test: ANOSIM", "Statistic: 0.2500", "P-value: 0.0100", "permutations: 99"]


def test_numbers_in_six_digits(spark, tmp_path):
    values = [0.0, 1.0, 0.5, 123456.0, 1234567.0, 0.0001, 0.00001234567, 3.14159265, -2.5, 100.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(sinks.general(sinks.F.col("x"))).collect()]
    assert got == [f"{v:g}" for v in values]
    sinks.matrix(spark.createDataFrame([("a", "x", 0.25), ("a", "y", 1e-7), ("b", "x", 3.0)], "f string, s string, v double"), str(tmp_path / "m"), "f", "s", "v", None)
    assert lines(spark, tmp_path / "m") == ["f,x,y", "a,0.25,1e-07", 'b,3,""'] or lines(spark, tmp_path / "m") == ["f,x,y", "a,0.25,1e-07", "b,3,"]


def test_community_summary(spark, tmp_path):
    alpha = spark.createDataFrame([(1, 1.0, 0.5, 3), (2, 2.0, 0.7, 5)], "sample_id long, shannon double, simpson double, richness long")
    tests = spark.createDataFrame([("ANOSIM", 0.5, 0.01)], "name string, statistic double, p double")
    diff = spark.createDataFrame([("a", "b", 0.01), ("a", "b", 0.5), ("a", "b", None)], "g1 string, g2 string, q double")
    ind = spark.createDataFrame([("a", 0.01), ("b", 0.9)], "best_group string, p double")
    core = spark.createDataFrame([(0.5, "f"), (0.5, "g")], "threshold double, feature_id string")
    spec = spark.createDataFrame([(0.5,), (0.9,), (0.1,)], "score double")
    sinks.community_summary(str(tmp_path / "c"), 10, 7, 0.1, alpha, tests, diff, ind, core, spec)
    got = lines(spark, tmp_path / "c")
    for want in ("removed: 3", "shannon: 1.500 +/- 0.500", "ANOSIM: 0.500, p=0.0100", "a vs b: 1", "a: 1", "b: 0", "50%: 2", "specialists: 1", "generalists: 2"):
        assert want in got
    sinks.community_summary(str(tmp_path / "e"), 0, 0, 0.1, alpha.limit(0), tests.limit(0), diff.limit(0), ind.limit(0), core.limit(0), spec.limit(0))
    assert "shannon: none" in lines(spark, tmp_path / "e")


def test_network_tables_are_sorted(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 0.2), ("a", "c", 0.1), ("b", "c", 0.1)], "src string, dst string, phi double")
    topology = spark.createDataFrame([("c", 1), ("a", 0), ("b", 0)], "feature_id string, module int")
    keystones = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.9)], "feature_id string, score double")
    sinks.network_tables(str(tmp_path / "n"), edges, topology, keystones, spark.createDataFrame([("a", "P")], "feature_id string, phylum string"))
    read = lambda name: [r[:3] for r in spark.read.csv(str(tmp_path / "n" / name), header=True).collect()]
    assert [r[:2] for r in read("edges")] == [("a", "c"), ("b", "c"), ("a", "b")] and [r[0] for r in read("topology")] == ["a", "b", "c"]
    assert [r[0] for r in read("keystones")] == ["b", "c", "a"] and [r[:2] for r in read("modules")] == [("0", "a"), ("0", "b"), ("1", "c")]
    assert spark.read.csv(str(tmp_path / "n" / "edges"), header=True).first()["phylum_1"] == "P"


def test_profile_calibration_and_page(spark, tmp_path):
    strains = spark.createDataFrame([("s2", 0.4, 0.3, 0.5), ("s1", 0.6, 0.5, 0.7)], "strain string, pi double, lo double, hi double")
    genes = spark.createDataFrame([("s1", "g", 1.0)], "strain string, gene string, phi double")
    pairs = spark.createDataFrame([("s1", "s2", 0.9)], "a string, b string, score double")
    sinks.profile_json(strains, genes, pairs, {"bic": 12.5, "reads": 7}, str(tmp_path / "p"))
    got = json.loads(lines(spark, tmp_path / "p")[0])
    assert [x["strain"] for x in got["strains"]] == ["s1", "s2"] and got["identifiability"] == {"s1__s2": 0.9} and got["bic"] == 12.5 and got["reads"] == 7
    values = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4)], "d_mu double, d_sigma double, b_mu double, b_sigma double")
    sinks.calibration(values, str(tmp_path / "k"))
    assert tuple(tabular.calibration(spark, str(tmp_path / "k")).first()) == (0.1, 0.2, 0.3, 0.4)
    sinks.html(spark, "A < B", [("Pairs", "one & only", pairs)], str(tmp_path / "h"))
    page = "\n".join(lines(spark, tmp_path / "h"))
    assert "A &lt; B" in page and "one &amp; only" in page and "<td>s1</td><td>s2</td><td>0.9</td>" in page


def test_results_and_shape(spark, tmp_path):
    schema = "experiment string, true_w double, note string"
    assert tabular.results(spark, str(tmp_path / "none.tsv"), schema).count() == 0
    (tmp_path / "r.tsv").write_text("true_w\texperiment\n0.5\tx\n")
    assert tuple(tabular.results(spark, str(tmp_path / "r.tsv"), schema).first()) == ("x", 0.5, None)
    t = spark.createDataFrame([("f", "s", 1.0)], "feature_id string, sample_id string, value double")
    assert tabular.check_shape(t, 1, 1) is t
    with pytest.raises(ValueError, match="1 features"):
        tabular.check_shape(t, 2, 1)


def test_reference_sets_and_marker_index_are_saved(spark, tmp_path):
    refs = references.builtin(spark)
    more = spark.createDataFrame([("Bos_taurus", "COI", "ACGTACGTACGTACGTACGTACGTACG"), ("Ovis_aries", "COI", "")], references.SEQUENCES)
    full = references.add(refs, sequences=more)
    references.save(full, str(tmp_path / "r"))
    got = references.load(spark, str(tmp_path / "r"))
    assert (got.species.count(), got.markers.count(), got.sequences.count()) == (12, 3, 1)
    ids = spark.createDataFrame([("Bos_taurus", "COI"), ("yak", "COI"), ("Ovis_aries", "x")], "species_id string, marker_id string")
    assert {r.species_id: (r.status, r.sequence is not None, r.primer_f is not None) for r in references.named(ids, got).collect()} == {"Bos_taurus": ("HALAL", True, True), "yak": (None, False, True), "Ovis_aries": ("HALAL", False, False)}
    with pytest.raises(ValueError, match="yak"):
        references.add(refs, sequences=spark.createDataFrame([("yak", "COI", "A")], references.SEQUENCES))
    with pytest.raises(ValueError, match="more than one"):
        references.add(full, species=spark.createDataFrame([("Bos_taurus", "n", "HALAL", 1.0, 1.0)], references.SPECIES))
    with pytest.raises(ValueError, match="no table"):
        got.markers.write.mode("overwrite").parquet(str(tmp_path / "r" / "species"))
        references.load(spark, str(tmp_path / "r"))
    index = mk.build(got.sequences.selectExpr("species_id AS species", "marker_id AS marker", "sequence"), got.markers.selectExpr("marker_id AS marker", "primer_f AS sequence"), scale=1.0)
    mk.save(index, str(tmp_path / "i"))
    back = mk.load(spark, str(tmp_path / "i"))
    assert (back.scale, back.coarse_k, back.primer_k, back.fine_ks) == (1.0, 21, 15, index.fine_ks) and sorted(back.fine.collect()) == sorted(index.fine.collect())
