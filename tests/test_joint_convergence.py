import inspect

import pytest

from loamspark.operators import joint as jt

CAND = "read_id int, strain string, gene string, containment double"


def slow_rows():
    """Genes tell nothing and containments little, so that EM needs many steps to a's weight."""
    out = []
    for i in range(600):
        s, o = ("a", "b") if i % 4 else ("b", "a")
        out += [(i, s, f"g{i % 3}", 0.6), (i, o, f"g{i % 3}", 0.4)]
    return out


def test_defaults_are_the_reference():
    use = jt.Settings()
    assert (use.max_iter, use.tolerance, len(jt.restarts())) == (200, 1e-6, 10)
    assert inspect.signature(jt.fit).parameters["n"].default == 10
    own = jt.restarts(3, of=jt.Run("x", ("a",), fix_pi=True))
    assert [(r.name, r.strains, r.fix_pi) for r in own] == [(f"x/{i}", ("a",), True) for i in range(3)] and own[0].seed is None and own[1].seed != own[2].seed


def test_runs_go_on_to_convergence_and_tell_it(spark, monkeypatch):
    rows = jt.profiles(spark.createDataFrame(slow_rows(), CAND)).cache()
    done = jt.fit_runs(rows, jt.restarts(2))
    short = jt.fit_runs(rows, jt.restarts(2), jt.Settings(max_iter=5))
    # Sums that are too many for the driver are added up in Spark, to the same.
    monkeypatch.setattr(jt, "COLLECTED", 0)
    monkeypatch.setattr(jt, "BLOCK_ROWS", 50)
    other = jt.fit_runs(rows, jt.restarts(2), jt.Settings(max_iter=5))
    assert other.params[["pi", "phi"]].to_numpy() == pytest.approx(short.params[["pi", "phi"]].to_numpy(), rel=1e-12)
    rows.unpersist()
    for name, trace in done.traces.items():
        assert done.converged[name] and 12 < len(trace) < 200
        assert abs(trace[-1] - trace[-2]) < 1e-6 * abs(trace[-2]) and abs(trace[11] - trace[10]) >= 1e-6 * abs(trace[10])
        assert trace[-1] > trace[11] and not short.converged[name]


def test_results_tell_convergence(spark):
    rows = spark.createDataFrame(slow_rows(), CAND)
    short = jt.Settings(max_iter=2)
    assert [r.converged for r in jt.fit(rows, 2, short).select("converged").distinct().collect()] == [False]
    picked = jt.select_strains(rows, short, n=2).collect()
    assert [r.k for r in picked] == [1, 2] and sum(r.chosen for r in picked) == 1 and not picked[1].converged
    parts = jt.ablate(rows, short, n=2).collect()
    assert {r.run for r in parts} == {"joint", "strain_only", "function_only"} and len(parts) == 18
    assert all(r.pi == pytest.approx(1 / 3) for r in parts if r.run == "function_only")
    assert jt.select_strains(spark.createDataFrame([], CAND), short, n=2).count() == 0
    assert jt.ablate(spark.createDataFrame([], CAND), short, n=2).count() == 0


def test_reads_are_grouped_once(spark, tmp_path):
    """Every plan after the first reads saved profiles; before, each grouped all reads again, which on large tables shuffled them over and over."""
    from pyspark.sql import functions as F

    from loamspark.operators import joint as jt
    from loamspark.operators import mixture as mx

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(60).select(F.col("id").alias("read_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("species"), (F.col("id") % 2).cast("int").alias("marker"), F.lit(0.9).alias("containment"))
    once = rows.mapInArrow(counted, rows.schema)
    mx.fit(once, max_iter=3)
    assert seen.value == 120
    seen.value = 0
    profiles = jt.saved_profiles(once.selectExpr("read_id", "species AS strain", "marker AS gene", "containment"))
    done = jt.fit_runs(profiles, [jt.Run("0")], jt.Settings(max_iter=3))
    assert jt.assign(profiles, done, 2).agg(F.sum("reads")).first()[0] == 60
    assert seen.value == 120
