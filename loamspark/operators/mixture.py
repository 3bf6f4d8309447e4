"""Mixture inference by expectation-maximisation over candidates ``(read_id, marker, species, containment)``.

Reads with equal candidates are one profile with their number in ``reads`` (``profiles``); every function takes either form. Parameters are
tables too: ``w(species, w)``, ``d(species, d)`` and ``b(species, marker, b)``. A step is a join with this small table and one aggregation,
whatever the number of reads. Products are sums of logarithms, with a read's largest term taken out, so none underflows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.functions import special
from loamspark.functions.frames import sql
from loamspark.session import saved

# Species with status, mitochondrial copies and DNA yield, and markers with their primers.
SPECIES = [
    ("Sus_scrofa", "Domestic pig", "HARAM", 1800.0, 1.0), ("Sus_barbatus", "Bearded pig", "HARAM", 1600.0, 0.9), ("Canis_lupus", "Dog", "HARAM", 1200.0, 0.8),
    ("Bos_taurus", "Cattle", "HALAL", 2000.0, 1.2), ("Bubalus_bubalis", "Water buffalo", "HALAL", 1900.0, 1.1), ("Ovis_aries", "Sheep", "HALAL", 1700.0, 1.0),
    ("Capra_hircus", "Goat", "HALAL", 1600.0, 1.0), ("Gallus_gallus", "Chicken", "HALAL", 1000.0, 0.7), ("Meleagris_gallopavo", "Turkey", "HALAL", 900.0, 0.6),
    ("Anas_platyrhynchos", "Duck", "HALAL", 950.0, 0.65), ("Equus_caballus", "Horse", "MASHBOOH", 1500.0, 0.9), ("Equus_asinus", "Donkey", "MASHBOOH", 1400.0, 0.85),
]
MARKERS = [("COI", "GGTCAACAAATCATAAAGATATTGG", "TAAACTTCAGGGTGACCAAAAAATCA"), ("cytb", "CCATCCAACATCTCAGCATGATG", "CCCCTCAGAATGATATTTGTCCTCA"), ("16S", "GACGAGAAGACCCTATGGAGC", "TCCGAGGTCGCCCCAACC")]


def reference_tables(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(SPECIES, "species_id string, name string, status string, mito_cn double, dna_yield double"), spark.createDataFrame(MARKERS, "marker_id string, primer_f string, primer_r string")


def uniform(candidates: DataFrame) -> DataFrame:
    """``species, marker, w, d, b`` of every species with every marker, all alike."""
    return sql(
        """SELECT s.species, m.marker, 1D / (SELECT count(DISTINCT species) FROM {c}) AS w, 1D AS d, 1D AS b
           FROM (SELECT DISTINCT species FROM {c}) s CROSS JOIN (SELECT DISTINCT marker FROM {c}) m""",
        c=candidates,
    )


def profiles(candidates: DataFrame) -> DataFrame:
    """Candidates with the reads that have the same ones as one: ``read_id`` is then a digest of the profile, ``reads`` its number of reads."""
    if "reads" in candidates.columns:
        return candidates
    return sql(
        """WITH r AS (SELECT sort_array(collect_list(struct(marker, species, containment))) AS own FROM {c} GROUP BY read_id),
                n AS (SELECT own, count(*) AS reads FROM r GROUP BY own)
           SELECT read_id, reads, x.marker, x.species, x.containment FROM (SELECT md5(to_json(own)) AS read_id, reads, explode(own) AS x FROM n)""",
        c=candidates,
    )


def _counted(candidates: DataFrame) -> DataFrame:
    return candidates if "reads" in candidates.columns else candidates.withColumn("reads", F.lit(1).cast("long"))


def _degraded(params: DataFrame, rate: float, lengths: DataFrame | None) -> DataFrame:
    if lengths is None or not rate:
        return params
    return params.join(F.broadcast(lengths), ["species", "marker"], "left").withColumn("b", F.col("b") * F.exp(-rate * F.coalesce(F.greatest("length", F.lit(0)), F.lit(0))))


_TERM = "ln(p.w) + ln(p.d) + ln(p.b) + ln(greatest(c.containment, 1e-300D))"


def responsibilities(candidates: DataFrame, params: DataFrame, rate: float = 0.0, lengths: DataFrame | None = None) -> DataFrame:
    """``read_id, marker, species, gamma, ll, reads``: each candidate's share of its read, and the read's log-likelihood in every row.

    ``rate`` is that of degradation over ``lengths(species, marker, length)``.
    """
    return sql(
        f"""WITH x AS (SELECT c.read_id, c.reads, c.marker, c.species, {_TERM} AS x FROM {{c}} c JOIN {{p}} p ON p.species = c.species AND p.marker = c.marker),
                 t AS (SELECT *, max(x) OVER (PARTITION BY read_id) AS top FROM x),
                 z AS (SELECT *, sum(exp(x - top)) OVER (PARTITION BY read_id) AS z FROM t)
            SELECT read_id, marker, species, exp(x - top) / z AS gamma, top + ln(z) AS ll, reads FROM z""",
        c=_counted(candidates), p=_degraded(params, rate, lengths),
    )


def _step(made: DataFrame, params: DataFrame, lengths: DataFrame | None) -> pd.DataFrame:
    """``run, species, marker, g, ll, gl``: shares, the reads' log-likelihood by share, and shares times lengths, of every run in one aggregation.

    Runs are rows of ``params(run, species, marker, x)`` with x the logarithm of the parameters; a candidate without a row is not one of the run.
    """
    length = "coalesce(greatest(l.length, 0), 0)" if lengths is not None else "0"
    join = "LEFT JOIN {l} l ON l.species = c.species AND l.marker = c.marker" if lengths is not None else ""
    return sql(
        f"""WITH x AS (SELECT p.run, c.read_id, c.reads, c.marker, c.species, {length} AS length, p.x - p.rate * {length} + ln(greatest(c.containment, 1e-300D)) AS x FROM {{c}} c JOIN {{p}} p ON p.species = c.species AND p.marker = c.marker {join}),
                 t AS (SELECT *, max(x) OVER (PARTITION BY read_id, run) AS top FROM x),
                 z AS (SELECT *, exp(x - top) AS e, sum(exp(x - top)) OVER (PARTITION BY read_id, run) AS z FROM t)
            SELECT run, species, marker, sum(reads * e / z) AS g, sum(reads * e / z * (top + ln(z))) AS ll, sum(reads * e / z) FILTER (WHERE length > 0) AS gs, sum(reads * e / z * length) AS gl FROM z GROUP BY run, species, marker""",
        c=made, p=params, **({"l": lengths} if lengths is not None else {}),
    ).toPandas()


def maximise(state: pd.DataFrame, single: bool = False, alpha: float = 0.5, d_sigma: float = 0.5, b_sigma: float = 0.5, d_mu: float = 0.0, b_mu: float = 0.0) -> pd.DataFrame:
    """New ``w, d, b`` of ``(run, species, marker, w, d, b, g, rows, reads)``, a small table with one row for each run, species and marker.

    w: effective reads plus alpha - 1, floored and normalised. d: reads over what w and b let expect, shrunk in logarithms and scaled to a geometric
    mean of 1. b: the same for each marker, by species. With one marker d and b stay, and reads are divided by d.
    """
    p = state.copy()
    own, run = [p["run"], p["species"]], p["run"]
    by = lambda x, keys: x.groupby(keys).transform("sum")
    share = 1 / p.groupby(own)["marker"].transform("size")
    effective = by(p["g"], own)
    raw = np.maximum(effective / (p["d"] if single else 1.0) + alpha - 1, 1e-10)
    p["w"] = raw / by(raw * share, run)
    if single:
        return p
    among, weight, dv, bv = by(p["w"] * p["b"] * p["rows"], own), np.maximum(effective, 1), d_sigma**2, b_sigma**2
    log_d = (weight * np.log(np.maximum(effective / among.where(among > 1e-10, 1.0), 1e-10)) + d_mu / dv) / (weight + 1 / dv)
    log_d = log_d.where(among > 1e-10, np.log(p["d"]))
    p["d"] = np.exp(log_d - by(log_d * share, run) / by(share, run))
    want, weight = p["w"] * p["d"] * p["reads"], np.maximum(p["g"], 1)
    known = (want > 1e-10) & (p["g"] > 0)
    log_b = ((weight * np.log(np.maximum(p["g"] / want.where(known, 1.0), 1e-10)) + b_mu / bv) / (weight + 1 / bv)).where(known, b_mu)
    p["b"] = np.exp(log_b - by(log_b * share, own))
    return p


def log_likelihood(gammas: DataFrame) -> DataFrame:
    return sql("SELECT sum(ll * reads) AS ll, sum(reads) AS reads FROM (SELECT read_id, max(ll) AS ll, max(reads) AS reads FROM {g} GROUP BY read_id)", g=_counted(gammas))


def degradation_rate(gammas: DataFrame, lengths: DataFrame) -> float:
    """Shares over shares times lengths, from 1e-6 to 0.1; candidates without a length do not count."""
    r = sql("SELECT sum(gamma * reads) AS g, sum(gamma * reads * length) AS gl FROM {g} JOIN {l} USING (species, marker) WHERE length > 0", g=_counted(gammas), l=lengths).first()
    return _rate(r["g"], r["gl"])


def _rate(shares: float | None, lengths: float | None) -> float:
    return min(0.1, max(1e-6, shares / lengths)) if lengths else 1e-3


def narrowed(values: Callable[[pd.DataFrame], np.ndarray], runs: list, low: float, high: float, points: int = 17, tolerance: float = 1e-8) -> pd.DataFrame:
    """``run, rate, ll``: where each run's value is largest between ``low`` and ``high``, ends included.

    ``values`` takes all runs' trial points ``(run, rate)`` at once. Each round spreads ``points`` over what is left and goes on between the best one's neighbours, until that is no wider than ``tolerance``; of
    several largest values the smallest rate is taken. A value with one peak is found to the tolerance.
    """
    left, found = {r: (low, high) for r in runs}, {}
    while left:
        trials = pd.DataFrame([(r, x) for r, (a, b) in left.items() for x in np.linspace(a, b, points)], columns=["run", "rate"])
        trials["ll"] = values(trials)
        for run, part in trials.groupby("run", sort=False):
            rate, ll = part["rate"].to_numpy(), part["ll"].to_numpy()
            at = int(np.argmax(ll))
            found[run] = (rate[at], ll[at])
            left[run] = (rate[max(at - 1, 0)], rate[min(at + 1, points - 1)])
            if left[run][1] - left[run][0] <= tolerance:
                del left[run]
    return pd.DataFrame([(r, *found[r]) for r in runs], columns=["run", "rate", "ll"])


def likelihood_rates(candidates: DataFrame, params: DataFrame, lengths: DataFrame, low: float = 1e-6, high: float = 0.1, points: int = 17, tolerance: float = 1e-8) -> pd.DataFrame:
    """``run, rate, ll``: the rate of degradation of each run of ``params(run, species, marker, w, d, b)`` at which the observed reads are likeliest. All runs' trial points are rows of one plan a round."""
    spark = candidates.sparkSession
    made = profiles(candidates).repartition("read_id").persist()
    try:
        return _rates(made, params.toPandas(), lengths, lambda frame: _local(spark, frame), low, high, points, tolerance)
    finally:
        made.unpersist()


def _rates(made: DataFrame, params: pd.DataFrame, lengths: DataFrame, table: Callable[[pd.DataFrame], DataFrame], low: float = 1e-6, high: float = 0.1, points: int = 17, tolerance: float = 1e-8) -> pd.DataFrame:
    x = params[["run", "species", "marker"]].assign(x=np.log(params["w"]) + np.log(params["d"]) + np.log(params["b"]))

    def values(trials: pd.DataFrame) -> np.ndarray:
        numbered = trials.assign(trial=np.arange(len(trials)))
        own = x.merge(numbered, on="run")[["trial", "species", "marker", "x", "rate"]].rename(columns={"trial": "run"})
        return _step(made, table(own), lengths).groupby("run")["ll"].sum().reindex(range(len(trials)), fill_value=-math.inf).to_numpy(float)

    return narrowed(values, sorted(params["run"].unique()), low, high, points, tolerance)


def starts(even: pd.DataFrame, restarts: int, alpha: float = 0.5, d_mu: float = 0.0, b_mu: float = 0.0, seed: int = 42) -> pd.DataFrame:
    """Parameters to begin from, by run: the given ones, then weights of a Dirichlet and factors near 1, each run by its own seed."""
    even = even.sort_values(["species", "marker"], ignore_index=True)
    out = [even.assign(run=0)]
    species, markers = sorted(even["species"].unique()), even["marker"].nunique()
    for run in range(1, restarts):
        rng = np.random.default_rng([seed, run])
        w = dict(zip(species, rng.dirichlet(np.full(len(species), alpha + 0.5)), strict=True))
        d = dict(zip(species, rng.lognormal(d_mu, 0.1, len(species)), strict=True))
        b = rng.lognormal(b_mu, 0.1, (len(species), markers)).ravel()
        out.append(even.assign(run=run, w=np.maximum(even["species"].map(w), 1e-10), d=even["species"].map(d), b=b[: len(even)]))
    return pd.concat(out, ignore_index=True)


def fit_runs(candidates: DataFrame, begin: pd.DataFrame, max_iter: int = 200, tolerance: float = 1e-6, lengths: DataFrame | None = None, degradation: bool = False, single: bool = False, by_likelihood: bool = False, **prior: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Parameters ``(run, species, marker, w, d, b)`` at each run's end, and ``(run, ll, iterations, converged, rate)``.

    All runs still going are rows of one parameter table, so an iteration is one plan whatever their number. Profiles are dealt by read once and
    kept; only parameters and sums by species and marker pass the driver. A run ends where its log-likelihood changes by less than ``tolerance`` of itself.
    The rate of degradation is that of shares over lengths, or with ``by_likelihood`` the likeliest one (``likelihood_rates``).
    """
    spark = candidates.sparkSession
    made = profiles(candidates).repartition("read_id").persist()
    try:
        keys = begin[["run", "species", "marker"]]
        # Counts that no step changes: candidates of each run's species and markers, and reads of its markers.
        rows = sql("SELECT run, c.species, c.marker, sum(reads) AS rows FROM {c} c JOIN {k} k ON k.species = c.species AND k.marker = c.marker GROUP BY ALL", c=made, k=_local(spark, keys)).toPandas()
        reads = sql("SELECT run, marker, sum(reads) AS reads FROM (SELECT DISTINCT run, read_id, c.marker, reads FROM {c} c JOIN {k} k ON k.species = c.species AND k.marker = c.marker) GROUP BY ALL", c=made, k=_local(spark, keys)).toPandas()
        state = begin[["run", "species", "marker", "w", "d", "b"]].merge(rows, "left", ["run", "species", "marker"]).merge(reads, "left", ["run", "marker"]).fillna({"rows": 0.0, "reads": 0.0})
        done = pd.DataFrame({"run": sorted(state["run"].unique())}).assign(ll=-math.inf, iterations=0, converged=False, rate=1e-3 if degradation else 0.0).set_index("run")
        going = list(done.index)

        def expect(going: list) -> pd.DataFrame:
            own = state[state["run"].isin(going)]
            x = own[["run", "species", "marker"]].assign(x=np.log(own["w"]) + np.log(own["d"]) + np.log(own["b"]), rate=own["run"].map(done["rate"]))
            return _step(made, _local(spark, x), lengths)

        for step in range(1, max_iter + 1):
            if not going:
                break
            sums = expect(going)
            ll = sums.groupby("run")["ll"].sum().reindex(going, fill_value=0.0)
            old = state[state["run"].isin(going)].drop(columns="g", errors="ignore")
            new = maximise(old.merge(sums[["run", "species", "marker", "g"]], "left", ["run", "species", "marker"]).fillna({"g": 0.0}), single, **prior)
            state = pd.concat([state[~state["run"].isin(going)], new], ignore_index=True)
            if degradation and lengths is not None and not single and by_likelihood:
                fitted = _rates(made, new, lengths, lambda frame: _local(spark, frame)).set_index("run")
                done.loc[fitted.index, "rate"] = fitted["rate"]
            elif degradation and lengths is not None and not single:
                for run, part in sums.groupby("run"):
                    done.loc[run, "rate"] = _rate(part["gs"].sum(), part["gl"].sum())
            change = (ll - done.loc[going, "ll"]).abs() / (ll.abs() + 1e-10)
            done.loc[going, "ll"], done.loc[going, "iterations"] = ll, step
            ended = [r for r in going if step > 1 and change[r] < tolerance]
            done.loc[ended, "converged"] = True
            going = [r for r in going if r not in ended]
        last = expect(list(done.index)).groupby("run")["ll"].sum()
        done["ll"] = [float(last.get(r, -math.inf)) for r in done.index]
    finally:
        made.unpersist()
    return state[["run", "species", "marker", "w", "d", "b"]], done.reset_index()


def _local(spark, frame: pd.DataFrame) -> DataFrame:
    """A small table in the plan itself, so that its size is known and it is broadcast."""
    return spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False))


def fit(
    candidates: DataFrame, max_iter: int = 200, tolerance: float = 1e-6, start: DataFrame | None = None, lengths: DataFrame | None = None, degradation: bool = False, mito: DataFrame | None = None, restarts: int = 3, seed: int = 42, **prior: float
) -> tuple[DataFrame, float, int]:
    """Parameters, log-likelihood and iterations of the run with the largest log-likelihood, the first of equal ones.

    The first run begins from ``start`` or equal weights, the others at random. With one marker, d is fixed to ``mito(species, mito_cn)`` over its geometric mean.
    Reads are grouped to profiles once, which are saved; what reads them would otherwise group all reads again.
    """
    spark = candidates.sparkSession
    candidates = candidates if "reads" in candidates.columns else saved(profiles(candidates), "profiles")
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    even = (start if start is not None else uniform(candidates)).select("species", "marker", "w", "d", "b").toPandas()
    if even.empty:
        return spark.createDataFrame([], f"species {kinds['species']}, marker {kinds['marker']}, w double, d double, b double"), 0.0, 0
    single = even["marker"].nunique() <= 1
    begin = starts(even, restarts, prior.get("alpha", 0.5), prior.get("d_mu", 0.0), prior.get("b_mu", 0.0), seed)
    if single and mito is not None:
        cn = {r["species"]: r["mito_cn"] for r in mito.collect() if r["mito_cn"] and r["mito_cn"] > 0}
        own = [math.log(cn[s]) for s in even["species"] if s in cn]
        mean = math.exp(sum(own) / len(own)) if own else 1.0
        begin["d"], begin["b"] = begin["species"].map(lambda s: cn.get(s, mean) / mean), 1.0
    state, done = fit_runs(candidates, begin, max_iter, tolerance, lengths, degradation, single, **prior)
    best = done.sort_values(["ll", "run"], ascending=[False, True]).iloc[0]
    rows = _local(spark, state[state["run"] == best["run"]].drop(columns="run"))
    return rows.select(F.col("species").cast(kinds["species"]), F.col("marker").cast(kinds["marker"]), "w", "d", "b"), float(best["ll"]), int(best["iterations"])


def bic(ll: float, species: int, markers: int, reads: int, degradation: bool = False) -> float:
    return -2 * ll + (species - 1 + species + species * markers + degradation) * math.log(max(reads, 1))


def intervals(gammas: DataFrame, params: DataFrame) -> DataFrame:
    """Wald's 95 % interval of every weight, from its effective reads."""
    return sql(
        """WITH w AS (SELECT DISTINCT species, w FROM {p}), e AS (SELECT species, sum(gamma * reads) AS n FROM {g} GROUP BY species)
           SELECT w.species, w.w, CASE WHEN e.n > 0 AND w.w > 1e-10D THEN greatest(w.w - 1.96D * sqrt(w.w * (1 - w.w) / (e.n + 1)), 0D) ELSE 0D END AS lo,
                  CASE WHEN e.n > 0 AND w.w > 1e-10D THEN least(w.w + 1.96D * sqrt(w.w * (1 - w.w) / (e.n + 1)), 1D) ELSE w.w END AS hi FROM w LEFT JOIN e ON e.species = w.species""",
        g=_counted(gammas), p=params,
    )


def observed_intervals(gammas: DataFrame, params: DataFrame) -> DataFrame:
    """Intervals from the observed information: the complete less the missing one; reads without the species count with a share of 0."""
    return sql(
        """WITH w AS (SELECT DISTINCT species, w FROM {p}), n AS (SELECT sum(reads) AS n FROM (SELECT DISTINCT read_id, reads FROM {g})),
                s AS (SELECT w.species, w.w, sum(reads * (pow(gamma / w.w - (1 - gamma) / (1 - w.w), 2) - gamma * (1 - gamma) * pow(1 / w.w + 1 / (1 - w.w), 2))) AS i, sum(reads) AS c
                      FROM w JOIN {g} g ON g.species = w.species WHERE w.w >= 1e-10D AND w.w < 1 GROUP BY ALL),
                o AS (SELECT species, w, 1 / sqrt(greatest(i + (n.n - c) / pow(1 - w, 2), 1e-10D)) AS se FROM s CROSS JOIN n)
           SELECT species, w, greatest(w - 1.96D * se, 0D) AS lo, least(w + 1.96D * se, 1D) AS hi FROM o""",
        g=_counted(gammas), p=params,
    )


def likelihood_ratio(candidates: DataFrame, params: DataFrame) -> DataFrame:
    """2 (ll - ll without the species) of every species with a weight, the others' weights scaled up; a read that no other explains counts -100."""
    return sql(
        f"""WITH x AS (SELECT c.read_id, c.reads, c.species, p.w, {_TERM} AS x FROM {{c}} c JOIN {{p}} p ON p.species = c.species AND p.marker = c.marker),
                 e AS (SELECT *, max(x) OVER (PARTITION BY read_id) AS top FROM x),
                 t AS (SELECT *, sum(exp(x - top)) OVER (PARTITION BY read_id) AS t FROM e),
                 r AS (SELECT read_id, reads, species, w, top, max(t) AS t, sum(exp(x - top)) AS own FROM t GROUP BY ALL),
                 n AS (SELECT sum(reads) AS n FROM (SELECT DISTINCT read_id, reads FROM t)),
                 s AS (SELECT species, w, sum(reads * (top + ln(t))) AS with_all, sum(reads * CASE WHEN t - own > 1e-12D * t THEN top + ln((t - own) / (1 - w)) ELSE -100D END) AS without, sum(reads) AS c FROM r WHERE w >= 1e-6D AND w < 1 GROUP BY ALL)
            SELECT species, greatest(2 * (with_all - without + (n.n - c) * ln(1 - w)), 0D) AS lrt FROM s CROSS JOIN n""",
        c=_counted(candidates), p=params,
    )


def refit_ratio(candidates: DataFrame, params: DataFrame, ll: float, max_iter: int = 50, tolerance: float = 1e-6, lengths: DataFrame | None = None, degradation: bool = False, **prior: float) -> DataFrame:
    """``species, lrt``: 2 (ll - ll of a fit without the species), reads that no other species explains left out; 0 for a species without a weight.

    Each species' fit is a run of one plan, whose parameters have no row of that species. Without any read left the ratio is infinite.
    """
    own = params.select("species", "marker", "w").toPandas()
    species, kind = sorted(own["species"].unique()), params.schema["species"].dataType.simpleString()
    tested = sorted(own.loc[own["w"] >= 1e-6, "species"].unique())
    runs = [own.loc[own["species"] != s, ["species", "marker"]].assign(run=i, w=1 / (len(species) - 1), d=1.0, b=1.0) for i, s in enumerate(tested) if len(species) > 1]
    less = {}
    if runs:
        done = fit_runs(candidates, pd.concat(runs, ignore_index=True), max_iter, tolerance, lengths, degradation, own["marker"].nunique() <= 1, **prior)[1]
        less = {tested[r]: v for r, v in zip(done["run"], done["ll"], strict=True)}
    rows = [(s.item() if hasattr(s, "item") else s, max(0.0, 2 * (ll - less.get(s, -math.inf))) if s in tested else 0.0) for s in species]
    return candidates.sparkSession.createDataFrame(rows, f"species {kind}, lrt double")


def ratio_p(ratios: DataFrame) -> DataFrame:
    """``p`` of ratios under chi-squared with one degree of freedom; 1 at 0."""
    return ratios.withColumn("p", F.when(F.col("lrt") <= 0, 1.0).when(F.col("lrt") == float("inf"), 0.0).otherwise(special.norm_p(F.sqrt("lrt"))))


def prune(weights: DataFrame, least: float) -> DataFrame:
    """Weights under ``least`` become 0, the rest sum to 1."""
    return sql("SELECT species, coalesce(w / nullif(sum(w) OVER (), 0), 0D) AS w FROM (SELECT species, CASE WHEN w < {m} THEN 0D ELSE w END AS w FROM {w})", w=weights, m=least)


def report_counts(hits: DataFrame) -> DataFrame:
    """Hits of every species, and their percentage of the classified reads (each hit counts)."""
    return sql("SELECT species, count(*) AS reads, 100D * count(*) / (SELECT count(DISTINCT read_id) FROM {h}) AS read_pct FROM {h} GROUP BY species", h=hits)


def marker_agreement(hits: DataFrame) -> DataFrame:
    """``agreement``: the part of marker pairs with the same commonest species; 1 with fewer than two markers."""
    return sql(
        """WITH t AS (SELECT marker, species FROM (SELECT marker, species, row_number() OVER (PARTITION BY marker ORDER BY count(*) DESC, species) AS rn FROM {h} GROUP BY marker, species) WHERE rn = 1)
           SELECT CASE WHEN (SELECT count(*) FROM t) < 2 THEN 1D ELSE (SELECT avg(CASE WHEN a.species = b.species THEN 1D ELSE 0D END) FROM t a JOIN t b ON a.marker < b.marker) END AS agreement""",
        h=hits,
    )


def verdict(weights: DataFrame, status: DataFrame, agreement: float, classified: int, total: int, least: float = 0.001) -> DataFrame:
    """FAIL for a forbidden species at ``least``; INCONCLUSIVE for a doubtful one, poor agreement or few classified reads; else PASS."""
    doubt = agreement < 0.5 or classified < total // 10
    return sql(
        """SELECT CASE WHEN coalesce(bool_or(s.status = 'HARAM' AND w.w >= {m}), false) THEN 'FAIL' WHEN coalesce(bool_or(s.status = 'MASHBOOH' AND w.w >= {m}), false) OR {d} THEN 'INCONCLUSIVE' ELSE 'PASS' END AS verdict
           FROM {w} w LEFT JOIN {s} s ON s.species = w.species""",
        w=weights, s=status, m=least, d=doubt,
    )


def calibrate(samples: DataFrame) -> DataFrame:
    """``d_mu, d_sigma, b_mu, b_sigma`` from ``(sample_id, species, marker, true_w, obs_reads)`` of known mixtures; sigmas are 0.1 at least, 0.5 from one sample."""
    return sql(
        """WITH k AS (SELECT count(DISTINCT sample_id) AS k FROM {s}),
                o AS (SELECT *, obs_reads / nullif(sum(obs_reads) OVER (PARTITION BY sample_id, marker), 0) AS f FROM {s}),
                l AS (SELECT sample_id, species, marker, ln(greatest(coalesce(f, 0D) / true_w, 1e-10D)) AS x FROM o WHERE true_w >= 1e-10D),
                d AS (SELECT sample_id, species, avg(x) AS x FROM l GROUP BY ALL),
                dm AS (SELECT species, sum(x) / max(k) AS mu, sum(x * x) / max(k) - pow(sum(x) / max(k), 2) AS v FROM d CROSS JOIN k GROUP BY species),
                bm AS (SELECT l.species, l.marker, sum(l.x - d.x) / max(k) AS mu, sum(pow(l.x - d.x, 2)) / max(k) - pow(sum(l.x - d.x) / max(k), 2) AS v FROM l JOIN d USING (sample_id, species) CROSS JOIN k GROUP BY l.species, l.marker)
           SELECT (SELECT avg(mu) FROM dm) AS d_mu, greatest(CASE WHEN k.k > 1 THEN (SELECT sqrt(avg(CASE WHEN v > 0 THEN v ELSE 0.01D END)) FROM dm) ELSE 0.5D END, 0.1D) AS d_sigma,
                  (SELECT avg(mu) FROM bm) AS b_mu, greatest(CASE WHEN k.k > 1 THEN (SELECT sqrt(avg(CASE WHEN v > 0 THEN v ELSE 0.01D END)) FROM bm) ELSE 0.5D END, 0.1D) AS b_sigma FROM k""",
        s=samples,
    )


def fragment_rate(lengths: DataFrame) -> DataFrame:
    """1 / mean length; 0 without lengths, 1 where the mean is under 1."""
    return lengths.agg(F.when(F.count("*") == 0, 0.0).when(F.avg("length") < 1, 1.0).otherwise(F.try_divide(F.lit(1.0), F.avg("length"))).alias("rate"))


def species_by_marker(hits: DataFrame, markers: list) -> DataFrame:
    """A row for each species of ``hits(read_id, marker, species)``: its hits at each of ``markers``, a column each, and ``read_pct``, all its hits at them in hundredths of the classified reads."""
    classified = hits.agg(F.countDistinct("read_id").alias("classified"))
    wide = hits.where(F.col("marker").isin(markers)).groupBy("species").pivot("marker", markers).count().na.fill(0)
    return wide.withColumn("read_pct", 100 * sum(F.col(f"`{m}`") for m in markers) / F.lit(max(classified.first()[0], 1)))
