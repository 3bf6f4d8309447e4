"""Joint inference of strain weights and the genes that strains carry, from ``(read_id, strain, gene, containment)``.

pi is a strain's weight, phi(strain, gene) how its reads spread over genes; a pool of mobile genes may take reads of any strain. Reads with
the same candidates are one row with a count, so an iteration costs distinct candidate lists, not reads. Restarts, ablations and
choices of strains are *runs*: one pass an iteration over the packed profiles serves all of them. Shares are summed in Spark; only
the sums, a row for each run and each strain's gene, come to the driver for the closed-form update.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.functions import special
from loamspark.functions.frames import sql
from loamspark.session import saved


#: A parameter table of more rows is joined without a broadcast.
BROADCAST_ROWS = 500_000
#: Rows of a packed block, about.
BLOCK_ROWS = 1 << 16
#: Numbers of the tasks' sums that the driver adds up at most.
COLLECTED = 4_000_000
#: Starts of a fit.
RESTARTS = 10


@dataclass(frozen=True)
class Run:
    """One fit: its strains (none given: all), its seed (none: even start), and what stays fixed."""

    name: str
    strains: tuple = ()
    seed: int | None = None
    fix_pi: bool = False
    fix_phi: bool = False


@dataclass(frozen=True)
class Settings:
    """Priors: Dirichlet(alpha) on weights; Beta(a, b) on phi, or ``present`` and ``absent`` where a reference tells which."""

    alpha: float = 1.0
    beta: tuple[float, float] = (1.5, 1.5)
    present: tuple[float, float] = (2.0, 1.01)
    absent: tuple[float, float] = (1.01, 2.0)
    mobile: bool = True
    max_iter: int = 200
    tolerance: float = 1e-6
    least: float = 0.05


@dataclass
class Fit:
    """``params(run, strain, gene, pi, phi)``, and by run: mobile weight, penalised log-likelihood, its trace, BIC, and whether it converged. phi is not yet scaled."""

    params: pd.DataFrame
    mobile: dict[str, float]
    ll: dict[str, float]
    bic: dict[str, float]
    reads: dict[str, float]
    traces: dict[str, list[float]] = field(default_factory=dict)
    converged: dict[str, bool] = field(default_factory=dict)

    @property
    def best(self) -> str:
        """The run with the highest likelihood; the first of equals."""
        return max(self.ll, key=self.ll.get)

    def best_of(self, name: str) -> str:
        """The restart of the run ``name`` with the highest likelihood; the first of equals."""
        return max((k for k in self.ll if k.startswith(f"{name}/")), key=self.ll.get)

    @property
    def multimodal(self) -> bool:
        """Runs differ by more than 10 in likelihood."""
        return len(self.ll) > 1 and max(self.ll.values()) - min(self.ll.values()) > 10


def profiles(candidates: DataFrame, least: float = 0.05) -> DataFrame:
    """``profile, reads, strain, gene, c``: distinct candidate lists with their numbers of reads."""
    kept = candidates.where(F.col("containment") >= least).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("strain", "gene", F.col("containment").alias("c")))).alias("list"))
    lists = kept.groupBy("list").agg(F.count("*").alias("reads"))
    rows = lists.select(F.xxhash64("list").alias("profile"), "reads", F.explode("list").alias("x"))
    # Dealt by profile once, so that the windows of every iteration need no shuffle.
    return rows.select("profile", "reads", "x.strain", "x.gene", "x.c").repartition("profile")


def saved_profiles(candidates: DataFrame, least: float = 0.05) -> DataFrame:
    """``profiles`` as a saved table: they are few, and every plan over them would otherwise group all reads again."""
    return saved(profiles(candidates, least), "profiles")


def _shares(rows: DataFrame, params: DataFrame, pools: DataFrame) -> DataFrame:
    """Every candidate row of every run with ``own``, its strain's likelihood, ``pool``, the mobile one's, and the strain's and the profile's numbers of rows.

    A strain counts once in a profile, by its likeliest row; the pool has half the mean containment, evenly over the genes.
    """
    return sql(
        """WITH x AS (SELECT p.run, r.profile, r.reads, r.strain, r.gene, r.c, greatest(p.pi, 1e-300D) * greatest(r.c, 1e-300D) * greatest(coalesce(p.phi, 1D), 1e-300D) AS x FROM {r} r JOIN {p} p ON p.strain = r.strain AND p.gene <=> r.gene),
                y AS (SELECT *, max(x) OVER (PARTITION BY run, profile, strain) AS own, count(*) OVER (PARTITION BY run, profile, strain) AS k FROM x),
                z AS (SELECT *, sum(own / k) OVER (PARTITION BY run, profile) AS total, avg(c) OVER (PARTITION BY run, profile) AS mean, count(*) OVER (PARTITION BY run, profile) AS kk FROM y)
           SELECT /*+ BROADCAST(m) */ z.run, z.profile, z.reads, z.strain, z.gene, z.x, z.own, z.k, z.kk, m.mobile * 0.5D * z.mean / greatest(m.genes, 1) AS pool, z.total + m.mobile * 0.5D * z.mean / greatest(m.genes, 1) AS total FROM z JOIN {m} m ON m.run = z.run""",
        r=rows, p=params, m=pools,
    )


def expected(rows: DataFrame, params: DataFrame, pools: DataFrame) -> DataFrame:
    """``run, strain, gene, g, s, m, ll, reads``: sums of shares. g counts a strain's share at each of its rows' genes; s, the strain's shares, m, the
    pool's, ll and reads add up to their totals over the rows."""
    return sql(
        """SELECT run, strain, gene, sum(reads * own / total) AS g, sum(reads * own / total / k) AS s, sum(reads * pool / total / kk) AS m, sum(reads * ln(total) / kk) AS ll, sum(reads / kk) AS reads
           FROM {x} GROUP BY run, strain, gene""",
        x=_shares(rows, params, pools),
    )


@dataclass
class State:
    """Parameters of all runs over the grid of strains and genes: ``pi`` by run and strain, ``phi`` by run and cell, the pool's weight by run.

    ``strain`` and ``named`` tell a cell's strain and whether it has a gene; ``a`` and ``b`` are its Beta prior; ``inside`` tells a run's strains.
    """

    strain: np.ndarray
    named: np.ndarray
    a: np.ndarray
    b: np.ndarray
    inside: np.ndarray
    pi: np.ndarray
    phi: np.ndarray
    mobile: np.ndarray
    genes: int

    def shares(self, run: int, block: Block) -> tuple[np.ndarray, np.ndarray, float, float, float]:
        """Of one block: shares by cell and by strain, the pool's share, log-likelihood and reads, as ``expected`` sums them."""
        use = self.inside[run][block.strain]
        if not use.any():
            return np.zeros(len(self.strain)), np.zeros(self.pi.shape[1]), 0.0, 0.0, 0.0
        c, phi = np.maximum(block.c, 1e-300), np.maximum(self.phi[run][block.cell], 1e-300)
        x = np.where(use, np.maximum(self.pi[run][block.strain], 1e-300) * c * phi, 0.0)
        # A strain counts once in a profile, by its likeliest row.
        own = np.maximum.reduceat(x, block.first)
        rows = np.add.reduceat(use, block.start, dtype=np.int64)
        mean = np.add.reduceat(np.where(use, block.c, 0.0), block.start) / np.maximum(rows, 1)
        pool = self.mobile[run] * 0.5 * mean / max(self.genes, 1)
        total = np.add.reduceat(own, block.group) + pool
        reads, total = np.where(rows > 0, block.reads, 0.0), np.where(rows > 0, total, 1.0)
        share = own * np.repeat(reads / total, np.diff(np.append(block.group, len(block.first))))
        by_row = np.repeat(share, np.diff(np.append(block.first, len(x))))
        return (
            np.bincount(block.cell, by_row, len(self.strain)),
            np.bincount(block.strain[block.first], share, self.pi.shape[1]),
            float((reads * pool / total).sum()),
            float((reads * np.log(total)).sum()),
            float(reads.sum()),
        )

    def update(self, run: int, how: Run, g: np.ndarray, s: np.ndarray, pooled: float, use: Settings) -> None:
        """New weights and phi: MAP under the priors, phi from the reads that hit any gene, within 1e-6 of 0 and 1."""
        inside, cells = self.inside[run], self.inside[run][self.strain]
        raw = np.where(inside, np.maximum(s + use.alpha - 1, 1e-10), 0.0)
        pool = max(pooled + use.alpha - 1, 1e-10) if use.mobile else 0.0
        if how.fix_pi:
            raw, pool = inside.astype(float), float(use.mobile)
        whole = raw.sum() + pool
        self.pi[run], self.mobile[run] = raw / whole, pool / whole
        if not how.fix_phi:
            genic = np.bincount(self.strain[self.named], g[self.named], self.pi.shape[1])
            top = np.maximum(g + self.a - 1, 1e-10)
            low = np.maximum(genic[self.strain] + self.a + self.b - 2, top + 1e-10)
            self.phi[run] = np.where(self.named & cells, np.clip(top / low, 1e-6, 1 - 1e-6), 1.0)

    def prior(self, run: int, use: Settings) -> float:
        """Log-density of the priors, up to a constant, with the default Beta on every phi."""
        pi = self.pi[run][self.inside[run]]
        phi = np.clip(self.phi[run][self.named & self.inside[run][self.strain]], 1e-300, 1 - 1e-16)
        pi = np.append(pi, self.mobile[run]) if use.mobile else pi
        return float((use.alpha - 1) * np.log(pi[pi > 1e-300]).sum() + (use.beta[0] - 1) * np.log(phi).sum() + (use.beta[1] - 1) * np.log1p(-phi).sum())


@dataclass
class Block:
    """Whole profiles: reads of each, its first row and first strain; each strain's first row there; and cell, strain and containment of the rows."""

    reads: np.ndarray
    start: np.ndarray
    group: np.ndarray
    first: np.ndarray
    cell: np.ndarray
    strain: np.ndarray
    c: np.ndarray

    @staticmethod
    def of(profile: np.ndarray, reads: np.ndarray, cell: np.ndarray, c: np.ndarray, strain_of: np.ndarray) -> Block:
        strain = strain_of[cell]
        new = np.append(True, profile[1:] != profile[:-1])
        start, first = np.flatnonzero(new), np.flatnonzero(new | np.append(True, strain[1:] != strain[:-1]))
        return Block(reads[start].astype(float), start, np.searchsorted(first, start), first, cell, strain, c)


def packed(rows: DataFrame, grid: pd.DataFrame) -> tuple[DataFrame, int]:
    """Blocks and the number of tasks that they are dealt to. Profiles lie in blocks of about BLOCK_ROWS rows, each as bytes of its rows' profiles, reads, cells of the grid and containments; they are made once and read at every step, so small tables have few tasks."""
    spark, kinds = rows.sparkSession, {f.name: f.dataType.simpleString() for f in rows.schema}
    codes = spark.createDataFrame([(s, g, i) for i, (s, g) in enumerate(zip(grid["strain"], grid["gene"], strict=True))], f"strain {kinds['strain']}, gene {kinds['gene']}, cell int")
    codes = F.broadcast(codes) if len(grid) <= BROADCAST_ROWS else codes
    coded = rows.alias("r").join(codes.alias("k"), (F.col("r.strain") == F.col("k.strain")) & F.col("r.gene").eqNullSafe(F.col("k.gene")))
    n = rows.count()
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-n // 8192)), -(-n // (4 * BLOCK_ROWS)), 1)
    ordered = coded.select("r.profile", F.col("r.reads").cast("long").alias("reads"), "k.cell", "r.c").repartition(tasks, "profile").sortWithinPartitions("profile", "cell")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            parts = [table.column(c).to_numpy() for c in ("profile", "reads", "cell", "c")]
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in parts], ["profile", "reads", "cell", "c"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            profile = table.column("profile").to_numpy()
            # The last profile may go on in the next batch.
            cut = int(np.flatnonzero(np.append(True, profile[1:] != profile[:-1]))[-1])
            if cut:
                yield out(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held))

    return ordered.mapInArrow(pack, "profile binary, reads binary, cell binary, c binary").coalesce(tasks), tasks


def stepped(blocks: DataFrame, tasks: int, state: State, runs: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, float, float, float]]:
    """``State.shares`` of each of ``runs``, summed over all blocks. A task adds up its own; the driver adds up at most COLLECTED numbers of the tasks, more are first added up in Spark."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((state, runs))
    cells, strains = len(state.strain), state.pi.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = shared.value
        sums = np.zeros((len(names), cells + strains + 3))
        for batch in batches:
            for i in range(batch.num_rows):
                profile, reads, cell, c = (np.frombuffer(batch.column(n)[i].as_py(), t) for n, t in (("profile", np.int64), ("reads", np.int64), ("cell", np.int32), ("c", np.float64)))
                block = Block.of(profile, reads, cell, c, own.strain)
                for j, run in enumerate(names):
                    g, s, *rest = own.shares(run, block)
                    sums[j] += np.concatenate([g, s, rest])
        run, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(run.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[run, at])], ["run", "at", "v"])

    found, sums = blocks.mapInArrow(add, "run int, at int, v double"), np.zeros((len(runs), cells + strains + 3))
    if tasks * sums.size > COLLECTED:
        found = found.groupBy("run", "at").agg(F.sum("v").alias("v"))
    found = found.toArrow()
    np.add.at(sums, (found.column("run").to_numpy(), found.column("at").to_numpy()), found.column("v").to_numpy())
    shared.unpersist()
    return {run: (v[:cells], v[cells : cells + strains], *(float(x) for x in v[cells + strains :])) for run, v in zip(runs, sums, strict=True)}


def start(cells: pd.DataFrame, runs: list[Run], use: Settings, reference: pd.DataFrame | None = None) -> tuple[pd.DataFrame, dict[str, float]]:
    """Parameters before the first step. A run without a seed starts evenly, phi at the reference or 0.5; with one, weights come from Dirichlet(alpha + 0.5)
    and phi from the reference give or take 0.1, or from its Beta prior."""
    base = cells.copy()
    if reference is not None:
        base = base.merge(reference.rename(columns={"phi": "ref"})[["strain", "gene", "ref"]], on=["strain", "gene"], how="left")
        base["ref"] = base["ref"].fillna(0.0)
    else:
        base["ref"] = np.nan
    known = base["ref"].notna()
    for i, column in enumerate(("a", "b")):
        base[column] = np.where(~known, use.beta[i], np.where(base["ref"] > 0.5, use.present[i], use.absent[i]))
    out, pools = [], {}
    for run in runs:
        own = base[base["strain"].isin(run.strains)].copy() if run.strains else base.copy()
        strains = sorted(own["strain"].unique())
        n = len(strains) + use.mobile
        if run.seed is None:
            pi, phi = np.full(n, 1.0 / max(n, 1)), np.where(own["ref"].notna(), own["ref"].clip(0.01, 0.99), 0.5)
        else:
            rng = np.random.default_rng(run.seed)
            pi = rng.dirichlet(np.full(n, use.alpha + 0.5)) if n else np.zeros(0)
            phi = np.where(own["ref"].notna(), np.clip(own["ref"] + rng.uniform(-0.1, 0.1, len(own)), 0.01, 0.99), rng.beta(*use.beta, len(own)))
        own.insert(0, "run", run.name)
        own["pi"] = own["strain"].map(dict(zip(strains, pi, strict=False)))
        own["phi"] = np.where(own["gene"].notna(), phi, np.nan)
        pools[run.name] = float(pi[-1]) if use.mobile and n else 0.0
        out.append(own.drop(columns="ref"))
    return pd.concat(out, ignore_index=True) if out else base.assign(run="", pi=0.0, phi=0.0), pools


def tables(rows: DataFrame, params: pd.DataFrame, mobile: dict[str, float], genes: int) -> tuple[DataFrame, DataFrame]:
    spark, kinds = rows.sparkSession, {f.name: f.dataType.simpleString() for f in rows.schema}
    clean = [(r.run, r.strain, None if pd.isna(r.gene) else r.gene, float(r.pi), None if pd.isna(r.phi) else float(r.phi)) for r in params.itertuples()]
    params = spark.createDataFrame(clean, f"run string, strain {kinds['strain']}, gene {kinds['gene']}, pi double, phi double")
    return (
        F.broadcast(params) if len(clean) <= BROADCAST_ROWS else params,
        spark.createDataFrame([(k, v, genes) for k, v in mobile.items()], "run string, mobile double, genes int"),
    )


def cells(rows: DataFrame) -> pd.DataFrame:
    """Every strain with every gene of the candidates, and with none where some rows have none."""
    found = rows.select("strain", "gene").distinct().collect()
    strains, genes = sorted({r["strain"] for r in found}), sorted({r["gene"] for r in found if r["gene"] is not None})
    return pd.DataFrame([(s, g) for s in strains for g in [*genes, *([None] if any(r["gene"] is None for r in found) else [])]], columns=["strain", "gene"], dtype=object)


def fit_runs(rows: DataFrame, runs: list[Run], use: Settings | None = None, reference: pd.DataFrame | None = None) -> Fit:
    """All runs over saved ``profiles`` until each has converged, which is asked before each update, or ``max_iter`` steps are done.

    A run stops changing once converged; ``converged`` tells which did. Without candidates a run has no likelihood (minus infinity), an infinite BIC and has not converged.
    """
    use = use or Settings()
    grid = cells(rows)
    genes = int(grid["gene"].nunique())
    params, mobile = start(grid, runs, use, reference)
    fit = Fit(params, mobile, {r.name: -math.inf for r in runs}, {r.name: math.inf for r in runs}, {r.name: 0.0 for r in runs}, {r.name: [] for r in runs}, {r.name: False for r in runs})
    strains = sorted(grid["strain"].unique())
    if strains:
        number = {v: i for i, v in enumerate(strains)}
        # Each run's rows of params are its part of the grid, in the grid's order.
        own = [np.flatnonzero(grid["strain"].isin(r.strains)) if r.strains else np.arange(len(grid)) for r in runs]
        state = State(grid["strain"].map(number).to_numpy(int), grid["gene"].notna().to_numpy(), np.zeros(len(grid)), np.zeros(len(grid)), np.zeros((len(runs), len(strains)), bool), np.zeros((len(runs), len(strains))), np.ones((len(runs), len(grid))), np.array([mobile[r.name] for r in runs]), genes)
        for i, (run, at) in enumerate(zip(runs, own, strict=True)):
            part = params[params["run"] == run.name]
            state.a[at], state.b[at] = part["a"].to_numpy(float), part["b"].to_numpy(float)
            state.inside[i, state.strain[at]] = True
            state.pi[i, state.strain[at]] = part["pi"].to_numpy(float)
            state.phi[i, at] = part["phi"].fillna(1.0).to_numpy(float)
        blocks, tasks = packed(rows, grid)
        blocks = blocks.persist()
        active = [i for i, at in enumerate(own) if len(at)]
        try:
            for _ in range(use.max_iter):
                if not active:
                    break
                going = []
                for i, (g, s, pooled, ll, reads) in stepped(blocks, tasks, state, active).items():
                    name = runs[i].name
                    if not reads:
                        continue
                    fit.reads[name], fit.ll[name] = reads, ll + state.prior(i, use)
                    trace = fit.traces[name]
                    trace.append(fit.ll[name])
                    if len(trace) < 2 or abs(trace[-1] - trace[-2]) >= use.tolerance * (abs(trace[-2]) or 1.0):
                        going.append(i)
                        state.update(i, runs[i], g, s, pooled, use)
                    else:
                        fit.converged[name] = True
                active = going
        finally:
            blocks.unpersist()
        done = []
        for i, (run, at) in enumerate(zip(runs, own, strict=True)):
            part = params[params["run"] == run.name].copy()
            part["pi"], part["phi"] = state.pi[i, state.strain[at]], np.where(state.named[at], state.phi[i, at], np.nan)
            done.append(part)
        fit.params, fit.mobile = pd.concat(done, ignore_index=True), {r.name: float(m) for r, m in zip(runs, state.mobile, strict=True)}
    params = fit.params
    for run in runs:
        if fit.reads[run.name]:
            k = params[params["run"] == run.name]["strain"].nunique()
            fit.bic[run.name] = -2 * fit.ll[run.name] + (k - 1 + k * genes + use.mobile) * math.log(max(fit.reads[run.name], 1))
    return fit


def restarts(n: int = RESTARTS, seed: int = 42, of: Run | None = None) -> list[Run]:
    """An even start and n - 1 random ones; of a given run, they are named by it and a slash."""
    name = f"{of.name}/" if of else ""
    return [replace(of or Run(""), name=f"{name}{i}", seed=seed + i if i else None) for i in range(n)]


#: A fit for each question of the ablation.
ABLATIONS = [Run("joint"), Run("strain_only", fix_phi=True), Run("function_only", fix_pi=True)]


def presence(params: pd.DataFrame) -> pd.DataFrame:
    """phi over the median of a strain's values above 1e-4, so that 0.5 tells presence; within 1e-6 of 0 and 1."""
    out = params.copy()
    positive = out["phi"].where(out["phi"] > 1e-4)
    middle = positive.groupby([out["run"], out["strain"]]).transform("median")
    out["phi"] = (out["phi"] / middle.where(middle > 1e-6, 1.0).fillna(1.0)).clip(1e-6, 1 - 1e-6)
    return out


def even_profile(strains: list, genes: list, mobile: bool = True) -> pd.DataFrame:
    """What is known of strains without a read: even weights between 0 and 1, every phi 0.5 between 0 and 1, an infinite BIC, no convergence."""
    weight = 1 / max(len(strains) + mobile, 1)
    rows = [(s, g, weight, 0.5, 0.0, 1.0, 0.0, 1.0, weight * mobile, -math.inf, math.inf, False) for s in strains for g in genes]
    return pd.DataFrame(rows, columns=["strain", "gene", "pi", "phi", "lo", "hi", "phi_lo", "phi_hi", "mobile", "ll", "bic", "converged"])


def fit(candidates: DataFrame, n: int = RESTARTS, use: Settings | None = None, reference: pd.DataFrame | None = None, strains: list | None = None, genes: list | None = None) -> DataFrame:
    """``strain, gene, pi, phi, lo, hi, phi_lo, phi_hi, mobile, ll, bic, converged`` of the best restart.

    lo and hi bound pi by its diagonal information n_k / pi^2 + 1e-6; phi's bounds are quantiles of its Beta posterior. Without candidates it is empty, or the ``even_profile`` of ``strains`` and ``genes`` where they are named.
    ``converged`` is false where ``max_iter`` cut the restart short.
    """
    use = use or Settings()
    spark = candidates.sparkSession
    rows = saved_profiles(candidates, use.least)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"strain {kinds['strain']}, gene {kinds['gene']}, pi double, phi double, lo double, hi double, phi_lo double, phi_hi double, mobile double, ll double, bic double, converged boolean"
    if strains and genes and rows.isEmpty():
        return spark.createDataFrame(even_profile(strains, genes, use.mobile).itertuples(index=False, name=None), schema)
    done = fit_runs(rows, restarts(n), use, reference)
    best = done.best
    own = presence(done.params[done.params["run"] == best])
    count, pi = done.reads[best], own["pi"].to_numpy(float)
    se = 1 / np.sqrt(count * pi / np.maximum(pi, 1e-10) ** 2 + 1e-6)
    own["lo"], own["hi"] = np.maximum(pi - 1.96 * se, 0.0), np.minimum(pi + 1.96 * se, 1.0)
    phi = own["phi"].fillna(0.5).to_numpy(float)
    a, b = phi * count * pi + own["a"].to_numpy(float), (1 - phi) * count * pi + own["b"].to_numpy(float)
    own["phi_lo"], own["phi_hi"] = special.beta_ppf(0.025, a, b), special.beta_ppf(0.975, a, b)
    named = own["phi"].notna()
    values = own[["strain", "gene", "pi", "phi", "lo", "hi", "phi_lo", "phi_hi"]].itertuples(index=False)
    out = [(r[0], r[1] if n else None, r[2], r[3] if n else None, r[4], r[5], r[6] if n else None, r[7] if n else None, done.mobile[best], done.ll[best], done.bic[best], done.converged[best]) for r, n in zip(values, named, strict=True)]
    return spark.createDataFrame(out, schema)


def select_strains(candidates: DataFrame, use: Settings | None = None, most: int | None = None, n: int = RESTARTS) -> DataFrame:
    """``k, ll, bic, chosen, converged``: the best restart with the k strains with most containment, for every k, fitted at once; the smallest BIC is chosen."""
    use = use or Settings()
    rows = saved_profiles(candidates, use.least)
    order = [r["strain"] for r in rows.groupBy("strain").agg(F.sum(F.col("reads") * F.col("c")).alias("x")).orderBy(F.desc("x"), "strain").collect()][:most]
    done = fit_runs(rows, [r for k in range(1, len(order) + 1) for r in restarts(n, of=Run(str(k), tuple(order[:k])))], use)
    best = {k: done.best_of(str(k)) for k in range(1, len(order) + 1)}
    least = min((done.bic[b] for b in best.values()), default=math.inf)
    out = [(k, done.ll[b], done.bic[b], done.bic[b] == least, done.converged[b]) for k, b in best.items()]
    return candidates.sparkSession.createDataFrame(out, "k int, ll double, bic double, chosen boolean, converged boolean")


def ablate(candidates: DataFrame, use: Settings | None = None, reference: pd.DataFrame | None = None, n: int = RESTARTS) -> DataFrame:
    """``run, strain, gene, pi, phi, converged`` of the joint fit, of one with phi fixed, and of one with even weights, each the best of its restarts."""
    use = use or Settings()
    rows = saved_profiles(candidates, use.least)
    done = fit_runs(rows, [r for run in ABLATIONS for r in restarts(n, of=run)], use, reference)
    best = {done.best_of(run.name): run.name for run in ABLATIONS}
    own = done.params[done.params["run"].isin(best)]
    params, _ = tables(rows, presence(own.assign(run=own["run"].map(best))), done.mobile, 0)
    return params.withColumn("converged", F.col("run").isin([name for b, name in best.items() if done.converged[b]]))


def assign(rows: DataFrame, done: Fit, genes: int) -> DataFrame:
    """``profile, reads, strain, posterior, gene, is_mobile`` of the best run: the likeliest strain, the gene of its likeliest row, and whether the pool is likelier."""
    best = done.best
    params, pools = tables(rows, done.params[done.params["run"] == best], {best: done.mobile[best]}, genes)
    return sql(
        """SELECT profile, reads, strain, own / total AS posterior, gene, pool > own AS is_mobile
           FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY own DESC, strain, x DESC, gene) AS rn FROM {x}) WHERE rn = 1""",
        x=_shares(rows, params, pools),
    )


def identifiability(weights: DataFrame) -> DataFrame:
    """``a, b, score`` of every pair of strains in ``(strain, pi, reads)``: the larger of the pair's smaller information and the smallest of all."""
    return sql(
        """WITH f AS (SELECT strain, reads / pow(greatest(pi, 1e-10D), 2) + 1e-6D AS f FROM {w})
           SELECT x.strain AS a, y.strain AS b, greatest(least(x.f, y.f), (SELECT min(f) FROM f)) AS score FROM f x JOIN f y ON x.strain < y.strain""",
        w=weights,
    )
