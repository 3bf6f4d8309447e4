"""Simulated strains and metagenome reads with their truths.

Strains differ from a template at a rate of 1 - ANI and carry genes at shared places. Every choice about a read is a hash of the seed and the
read's number, so any number of reads is made in parallel and a lost task makes the same ones again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.functions.frames import sql

_BASES = np.frombuffer(b"ACGT", np.uint8)


@dataclass(frozen=True)
class Scenario:
    strains: int = 3
    genome_length: int = 50_000
    genes: int = 10
    gene_length: int = 1000
    mobile: float = 0.2
    accessory: float = 0.3
    ani: float = 0.995
    reads: int = 10_000
    read_length: int = 150
    error: float = 0.005
    hidden: float = 0.0
    seed: int = 42
    abundances: tuple[float, ...] = ()


def mutate(sequence: np.ndarray, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Bases in ASCII, each replaced by another one at the rate."""
    out = sequence.copy()
    hit = np.flatnonzero(rng.random(len(out)) < rate)
    out[hit] = _BASES[(np.searchsorted(_BASES, out[hit]) + rng.integers(1, 4, len(hit))) % 4]
    return out


def genomes(spark: SparkSession, s: Scenario) -> DataFrame:
    """``strain, sequence``: a mutated copy of the template for every strain, each by its own seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            template = _BASES[np.random.default_rng([s.seed, 0]).integers(0, 4, s.genome_length)]
            made = [mutate(template, 1 - s.ani, np.random.default_rng([s.seed, 1, int(i)])).tobytes().decode() for i in pdf["id"]]
            yield pd.DataFrame({"strain": [f"strain_{i:03d}" for i in pdf["id"]], "sequence": made})

    return spark.range(s.strains).mapInPandas(run, "strain string, sequence string")


def layout(s: Scenario) -> list[tuple[str, int, int, bool, bool]]:
    """``(gene, start, end, is_mobile, is_accessory)``: genes in equal stretches of the genome, jittered, as many as fit."""
    n = min(s.genes, s.genome_length // (s.gene_length + 1))
    if n <= 0:
        return []
    rng, room = np.random.default_rng([s.seed, 2]), s.genome_length // n
    starts = [min(i * room + int(rng.integers(0, max(1, room - s.gene_length))), s.genome_length - s.gene_length) for i in range(n)]
    order = rng.permutation(n)
    mobile, accessory = set(order[: max(1, round(n * s.mobile))]), set(order[: round(n * s.accessory)])
    return [(f"gene_{i:03d}", at, at + s.gene_length, i in mobile, i in accessory) for i, at in enumerate(sorted(starts))]


def annotations(spark: SparkSession, s: Scenario) -> DataFrame:
    """``strain, gene, start, end, is_mobile`` of carried genes: core ones by all, accessory ones by half of the strains, at least by one."""
    rng, rows = np.random.default_rng([s.seed, 3]), []
    for gene, start, end, is_mobile, is_accessory in layout(s):
        carried = rng.random(s.strains) < 0.5 if is_accessory else np.ones(s.strains, bool)
        if s.strains and not carried.any():
            carried[rng.integers(s.strains)] = True
        rows += [(f"strain_{i:03d}", gene, start, end, is_mobile) for i in np.flatnonzero(carried)]
    return spark.createDataFrame(rows, "strain string, gene string, start int, `end` int, is_mobile boolean")


def weights(s: Scenario) -> list[float]:
    """The given abundances scaled to 1, or a draw from an even Dirichlet."""
    if s.abundances and len(s.abundances) != s.strains:
        raise ValueError("there must be an abundance for every strain")
    raw = np.array(s.abundances, float) if s.abundances else np.random.default_rng([s.seed, 4]).dirichlet(np.ones(s.strains))
    return [float(x) for x in raw / raw.sum()]


def abundance_table(spark: SparkSession, s: Scenario) -> DataFrame:
    """``strain, pi, in_db``: strains with their weights; the hidden part, chosen at random, is left out of references."""
    hidden = set(np.random.default_rng([s.seed, 5]).permutation(s.strains)[: round(s.strains * s.hidden)].tolist())
    return spark.createDataFrame([(f"strain_{i:03d}", w, i not in hidden) for i, w in enumerate(weights(s))], "strain string, pi double, in_db boolean")


def origins(spark: SparkSession, s: Scenario) -> DataFrame:
    """``read_id, strain, start``: where each read comes from; genomes are circular."""
    edges = np.cumsum(weights(s))
    strain = F.lit(s.strains - 1)
    for i in range(s.strains - 2, -1, -1):
        strain = F.when(F.col("u") <= float(edges[i]), i).otherwise(strain)
    rows = spark.range(s.reads).withColumn("u", F.pmod(F.xxhash64("id", F.lit(s.seed), F.lit(1)), F.lit(2**53)) / float(2**53))
    return rows.select(F.format_string("read_%07d", "id").alias("read_id"), F.format_string("strain_%03d", strain).alias("strain"), F.pmod(F.xxhash64("id", F.lit(s.seed), F.lit(2)), F.lit(s.genome_length)).cast("int").alias("start"))


def with_genes(reads: DataFrame, genes: DataFrame, length: int, bin_size: int = 1000) -> DataFrame:
    """``read_id, strain, start, gene``: the first gene, by start, of its strain that a read overlaps; null without one.

    Of the genes that end after a read's start, the first one is overlapped if it starts before the read's end, and else none is. So genes by their ends and reads by their
    starts are put in one order, from the last to the first, and a read takes the smallest gene so far; no pair of a read and a gene is a row. A read is in the
    bin of its start, a gene in every bin with starts of reads that overlap it, so that a long strain is dealt out.
    """
    return sql(
        """WITH a AS (SELECT strain, cast(floor(start / {w}) AS BIGINT) AS bin, cast(start AS BIGINT) AS at, read_id, start, NULL AS gene FROM {r}
                      UNION ALL SELECT strain, explode(sequence(cast(floor((start - {n} + 1) / {w}) AS BIGINT), cast(floor((`end` - 1) / {w}) AS BIGINT))) AS bin, `end`, NULL, NULL, struct(start, gene)
                      FROM {g} WHERE `end` > start - {n} + 1 AND strain IS NOT NULL AND gene IS NOT NULL),
                f AS (SELECT *, min(gene) OVER (PARTITION BY strain, bin ORDER BY at DESC, gene NULLS FIRST ROWS UNBOUNDED PRECEDING) AS first FROM a)
           SELECT read_id, strain, start, CASE WHEN first.start < start + {n} THEN first.gene END AS gene FROM f WHERE gene IS NULL GROUP BY strain, bin, read_id, start, first""",
        r=reads, g=genes, n=length, w=bin_size,
    )


def fragments(reads: DataFrame, strains: DataFrame, length: int, piece: int = 4096) -> DataFrame:
    """``read_id, strain, start, sequence`` cut from the circular genomes, whose overlapping pieces are joined by strain and number."""
    return sql(
        """WITH w AS (SELECT strain, concat(sequence, substring(sequence, 1, {n})) AS s, length(sequence) AS size FROM {s}),
                p AS (SELECT strain, i, substring(s, cast(i * {p} + 1 AS INT), {p} + {n}) AS piece FROM (SELECT *, explode(sequence(0, (size - 1) div {p})) AS i FROM w WHERE size > 0))
           SELECT r.read_id, r.strain, r.start, substring(p.piece, cast(r.start % {p} + 1 AS INT), {n}) AS sequence FROM {r} r JOIN p ON p.strain = r.strain AND p.i = r.start div {p}""",
        r=reads, s=strains, n=length, p=piece,
    )


def _rates(n: int, rate: float) -> np.ndarray:
    """The rate at each place of a read: from half of the mean to one and a half."""
    return rate * (0.5 + np.arange(n) / max(n - 1, 1)) if n > 1 else np.full(n, rate)


def _flawed(ids: list[str], texts: list[bytes], rate: float, seed: int) -> tuple[list[bytes], list[bytes]]:
    """Reads with errors and their qualities: of errors, 90 % replace, 5 % insert and 5 % delete.

    Each read's draws are from a generator of its own, as many as it needs and in the order of its steps; all else is done for all reads at once.
    """
    # The words that default_rng makes of [seed, *bytes], without a conversion of each.
    head = np.array([seed >> at & 0xFFFFFFFF for at in range(0, max(seed.bit_length(), 1), 32)], np.uint32)
    rngs = [np.random.Generator(np.random.PCG64(np.concatenate([head, np.frombuffer(i.encode(), np.uint8)], dtype=np.uint32))) for i in ids]
    sizes = np.array([len(t) for t in texts])
    known = {n: _rates(n, rate) for n in set(sizes.tolist())}
    at, base = np.concatenate([known[n] for n in sizes.tolist()]), np.frombuffer(b"".join(texts), np.uint8).copy()
    draws = [rng.random(2 * n) for rng, n in zip(rngs, sizes.tolist(), strict=True)]
    u, v = np.concatenate([x[:n] for x, n in zip(draws, sizes, strict=True)]), np.concatenate([x[n:] for x, n in zip(draws, sizes, strict=True)])
    kind, hit = np.zeros(len(base), np.int8), np.flatnonzero(u < at)
    kind[hit] = 1 + np.searchsorted([0.9, 0.95], v[hit], side="right")
    owner = np.searchsorted(np.cumsum(sizes), hit, side="right")
    swaps, more, fewer = (np.bincount(owner[kind[hit] == k], minlength=len(ids)) for k in (1, 2, 3))
    ends = np.cumsum(sizes + more - fewer)
    noise, drop, other, new = np.empty(int(ends[-1])), np.zeros(int(ends[-1])), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rng, replaced, added, first, end in zip(rngs, swaps.tolist(), more.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        if replaced:
            other.append(rng.integers(1, 4, replaced))
        if added:
            new.append(rng.integers(0, 4, added))
        rng.standard_normal(out=noise[first:end])
        if replaced or added:
            drop[first:end] = rng.uniform(5, 15, end - first)
    swap = kind == 1
    base[swap] = _BASES[(np.searchsorted(_BASES, base[swap]) + np.concatenate(other)) % 4]
    # A place gives one base, two where one is inserted before it, none where it is deleted.
    place = np.repeat(np.arange(len(base)), np.where(kind == 2, 2, np.where(kind == 3, 0, 1)))
    first = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
    made = (kind[place] == 2) & first
    out = base[place]
    out[made] = _BASES[np.concatenate(new)]
    q = -10 * np.log10(np.maximum(at[place], 1e-9)) + 2.0 * noise - np.where(made | (kind[place] == 1), drop, 0.0)
    read, quality = out.tobytes(), (np.clip(np.rint(q), 2, 41).astype(np.uint8) + 33).tobytes()
    spans = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    return [read[a:b] for a, b in spans], [quality[a:b] for a, b in spans]


#: Bases of the reads that get their errors at once, about.
_TOGETHER = 1 << 17


def with_errors(reads: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """``read_id, sequence, quality`` of error-free reads, each with a generator of the seed and its id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [s.encode() for s in pdf["sequence"]]
            part = np.cumsum([len(t) for t in texts]) // _TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    ids = pdf["read_id"].iloc[a:b]
                    made, quality = _flawed(ids.tolist(), texts[a:b], rate, seed)
                    yield pd.DataFrame({"read_id": ids, "sequence": [x.decode() for x in made], "quality": [x.decode() for x in quality]})

    return reads.select("read_id", "sequence").mapInPandas(run, "read_id string, sequence string, quality string")


def simulate(spark: SparkSession, s: Scenario) -> dict[str, DataFrame]:
    """Tables of a scenario: ``genomes``, ``genes``, ``abundances``, ``truth`` by read, ``reads``, and ``references``, the genomes of strains not hidden."""
    made, genes, weight, at = genomes(spark, s), annotations(spark, s), abundance_table(spark, s), origins(spark, s)
    return {
        "genomes": made,
        "genes": genes,
        "abundances": weight,
        "truth": with_genes(at, genes, s.read_length),
        "reads": with_errors(fragments(at, made, s.read_length), s.error, s.seed),
        "references": made.join(weight.where("in_db").select("strain"), "strain", "left_semi"),
    }
