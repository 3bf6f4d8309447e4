"""Simulated reads: a seed for each sequence, so a partition's loss changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.functions.frames import sql

#: Reads that a task holds at once.
HELD = 10_000


def reads(sequences: DataFrame, each: int, length: int = 150, error: float = 0.001, seed: int = 42) -> DataFrame:
    """``read_id, id, start, sequence, errors``: ``each`` reads from random places of every sequence, bases replaced at the error rate."""
    kind = sequences.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bases = np.frombuffer(b"ACGT", np.uint8)
        frame = lambda out: pd.DataFrame(out, columns=["read_id", "id", "start", "sequence", "errors"])
        for pdf in batches:
            out = []
            for i, s in zip(pdf["id"], pdf["sequence"], strict=True):
                raw = np.frombuffer(s.encode(), np.uint8)
                rng = np.random.default_rng([seed, *str(i).encode()])
                n = min(length, len(raw))
                for r, at in enumerate(rng.integers(0, len(raw) - n + 1, each) if len(raw) else []):
                    read = raw[at : at + n].copy()
                    hit = rng.random(n) < error
                    code = np.searchsorted(bases, read[hit])
                    read[hit] = bases[(code + rng.integers(1, 4, int(hit.sum()))) % 4]
                    out.append((f"{i}_{r}", i, int(at), read.tobytes().decode(), int(hit.sum())))
                    # A batch of sequences has `each` times as many reads, which are not all held at once.
                    if len(out) >= HELD:
                        yield frame(out)
                        out = []
            yield frame(out)

    return sequences.select("id", "sequence").mapInPandas(run, f"read_id string, id {kind}, start long, sequence string, errors long")


def composition(spec: str) -> dict[str, float]:
    """``a:0.7,b:0.3`` as weights; parts without a number are left out."""
    out = {}
    for part in spec.split(","):
        name, _, value = part.partition(":")
        try:
            out[name.strip()] = float(value)
        except ValueError:
            continue
    return out


_UNIFORM = "cast(conv(substring(md5(concat({seed}, ':', marker, ':', n, ':{tag}')), 1, 13), 16, 10) AS DOUBLE) / 4503599627370496D"


def mixture_reads(references: DataFrame, weights: DataFrame, each: int, length: int = 150, error: float = 0.0, yields: DataFrame | None = None, bias: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``marker, n, species, start, sequence``: ``each`` reads of every marker, species drawn by weight times yield times the marker's bias.

    ``references(species, marker, sequence)`` has one sequence for a pair; a species without one, or a weight, is not drawn. ``weights(species, w)``,
    ``yields(species, d)`` and ``bias(species, marker, b)`` are 1 where absent, weights 0. A read no longer than its reference begins at a random place. A base
    becomes another at the error rate. Every number is a hash of seed, marker and read, so a lost task draws the same again.
    """
    p = references.select("species", "marker").distinct().join(weights.select("species", "w"), "species", "left")
    p = p.join(yields.select("species", "d"), "species", "left") if yields is not None else p.withColumn("d", F.lit(1.0))
    p = p.join(bias.select("species", "marker", "b"), ["species", "marker"], "left") if bias is not None else p.withColumn("b", F.lit(1.0))
    wrong = f"pmod(xxhash64({int(seed)}, marker, n, i, 'e'), 1000000007) < {float(error)!r} * 1000000007"
    base = f"CASE WHEN {wrong} AND locate(c, 'ACGT') > 0 THEN substring('ACGT', cast(pmod(locate(c, 'ACGT') + pmod(xxhash64({int(seed)}, marker, n, i, 'b'), 3), 4) + 1 AS INT), 1) ELSE c END"
    read = f"array_join(transform(split(piece, ''), (c, i) -> {base}), '')" if error else "piece"
    return sql(
        f"""WITH x AS (SELECT species, marker, coalesce(w, 0D) * coalesce(d, 1D) * coalesce(b, 1D) AS x FROM {{p}}),
                 c AS (SELECT species, marker, sum(x) OVER (PARTITION BY marker ORDER BY species) / sum(x) OVER (PARTITION BY marker) AS c FROM x WHERE x > 0),
                 m AS (SELECT marker, array_sort(collect_list(struct(c, species))) AS choices FROM c GROUP BY marker),
                 u AS (SELECT marker, r.id AS n, choices, {_UNIFORM.format(seed=int(seed), tag="s").replace("n,", "r.id,")} AS u FROM {{r}} r CROSS JOIN m),
                 s AS (SELECT marker, n, coalesce(get(filter(choices, q -> u <= q.c), 0), element_at(choices, -1)).species AS species FROM u),
                 t AS (SELECT s.marker, s.n, s.species, f.sequence, length(f.sequence) AS size FROM s JOIN {{f}} f ON f.species = s.species AND f.marker = s.marker),
                 a AS (SELECT marker, n, species, sequence, CASE WHEN size > {int(length)} THEN cast(floor({_UNIFORM.format(seed=int(seed), tag="p")} * (size - {int(length)})) AS LONG) ELSE 0L END AS start FROM t),
                 b AS (SELECT marker, n, species, start, substring(sequence, cast(start + 1 AS INT), {int(length)}) AS piece FROM a)
            SELECT marker, n, species, start, {read} AS sequence FROM b""",
        p=p, r=references.sparkSession.range(each), f=references.select("species", "marker", "sequence"),
    )


def known(weights: dict[str, float], species: set[str]) -> tuple[dict[str, float], list[str]]:
    """A composition's weights of known species, and the names that are not."""
    return {k: v for k, v in weights.items() if k in species}, sorted(set(weights) - species)
