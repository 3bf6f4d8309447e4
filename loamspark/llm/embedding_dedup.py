"""Near-duplicate embeddings by collision counting over one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, vectors
from .shared import connected_components, written

#: Cosine from which two vectors are linked.
LEAST = 0.95
#: Chance, for a pair at that cosine itself, to meet in a bucket; closer pairs meet more often.
MEETING = 0.998
#: Width of a bucket's window in each of its projections; a unit vector's projection has a deviation of 1.
WIDTH = 2.4
#: Vectors that meet in a bucket without being close, about; it sets the number of projections of a bucket.
STRANGERS = 256
#: Projections whose query-centred windows are counted, half their width, and the count's calibrated chance to lose a pair at LEAST.
COUNTED = 32
HALF_WINDOW = 0.55
LOST = 5e-4
#: Rows of a bucket that are compared in one task; larger buckets are dealt to tasks by pairs of parts.
BUCKET_ROWS = 1024
BROADCAST_KEYS = 100_000
_GRAIN = 0.01


def same_window(deviation: float, width: float = WIDTH) -> float:
    """The chance that two values, apart by a normal of this deviation, fall into one window of a randomly shifted row of windows."""
    z = width / deviation
    return 1 - 2 * NormalDist().cdf(-z) - 2 / (math.sqrt(2 * math.pi) * z) * (1 - math.exp(-z * z / 2))


@dataclass(frozen=True)
class Plan:
    """Buckets a vector has, projections of each, and the collisions that a pair needs to be verified."""

    buckets: int
    depth: int
    count: int


def plan(n: int, least: float = LEAST) -> Plan:
    """From the number of vectors: depth, so that about STRANGERS meet by chance; buckets, for the recall MEETING; the count, by the binomial tail."""
    apart = math.sqrt(2 - 2 * least)
    depth = max(0, math.ceil(math.log(max(n, 1) / STRANGERS) / -math.log(same_window(math.sqrt(2)))))
    meet = same_window(apart) ** depth
    buckets = 1 if meet > MEETING else math.ceil(math.log(1 - MEETING) / math.log(1 - meet))
    hit = 2 * NormalDist().cdf(HALF_WINDOW / apart) - 1
    tail, count = 0.0, 0
    while True:
        tail += math.comb(COUNTED, count) * hit**count * (1 - hit) ** (COUNTED - count)
        if tail > LOST:
            return Plan(buckets, depth, count)
        count += 1


def project(x: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bucket keys and its counted projections in grains; fixed seeds make them equal on every worker."""
    size = x.shape[1]
    rng = np.random.default_rng([size, 11])
    deep = rng.standard_normal((size, p.buckets * p.depth))
    shift = rng.random(p.buckets * p.depth) * WIDTH
    counted = np.random.default_rng([size, 12]).standard_normal((size, COUNTED))
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    cells = np.floor((u @ deep + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), p.buckets, p.depth)
    keys = np.broadcast_to(np.arange(1, p.buckets + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size), (len(x), p.buckets)).copy()
    for j in range(p.depth):
        keys = (keys ^ cells[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64), np.clip(np.round(u @ counted / _GRAIN), -32_000, 32_000).astype(np.int16)


def close_pairs(x: np.ndarray, projected: np.ndarray, keys: np.ndarray, bucket: np.ndarray, side: np.ndarray | None, p: Plan, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of one bucket's rows that no earlier bucket has.

    Counts, for every pair, the projections in which one lies in the window about the other; pairs with the calibrated count
    are verified by their cosine in double precision. With sides, only rows of different sides are paired.
    """
    n = len(x)
    norm = np.sqrt((x * x).sum(axis=1))
    half = round(HALF_WINDOW / _GRAIN)
    columns = np.ascontiguousarray(projected.T)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, n, 256):
        stop = min(n, at + 256)
        count = np.zeros((stop - at, n - at), np.uint8)
        for c in columns:
            count += np.abs(c[at:stop, None] - c[None, at:]) <= half
        i, j = np.nonzero(count >= p.count)
        i, j = i + at, j + at
        keep = i < j
        if side is not None:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        for a in range(0, len(i), 1 << 17):
            y, z = i[a : a + (1 << 17)], j[a : a + (1 << 17)]
            first = (keys[y] == keys[z]).argmax(axis=1) == bucket[y]
            y, z = y[first], z[first]
            near = (x[y] * x[z]).sum(axis=1) / (norm[y] * norm[z]) >= least
            found.append((y[near], z[near]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each node of the graph reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(reps: DataFrame, p: Plan) -> DataFrame:
    """``id, links, other``: rows of each bucket with their links (copies counted) and a row that links reach; their sum and union hold for all."""
    kind = next(f.dataType.elementType.simpleString() for f in reps.schema if f.name == "embedding")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = vectors.lengths(batch.column("embedding"))
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = vectors.matrix(part.column("embedding"))
                keys, projected = project(x, p)
                n = len(x)
                rows = pa.array(np.repeat(np.arange(n), p.buckets))
                raw = lambda m: blocks.binaries(np.ascontiguousarray(m).view(np.uint8).reshape(-1), np.arange(n + 1) * m.shape[1] * m.itemsize).take(rows)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)), pa.array(np.tile(np.arange(p.buckets, dtype=np.int32), n)), part.column("id").take(rows), part.column("copies").take(rows), raw(x.astype(np.float32 if kind == "float" else np.float64)), raw(keys), raw(projected)],
                    ["key", "bucket", "id", "copies", "vector", "keys", "projected"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.runs(batches, ["key", "part"]):
            starts = blocks.run_starts(table, ["key", "part"])
            out: list[tuple] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                rows = table.slice(a, b - a)
                x = blocks.fixed(rows.column("vector"), np.float32 if kind == "float" else np.float64).astype(np.float64)
                ids, copies, own = (rows.column(c).to_numpy() for c in ("id", "copies", "own"))
                crossed = rows.column("crossed")[0].as_py()
                i, j = close_pairs(x, blocks.fixed(rows.column("projected"), np.int16), blocks.fixed(rows.column("keys"), np.int64), rows.column("bucket").to_numpy(), own if crossed else None, p)
                if not len(i):
                    continue
                links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
                hit = np.flatnonzero(links)
                out.append((ids[hit], links[hit].astype(np.int64), ids[roots(len(x), i, j)[hit]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "links", "other"])

    schema = "key long, bucket int, id long, copies long, vector binary, keys binary, projected binary"
    keyed = reps.mapInArrow(explode, schema)
    # A sixteenth of the ids tells which buckets to split; it decides where pairs are compared, never whether.
    large = reps.where("pmod(xxhash64(id), 16) = 0").mapInArrow(explode, schema).groupBy("key").count().where(F.col("count") * 16 > BUCKET_ROWS)
    large = written(large.select("key", F.ceil(F.col("count") * 16 / BUCKET_ROWS).cast("int").alias("k")), "large")
    # One pass deals all rows: those of small buckets to their one part, those of large ones to every pair of parts that holds theirs.
    large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    k = F.coalesce("k", F.lit(1))
    dealt = keyed.join(large, "key", "left").withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), "k").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    part = F.least("own", "other").cast("long") * F.col("k") + F.greatest("own", "other")
    rows = dealt.withColumns({"part": part, "crossed": F.col("own") != F.col("other")}).drop("k", "other")
    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return ordered.mapInArrow(compare, "id long, links long, other long")


def dedup(table: DataFrame, least: float = LEAST) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: cosine links of at least LEAST.

    Equal vectors are one from the start, with their number of copies, so they cost no pairs. Each distinct vector falls into ``plan``'s
    buckets, windows of several random projections at once; within a bucket, pairs that collide often enough in the
    query-centred windows of COUNTED further projections are verified in double precision. A pair counts in the first bucket that
    it shares, so links are counted once and no pair is ever shuffled: a bucket emits one row for each of its linked vectors.
    ``n_links`` counts other rows, ``component_id`` is the smallest id that links reach, ``kept`` tells the rows that it names.
    Vectors that are null, empty, zero or hold null or non-finite components have no links and are kept; so are rows without
    id, whose component is null. Vectors are compared with those of their own length. Other columns are not read; an
    empty table gives an empty one.
    """
    if least != LEAST:
        raise ValueError("plans are calibrated for LEAST")
    rows = vectors.keyed(table)
    grouped = rows.where("ok").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "embedding")).alias("first"), F.count("*").alias("copies"))
    reps = written(grouped.select("h1", "h2", F.col("first.vec_id").alias("id"), F.col("first.embedding").alias("embedding"), "copies"), "vectors")
    found = written(_links(reps.select("id", "embedding", "copies"), plan(reps.count())), "links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found, "id", "other").withColumnRenamed("node", "id")
    facts = reps.select("h1", "h2", "id", "copies").join(linked, "id", "left").join(component, "id", "left")
    facts = facts.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"), F.lit(True).alias("ok"))
    out = rows.select("vec_id", "ok", "h1", "h2").join(facts, ["h1", "h2", "ok"], "left")
    named = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), named.alias("component_id"), F.coalesce(named == F.col("vec_id"), F.lit(True)).alias("kept"))
