"""Approximate nearest neighbours along several shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, vectors
from .shared import written

#: Curves, directions that vectors are projected on for each, and bits of a coordinate.
CURVES = 128
DIMENSIONS = 16
BITS = 3
#: The part of all vectors that a query sees along each curve, its own place in the middle, and rows that it sees beside that.
#: All windows together are CURVES * WINDOW = 0.23 of a large table; where they overlap, rows count and are compared once.
WINDOW = 0.0018
MIN_ROWS = 24
#: Rows of a block of a curve, about, and blocks of a curve at most; larger blocks are split by a hash.
BLOCK_ROWS = 2048
MAX_BLOCKS = 4096
#: Rows of a bucket, the unit of reranking.
BUCKET_ROWS = 4096
#: Vectors that curves are fitted on at most, in the order of a hash, and quantiles of each curve; every vector is indexed.
MAX_SAMPLE = 20_000
MAX_QUANTILES = 8192
NEIGHBOURS = 10
_TIE = 15


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer points along the Hilbert curve (Skilling's transform, 2004), most significant bits first."""
    kind = np.uint8 if bits <= 8 else np.uint64
    x = [cells[:, i].astype(kind) for i in range(cells.shape[1])]
    one = kind(1)
    for b in range(bits - 1, 0, -1):
        low = kind((1 << b) - 1)
        for i in range(len(x)):
            # All ones where the bit is set.
            mask = kind(0) - ((x[i] >> kind(b)) & one)
            swap = (x[0] ^ x[i]) & low & ~mask
            x[0] = x[0] ^ (low & mask) ^ swap
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = turn ^ (kind((1 << b) - 1) & (kind(0) - ((x[-1] >> kind(b)) & one)))
    out = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << np.uint64(1)) | (((v ^ turn) >> kind(b)) & one)
    return out


@dataclass
class Curves:
    """Directions, shifts and scales of the curves, quantiles of the sample's keys, and the sizes of what they are cut into."""

    axes: np.ndarray
    low: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    quantiles: np.ndarray
    blocks: int
    split: int
    window: float
    buckets: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        """A key for each curve and row; a hash of the vector breaks ties, so that blocks and windows can part a crowded place."""
        odd = np.random.default_rng(43).integers(0, 2**63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        tie = ((np.ascontiguousarray(x).view(np.uint64) * odd).sum(axis=1) >> np.uint64(64 - _TIE)).astype(np.int64)
        out = np.empty((len(self.axes), len(x)), np.int64)
        for t, axes in enumerate(self.axes):
            u = ((x @ axes - self.low[t]) * self.scale[t] + self.shift[t]) / 1.5
            cells = (np.clip(np.nan_to_num(u), 0, 1 - 1e-9) * (1 << BITS)).astype(np.uint8)
            out[t] = (hilbert(cells, BITS).astype(np.int64) << _TIE) | tie
        return out

    def block(self, keys: np.ndarray, t: int) -> np.ndarray:
        """The block of curve t that a key lies in, equal parts of all vectors by the sample."""
        q = self.quantiles[t]
        return np.minimum(np.searchsorted(q, keys, side="right") * self.blocks // (len(q) + 1), self.blocks - 1)

    def windows(self, keys: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The first and last key of the window about each key; at the curve's ends it is moved inside."""
        q = self.quantiles[t].astype(np.float64)
        places, half = np.arange(len(q)), self.window * len(q) / 2
        at = np.interp(keys, q, places)
        at = np.clip(at, min(half, len(q) - 1 - half), max(half, len(q) - 1 - half))
        lo = np.where(at - half <= 0, 0, np.interp(at - half, places, q)).astype(np.int64)
        hi = np.where(at + half >= len(q) - 1, 2.0**62, np.interp(at + half, places, q)).astype(np.int64)
        hi[at + half >= len(q) - 1] = np.iinfo(np.int64).max
        return lo, hi

    def bucket(self, ids: np.ndarray) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)).astype(np.int64) % self.buckets


def fit(sample: np.ndarray, n: int) -> Curves:
    """Curves for ``n`` vectors of which ``sample`` are some; the seed is fixed.

    Directions are random in the sample's principal directions, weighted by their spread, so data of few dimensions is
    projected within them. They are orthogonal where the data has dimensions enough for that.
    """
    rng = np.random.default_rng(41)
    size = sample.shape[1]
    d = min(DIMENSIONS, size)
    centred = sample / np.abs(sample).max() - (sample / np.abs(sample).max()).mean(axis=0)
    spread, directions = np.linalg.eigh(centred.T @ centred / len(sample))
    spread = np.maximum(spread, 0)
    axes = np.stack([directions @ (np.sqrt(spread)[:, None] * rng.standard_normal((size, d))) for _ in range(CURVES)])
    if spread.sum() ** 2 > d * (spread**2).sum():
        axes = np.stack([np.linalg.qr(a)[0] for a in axes])
    axes /= np.maximum(np.linalg.norm(axes, axis=1, keepdims=True), 1e-300)
    ends = [np.quantile(sample @ a, (0.001, 0.999)) for a in axes]
    low, high = np.array(ends).T
    count = max(1, min(MAX_BLOCKS, -(-n // BLOCK_ROWS)))
    out = Curves(axes, low, 1 / np.maximum(high - low, 1e-12), rng.random((CURVES, d)) / 2, np.zeros((CURVES, 0)), count, -(-n // (count * BLOCK_ROWS)), min(1.0, WINDOW + MIN_ROWS / max(n, 1)), max(1, -(-n // BUCKET_ROWS)))
    keys = np.sort(out.keys(sample), axis=1)
    out.quantiles = keys[:, np.linspace(0, keys.shape[1] - 1, min(keys.shape[1], MAX_QUANTILES)).round().astype(int)].copy()
    return out


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all binaries, one after the other."""
    return np.concatenate([np.zeros(0, np.int64), *(blocks.utf8(c)[0].view(np.int64) for c in column.chunks)])


def _packed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The distinct keys, ascending, and a binary of each column's numbers for each; rows of a key keep their order."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(keys) else np.zeros(0, int)
    ends = np.append(starts, len(keys)) * 8
    return sorted_[starts], [blocks.binaries(c[order].view(np.uint8), ends) for c in columns]


def candidates(reps: DataFrame, asked: DataFrame, curves: Curves) -> DataFrame:
    """``bucket, query, ids``: the rows in a query's windows, by bucket; a row in several windows is in several of the query's lists.

    ``reps`` has ``node, embedding``, ``asked`` ``id, embedding``. A row of a curve is its key and node, packed by block, without the vector. Spark deals the blocks,
    which are ranges of keys, to tasks; a query goes to all blocks that its window touches.
    """
    shared = reps.sparkSession.sparkContext.broadcast(curves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            ids, asks = batch.column("id").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            keys = c.keys(vectors.matrix(batch.column("embedding")))
            sub = ids % c.split
            rows = [(((t * c.blocks + c.block(keys[t][~asks], t)) * c.split + sub[~asks]), keys[t][~asks], ids[~asks]) for t in range(len(keys))]
            slot, packed = _packed(*map(np.concatenate, zip(*rows, strict=True)))
            if len(slot):
                yield pa.RecordBatch.from_arrays([pa.array(slot), packed[0], pa.array([None] * len(slot), pa.binary()), packed[1]], ["slot", "key", "last", "ids"])
            if asks.any():
                rows = []
                for t in range(len(keys)):
                    lo, hi = c.windows(keys[t][asks], t)
                    first = (t * c.blocks + c.block(lo, t)) * c.split
                    count = (t * c.blocks + c.block(hi, t) + 1) * c.split - first
                    rows.append((blocks.spread(first, count), *(np.repeat(v, count) for v in (lo, hi, ids[asks]))))
                slot, packed = _packed(*map(np.concatenate, zip(*rows, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(slot), *packed], ["slot", "key", "last", "ids"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for part in blocks.runs(batches, ["slot"]):
            starts = blocks.run_starts(part, ["slot"])
            out: list[tuple] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                rows = part.slice(a, b - a)
                index, asks = rows.filter(pc.is_null(rows.column("last"))), rows.filter(pc.is_valid(rows.column("last")))
                if not index.num_rows or not asks.num_rows:
                    continue
                keys, ids = _longs(index.column("key")), _longs(index.column("ids"))
                order = np.argsort(keys, kind="stable")
                first = np.searchsorted(keys[order], _longs(asks.column("key")), side="left")
                count = np.searchsorted(keys[order], _longs(asks.column("last")), side="right") - first
                out.append((np.repeat(_longs(asks.column("ids")), count), ids[order[blocks.spread(first, count)]]))
            if out:
                query, found = map(np.concatenate, zip(*out, strict=True))
                queries, nth = np.unique(query, return_inverse=True)
                code, packed = _packed(c.bucket(found) * len(queries) + nth, found)
                if len(code):
                    yield pa.RecordBatch.from_arrays([pa.array(code // len(queries)), pa.array(queries[code % len(queries)]), packed[0]], ["bucket", "query", "ids"])

    both = reps.select(F.col("node").alias("id"), "embedding", F.lit(False).alias("asks")).unionByName(asked.select("id", "embedding", F.lit(True).alias("asks")))
    dealt = both.mapInArrow(place, "slot long, key binary, last binary, ids binary").repartition("slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(look, "bucket long, query long, ids binary")


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows nearest to ``q``, ties to smaller ids, and their Euclidean distances."""
    far = np.sqrt(((x - q) ** 2).sum(axis=1))
    best = np.lexsort((ids, far))[:k]
    return best, far[best]


def _reranked(reps: DataFrame, asked: DataFrame, found: DataFrame, curves: Curves, k: int) -> DataFrame:
    """``query_id, node, id, score``: of each bucket, a query's k nearest among its merged candidates there.

    A bucket holds a hash's share of the rows, so vectors move once and a candidate is 8 bytes. The bucket's vectors come first,
    then its queries one by one, each with its vector and lists.
    """
    shared = reps.sparkSession.sparkContext.broadcast(curves)
    names = ["bucket", "turn", "query", "ids", "embedding"]
    element = next(f.dataType for f in reps.schema if f.name == "embedding").simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, both = batch.num_rows, np.stack([batch.column(c).to_numpy() for c in ("node", "id")], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shared.value.bucket(both[:, 0])), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()), blocks.binaries(both.view(np.uint8).reshape(-1), np.arange(n + 1) * 16), batch.column("embedding")],
                names,
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, ids, x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))
        for part in blocks.runs(batches, ["bucket", "turn", "query"]):
            starts = blocks.run_starts(part, ["bucket", "turn", "query"])
            turn, query = part.column("turn").to_numpy(), part.column("query").to_numpy()
            out: list[tuple] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                rows = part.slice(a, b - a)
                own = pa.concat_arrays(rows.column("embedding").chunks).drop_null()
                listed = _longs(rows.column("ids"))
                if turn[a] == 0:
                    order = np.argsort(listed[::2])
                    nodes, ids, x = listed[::2][order], listed[1::2][order], vectors.matrix(own)[order]
                elif len(listed):
                    some = np.searchsorted(nodes, np.unique(listed))
                    best, far = nearest(vectors.matrix(own)[0], x[some], ids[some], k)
                    out.append((np.full(len(best), query[a]), nodes[some[best]], ids[some[best]], far))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "node", "id", "score"])

    vectors_ = reps.select("node", "id", "embedding").mapInArrow(place, f"bucket long, turn int, query long, ids binary, embedding {element}")
    asks = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(curves.buckets - 1).cast("long"))).alias("bucket"), F.lit(1).alias("turn"), F.col("id").alias("query"), F.lit(b"").alias("ids"), "embedding")
    lists = found.select("bucket", F.lit(1).alias("turn"), "query", "ids", F.lit(None).cast(element).alias("embedding"))
    all_ = vectors_.unionAll(asks.select(*names)).unionAll(lists.select(*names))
    return all_.repartition("bucket").sortWithinPartitions("bucket", "turn", "query").mapInArrow(compare, "query_id long, node long, id long, score double")


def representatives(table: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``node, id, embedding, ids`` of the distinct vectors that take part: a number, the smallest id, and the smallest k + 1 ids, all that a result can need of them."""
    rows = vectors.keyed(table).where("ok")
    by = Window.partitionBy("h1", "h2").orderBy("vec_id")
    # Spark takes the first rows of a group before it shuffles them, so a vector with very many copies is no burden.
    few = rows.select("vec_id", "embedding", "h1", "h2").withColumn("nth", F.dense_rank().over(by)).where(F.col("nth") <= k + 1)
    grouped = few.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "embedding")).alias("first"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return written(grouped.select(F.monotonically_increasing_id().alias("node"), F.col("first.vec_id").alias("id"), F.col("first.embedding").alias("embedding"), "ids"), "vectors")


def sampled(reps: DataFrame, n: int) -> Curves:
    """``fit`` on at most MAX_SAMPLE of the ``n`` rows."""
    picked = reps.orderBy(F.xxhash64("id"), "id").limit(MAX_SAMPLE).select("embedding").toArrow()
    flat = picked.column("embedding").combine_chunks()
    return fit(vectors.matrix(flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)), n)


def search(table: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows that each query finds among ``table``, by Euclidean distance in double precision.

    ``queries`` holds rows of ``table``; a row is no neighbour of its own id. Distinct vectors are indexed once. Each curve is a Hilbert
    ordering of vectors projected on random directions and shifted, cut into blocks by key ranges; a query's windows of neighbouring keys on all curves
    are merged, every row found is compared once by its vector, then copies are counted out.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part, neither do vectors
    of another length than the most frequent. Rows that repeat an id and its vector are one; an id with several vectors is found by the nearest of them and asks with the smallest. Other columns are not read;
    an empty table gives an empty one.
    """
    spark = table.sparkSession
    reps = representatives(table, k)
    schema = "query_id long, rank int, vec_id long, score double"
    size = reps.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return spark.createDataFrame([], schema)
    reps = reps.where(F.size("embedding") == size["size"])
    curves = sampled(reps, size["count"])
    asked = vectors.keyed(queries).where(F.col("ok") & (F.size("embedding") == size["size"])).select(F.col("vec_id").alias("id"), "embedding")
    asked = asked.groupBy("id").agg(F.min("embedding").alias("embedding"))
    answers = _reranked(reps, asked, candidates(reps, asked, curves), curves, k + 1)
    top = answers.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("nth") <= k + 1)
    named = top.join(reps.select("node", "ids"), "node").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    named = named.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
