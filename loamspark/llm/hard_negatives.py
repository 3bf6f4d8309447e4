"""Hard negatives by largest inner product: an index of augmented vectors by (pivot, distance), scanned in growing annuli."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, vectors
from .shared import discard, written

#: Steps of a unit that components are cut to.
SCALE = 256
#: Positives of an anchor, negatives of each, and the least and most hundredths of the positive's score that a negative has.
POSITIVES = 5
NEGATIVES = 10
BAND = (30, 90)
#: Rows of a block about, and blocks of the index at most, which bounds what is broadcast of it; blocks of larger tables hold more rows.
BLOCK_ROWS = 1024
MAX_BLOCKS = 1 << 16
PIVOTS = 64
#: Rows that pivots are fitted on at most, in the order of a hash; every row is indexed.
MAX_SAMPLE = 20_000
#: Blocks of a query's first annulus, and how many times as many the next may have.
FIRST = 4
GROWTH = 8
_NONE = np.iinfo(np.int64).min


def largest(size: int) -> int:
    """Cut components of vectors of ``size`` are clamped to this, so that no inner product times 100 leaves a long; it is 2**25, 131,072.0 before the cut, at size 64."""
    return min(2**31 - 1, int((2.0**56 / max(size, 1)) ** 0.5))


@dataclass(frozen=True)
class Layout:
    """Pivots in augmented space, the largest squared length, and each block's pivot and range of keys."""

    pivots: np.ndarray
    most: float
    block: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def augmented(self, x: np.ndarray) -> np.ndarray:
        """One more component makes all vectors equally long, so the largest inner product is the smallest distance."""
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))])

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of rows of the table, and the distance from it."""
        far = _distances(self.augmented(x), self.pivots)
        near = far.argmin(axis=1)
        return near.astype(np.int32), far[np.arange(len(x)), near]

    def reach(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from queries ``x`` at which rows have the inner product ``score``."""
        x = x.astype(np.float64)
        return np.sqrt(np.maximum((x * x).sum(axis=1) + self.most - 2 * score, 0))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries (augmented by 0) and blocks, the least and the most distance that a row of the block can have; each is slackened by the rounding of doubles."""
        x = x.astype(np.float64)
        d = _distances(np.column_stack([x, np.zeros(len(x))]), self.pivots)[:, self.pivot]
        slack = 1e-6 * (np.sqrt(self.most) + np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1)
        return np.maximum(np.maximum(d - self.high, self.low - d) - slack, 0), d + self.high + slack


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products in integers; doubles hold them where none can pass 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    kind = np.float64 if most < 2**53 else np.int64
    return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)


def _ints(column: pa.Array, size: int) -> np.ndarray:
    return blocks.utf8(column)[0].view(np.int32).reshape(-1, size)


def cut_rows(table: DataFrame) -> tuple[DataFrame, int]:
    """``id, label, ints`` of the rows that take part, one for each id, components floor(SCALE * x) as 32-bit integers; and their number of components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where("id is not null and label is not null and embedding is not null").where(~bad)
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None or not size["size"]:
        return rows.select("id", "label", F.lit(b"").alias("ints")).limit(0), 0
    n, most = size["size"], largest(size["size"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.clip(np.floor(SCALE * vectors.matrix(batch.column("embedding"))), -most, most).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), blocks.binaries(x.view(np.uint8).reshape(-1), np.arange(batch.num_rows + 1) * n * 4)], ["id", "label", "ints"])

    ints = rows.where(F.size("embedding") == n).mapInArrow(cut, "id long, label long, ints binary")
    return ints.groupBy("id").agg(F.min(F.struct("label", "ints")).alias("row")).select("id", "row.label", "row.ints"), n


def _layout(rows: DataFrame, size: int) -> tuple[Layout, int]:
    """Pivots, by a few rounds of means over a bounded sample; and rows of a block."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _ints(batch.column("ints"), size).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([float((x * x).sum(axis=1).max(initial=0))])], ["n", "most"])

    facts = rows.mapInArrow(lengths, "n long, most double").agg(F.sum("n").alias("n"), F.max("most").alias("most")).first()
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(MAX_SAMPLE).select("ints").collect()
    n, empty = facts["n"], np.zeros(0)
    plain = Layout(np.zeros((1, size + 1)), facts["most"], empty, empty, empty, empty)
    sample = plain.augmented(np.array([np.frombuffer(r.ints, np.int32) for r in picked]))
    count = max(1, min(PIVOTS, n // (4 * BLOCK_ROWS), len(sample)))
    pivots = sample[:: max(1, len(sample) // count)][:count].copy()
    for _ in range(8):
        near = _distances(sample, pivots).argmin(axis=1)
        for p in np.unique(near):
            pivots[p] = sample[near == p].mean(axis=0)
    return Layout(pivots, facts["most"], empty, empty, empty, empty), max(BLOCK_ROWS, -(-n // MAX_BLOCKS))


def build(rows: DataFrame, size: int) -> tuple[DataFrame, Layout]:
    """The index of ``id, label, ints``: rows ordered by (pivot, distance) and cut into blocks, ``block, ids, labels, ints``; and its layout.

    Rows that agree in label and vector answer alike but for their ids, so of each such group only the smallest ids that any answer can need are indexed, however many copies there are.
    """
    layout, count = _layout(rows, size)
    shared = rows.sparkSession.sparkContext.broadcast(layout)
    needed = max(POSITIVES, NEGATIVES) + 1
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("label", "ints").orderBy("id"))).where(F.col("nth") <= needed).drop("nth")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, far = shared.value.keys(_ints(batch.column("ints"), size))
            yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(far), *(batch.column(c) for c in ("id", "label", "ints"))], ["pivot", "key", "id", "label", "ints"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rest: list[pa.RecordBatch] = []

        def block(piece: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            piece = piece.combine_chunks()
            far = piece.column("key").to_numpy()
            packed = [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (piece.column("id").to_numpy(), piece.column("label").to_numpy(), np.concatenate([_ints(c, size) for c in piece.column("ints").chunks]))]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([piece.column("pivot")[0].as_py()], pa.int32()), pa.array([far[0]]), pa.array([far[-1]]), *packed], ["block", "pivot", "low", "high", "ids", "labels", "ints"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch])
            starts = blocks.run_starts(table, ["pivot"])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                last = b == table.num_rows
                while b - a >= count or (a < b and not last):
                    yield block(table.slice(a, min(count, b - a)))
                    a = min(b, a + count)
            rest = table.slice(a).combine_chunks().to_batches() if a < table.num_rows else []
        if rest:
            yield block(pa.Table.from_batches(rest))

    keyed = few.mapInArrow(key, "pivot int, key double, id long, label long, ints binary").repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key", "id")
    index = written(keyed.mapInArrow(pack, "block long, pivot int, low double, high double, ids binary, labels binary, ints binary"), "index")
    # One row for each block: MAX_BLOCKS and one more at most for each pivot and partition.
    ranges = index.select("block", "pivot", "low", "high").orderBy("block").toPandas()
    return index, Layout(layout.pivots, layout.most, *(ranges[c].to_numpy() for c in ("block", "pivot", "low", "high")))


def _annuli(asks: DataFrame, layout: Layout, size: int, width: int, tasks: int) -> DataFrame:
    """A row for each block that lies in the next annuli of an Arrow batch's queries, with those queries; and one for each query, without a block, with the radius up to which it is then scanned.

    A query's annulus reaches from where it was scanned to the bound of its ``width`` next blocks, but not beyond the distance that the worst row that it still needs can have.
    Queries that need nothing beyond what they have met are not in the result.
    """
    shared = asks.sparkSession.sparkContext.broadcast(layout)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay = shared.value
        for whole in batches:
            for cut in range(0, whole.num_rows, 256):
                batch = whole.slice(cut, 256)
                x, done = _ints(batch.column("ints"), size), batch.column("done").to_numpy()
                least, most = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("least", "most"))
                open_ = least <= most
                far = np.where(open_, lay.reach(np.repeat(x, least.shape[1], axis=0), least.reshape(-1).astype(np.float64)).reshape(least.shape), -1.0).max(axis=1)
                inner = np.where(open_, lay.reach(np.repeat(x, least.shape[1], axis=0), most.reshape(-1).astype(np.float64)).reshape(least.shape), np.inf).min(axis=1)
                sent: list[tuple[np.ndarray, np.ndarray]] = []
                states: list[tuple[np.ndarray, np.ndarray]] = []
                for a in range(0, len(x), 16):
                    low, high = lay.bounds(x[a : a + 16])
                    slack = 1e-6 * (np.sqrt(lay.most) + 1)
                    meets = (low > done[a : a + 16, None]) & (low <= far[a : a + 16, None] + slack) & (high >= inner[a : a + 16, None] - slack)
                    bound = np.where(meets, low, np.inf)
                    some = np.flatnonzero(meets.any(axis=1))
                    if not len(some):
                        continue
                    k = min(width, bound.shape[1])
                    to = np.minimum(np.partition(bound[some], k - 1, axis=1)[:, k - 1], far[a + some] + slack)
                    q, b = np.nonzero(meets[some] & (low[some] <= to[:, None]))
                    sent.append((lay.block[b], a + some[q]))
                    states.append((a + some, to))
                if not sent:
                    continue
                block, row = map(np.concatenate, zip(*sent, strict=True))
                order = np.lexsort((row, block))
                block, row = block[order], row[order]
                starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                ends = np.append(starts[1:], len(block))
                asked = pa.StructArray.from_arrays([batch.column(c).take(pa.array(row)) for c in ("query", "label", "ints", "least", "most")], ["query", "label", "ints", "least", "most"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), asked)
                query, to = map(np.concatenate, zip(*states, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(block[starts]), pa.nulls(len(query), pa.int64())]), pa.concat_arrays([pa.nulls(len(starts), pa.int64()), batch.column("query").take(pa.array(query))]), pa.array(np.append(np.zeros(len(starts)), to)), pa.concat_arrays([lists, pa.nulls(len(query), lists.type)])],
                    ["block", "query", "to", "asks"],
                )

    return asks.repartition(tasks).mapInArrow(plan, "block long, query long, to double, asks array<struct<query: long, label: long, ints: binary, least: array<long>, most: array<long>>>")


def _scanned(index: DataFrame, tiles: DataFrame, size: int, same: bool, k: int) -> DataFrame:
    """``query, slot, id, score``: of each block, the best ``k`` rows for each slot of the queries sent there. A block comes first, then its queries, batch by batch."""
    kind = next(f.dataType for f in tiles.schema if f.name == "asks").simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, labels, x = None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                if batch.column("ids")[i].is_valid:
                    at = batch.column("block")[i].as_py()
                    ids, labels = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "labels"))
                    x = np.frombuffer(batch.column("ints")[i].as_py(), np.int32).reshape(-1, size)
                    continue
                assert at == batch.column("block")[i].as_py()
                asks = batch.column("asks")[i].values
                query, label = asks.field("query").to_numpy(), asks.field("label").to_numpy()
                least, most = (np.stack(asks.field(c).to_numpy(zero_copy_only=False)) for c in ("least", "most"))
                score = products(_ints(asks.field("ints"), size), x)
                fits = ((labels[None] == label[:, None]) & (ids[None] != query[:, None])) if same else labels[None] != label[:, None]
                for slot in range(least.shape[1]):
                    ranked = np.where(fits & (score >= least[:, slot, None]) & (score <= most[:, slot, None]), score, _NONE)
                    kth = np.partition(ranked, -k, axis=1)[:, -k, None] if len(ids) > k else _NONE
                    q, r = np.nonzero((ranked >= kth) & (ranked > _NONE))
                    order = np.lexsort((ids[r], -score[q, r], q))
                    q, r = q[order], r[order]
                    first = np.searchsorted(q, q)
                    best = np.arange(len(q)) - first < k
                    q, r = q[best], r[best]
                    out.append((query[q], np.full(len(q), slot, np.int32), ids[r], score[q, r]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "slot", "id", "score"])

    visited = F.broadcast(tiles.select("block").distinct())
    held = index.join(visited, "block", "left_semi").select("block", "ids", "labels", "ints", F.lit(None).cast(kind).alias("asks"))
    sent = tiles.select("block", *(F.lit(None).cast("binary").alias(c) for c in ("ids", "labels", "ints")), "asks")
    dealt = held.unionByName(sent).repartition("block").sortWithinPartitions("block", F.col("ids").isNull())
    return dealt.mapInArrow(scan, "query long, slot int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(index: DataFrame, layout: Layout, asks: DataFrame, size: int, same: bool, k: int) -> DataFrame:
    """``query, slot, id, score, rank``: for each slot of ``asks`` the ``k`` rows of the largest inner products between its least and most, ties to smaller ids.

    ``asks`` has ``query, label, ints, least, most``, arrays of one length for all; ``same`` asks for other rows of the query's label, else rows of other labels are asked for. Rounds scan annuli in key intervals about
    every pivot; a query ends when the bound of what is left is beyond the worst row that it still needs, so results are exact. Only the number of rounds depends on the data: GROWTH more blocks each.
    """
    tasks = max(1, asks.sparkSession.sparkContext.defaultParallelism)
    state = asks.withColumn("done", F.lit(-1.0))
    found, width, saved = None, FIRST, False
    while True:
        plan = written(_annuli(state, layout, size, width, tasks), "annuli")
        if plan.isEmpty():
            break
        fresh = _scanned(index, plan.where("block is not null").select("block", "asks"), size, same, k)
        best = written(_best(fresh if found is None else found.drop("rank").unionAll(fresh), k), "found")
        # A slot that is full needs no row below its worst.
        worst = best.groupBy("query", "slot").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") == k)
        worst = worst.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("slot", "worst"))).alias("worst"))
        moved = state.join(plan.where("block is null").select("query", "to"), "query").join(worst, "query", "left")
        raised = F.transform("least", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("worst", i), F.lit(_NONE))))
        after = written(moved.select("query", "label", "ints", raised.alias("least"), "most", F.col("to").alias("done")), "asks")
        for table in [plan, *([found] if found is not None else []), *([state] if saved else [])]:
            discard(table)
        found, state, saved, width = best, after, True, width * GROWTH
    return found if found is not None else asks.sparkSession.createDataFrame([], "query long, slot int, id long, score long, rank int")


def mine(table: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every row of ``table`` for which ``anchors``, a condition on ``vec_id``, holds.

    Scores are inner products of components floor(SCALE * x); the larger, then the smaller id, comes first. An anchor's positives are its first ``positives`` other rows of the same label; for each, the first ``negatives`` rows of other
    labels are returned whose score is between the ``band``'s hundredths of the positive's, ends included. Fewer rows give fewer; a negative positive's band is empty. Rows with a null id, label or vector, and vectors with null or non-finite components, take no part; zero vectors do;
    of several lengths the most frequent (the shorter at a tie) takes part. Of rows that repeat an id, that with the smallest label, then the smallest bytes, takes part. Cut components are clamped to ``largest``. Other columns are not read; an empty table gives an empty one.
    """
    if max(positives, negatives) > max(POSITIVES, NEGATIVES):
        raise ValueError("the index keeps as many copies of a vector as POSITIVES and NEGATIVES need")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    cut, size = cut_rows(table)
    if not size:
        return table.sparkSession.createDataFrame([], out)
    rows = written(cut, "cut")
    index, layout = build(rows, size)
    asked = rows.withColumnRenamed("id", "vec_id").where(anchors).withColumnRenamed("vec_id", "query").select("query", "label", "ints")
    any_ = lambda v: F.array(F.lit(v).cast("long"))
    near = search(index, layout, asked.select("*", any_(_NONE).alias("least"), any_(-_NONE - 1).alias("most")), size, True, positives)
    near = near.select("query", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    exact = lambda sign, part: F.expr(f"{sign}(({sign}positive_score * {part}L - pmod({sign}positive_score * {part}L, 100L)) div 100L)")
    low, high = exact("-", band[0]), exact("", band[1])
    # Every query has as many slots; one without a positive asks for nothing.
    slots = near.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(low.alias("least"), high.alias("most"))))).alias("slots"))
    limits = lambda name, none: F.array(*[F.coalesce(F.try_element_at("slots", F.lit(i))[name], F.lit(none).cast("long")) for i in range(positives)])
    wanted = asked.join(slots, "query").select("query", "label", "ints", limits("least", 1).alias("least"), limits("most", 0).alias("most"))
    hard = search(index, layout, wanted, size, False, negatives)
    named = hard.join(near, ["query", "slot"])
    return named.select(F.col("query").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
