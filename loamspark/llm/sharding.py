"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .shared import discard, written

SHARDS = 16
#: Groups up to which the driver differences all at once; of more, it gets the groups over 1 / LARGE of all bytes, and about so many others by hash.
AT_ONCE = 20_000
LARGE = 4096
#: Groups of a cell, about, and bins that it is differenced into.
CELL_GROUPS = 20_000
CELL_BINS = 64
#: Cells of each level whose bins are items for the driver, and cells of the rest that are differenced into one cell of the next level.
RESERVED = 64
FAN = 1024
MAX_TASKS = 8192
#: Rows that are numbered together, about.
SLOT_ROWS = 1 << 18


def combined(parts: list[tuple[int, ...]], k: int) -> tuple[list[list[int]], list[int]]:
    """For each partial partition (k sums, largest first) the bin that each of its places ends in, and the bins' sums, largest first.

    The two partial partitions of largest spread are combined again and again, the largest bin of one with the
    smallest of the other, until one is left. Of equal spreads, earlier ones go first.
    """
    n = len(parts)
    if not n:
        return [], [0] * k
    heap = [(x[-1] - x[0], i, x) for i, x in enumerate(parts)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heap[0]
        sums = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        joined.append((a, b, order))
        z = tuple([sums[i] for i in order])
        heapq.heapreplace(heap, (z[-1] - z[0], n + len(joined) - 1, z))
    bins: dict[int, list[int]] = {n + len(joined) - 1: list(range(k))}
    for at in range(len(joined) - 1, -1, -1):
        a, b, order = joined[at]
        own = bins.pop(n + at)
        to = [0] * k
        for place, i in enumerate(order):
            to[i] = own[place]
        bins[a], bins[b] = to, to[::-1]
    return [bins[i] for i in range(n)], list(heap[0][2])


def difference(sizes: list[int], k: int) -> tuple[list[int], list[int]]:
    """The bin of every item, and the bins' sums, largest first: differencing from a partial partition for each item, the item and k - 1 empty bins."""
    to, sums = combined([(s,) + (0,) * (k - 1) for s in sizes], k)
    return [places[0] for places in to], sums


def _cells(groups: DataFrame) -> DataFrame:
    """``h1, h2, bytes, cell, bin``: the groups of each cell differenced into CELL_BINS bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.runs(batches, ["cell"]):
            starts = blocks.run_starts(table, ["cell"])
            sizes = table.column("bytes").to_numpy()
            bins = np.empty(len(sizes), np.int32)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                bins[a:b] = difference(sizes[a:b].tolist(), CELL_BINS)[0]
            yield from table.append_column("bin", pa.array(bins)).to_batches()

    return groups.mapInArrow(run, "h1 long, h2 long, bytes long, cell long, bin int")


def _merged(sums: DataFrame) -> DataFrame:
    """``cell, bin, bytes, parent, place``: the partial partitions of each parent's cells, ordered by cell, differenced into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.runs(batches, ["parent"]):
            starts = blocks.run_starts(table, ["parent"])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                to = _combine([(r["cell"], r["bin"], r["bytes"]) for r in part.select(["cell", "bin", "bytes"]).to_pylist()], CELL_BINS)
                place = [to[c, i] for c, i in zip(part.column("cell").to_pylist(), part.column("bin").to_pylist(), strict=True)]
                yield from part.append_column("place", pa.array(place, pa.int32())).to_batches()

    return sums.mapInArrow(run, "cell long, bin int, bytes long, parent long, place int")


def _combine(sums: list[tuple[int, int, int]], k: int) -> dict[tuple[int, int], int]:
    """The bin of every ``(cell, bin)``, of rows of cell, bin and bytes: the cells' partial partitions, differenced like those of single groups."""
    by_cell: dict[int, list[int]] = {}
    for cell, b, size in sorted(sums):
        by_cell.setdefault(cell, [0] * k)[b] = size
    orders = [sorted(range(k), key=lambda b, own=own: (-own[b], b)) for own in by_cell.values()]
    to, _ = combined([tuple([own[b] for b in order]) for own, order in zip(by_cell.values(), orders, strict=True)], k)
    return {(cell, b): places[at] for cell, order, places in zip(by_cell, orders, to, strict=True) for at, b in enumerate(order)}


def _placed(groups: DataFrame, shards: int) -> tuple[DataFrame, list[DataFrame]]:
    """``h1, h2, shard`` of every group of ``h1, h2, bytes``, and the written tables behind it.

    Large groups could not be evened out by cells that are even in themselves. So the cells have more bins than there are shards, and the driver
    differences large groups and items of every size below them, down to single groups, all at once.
    """
    spark = groups.sparkSession
    total = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    single = F.lit(total["n"] <= AT_ONCE) | (F.col("bytes") * LARGE > total["bytes"]) | (F.pmod("h1", F.lit(max(1, total["n"] // LARGE))) == 0)
    items: list[tuple] = [(r["bytes"], -1, r["h1"], r["h2"]) for r in groups.where(single).collect()]
    count = -(-total["n"] // CELL_GROUPS) if total["n"] > AT_ONCE else 0
    behind: list[DataFrame] = []
    if count:
        dealt = groups.where(~single).select("h1", "h2", "bytes", F.pmod("h2", F.lit(count)).alias("cell")).repartition(min(count, MAX_TASKS), "cell")
        found = written(_cells(dealt.sortWithinPartitions("cell", F.desc("bytes"), "h1", "h2")), "cells")
        behind.append(found)
        sums = found.groupBy("cell", "bin").agg(F.sum("bytes").alias("bytes"))
        while True:
            items += [(r["bytes"], len(behind) - 1, r["cell"], r["bin"]) for r in sums.where(F.col("cell") < RESERVED).collect()]
            if count <= RESERVED:
                break
            count = -(-(count - RESERVED) // FAN)
            dealt = sums.where(F.col("cell") >= RESERVED).withColumn("parent", F.pmod("cell", F.lit(count))).repartition(min(count, MAX_TASKS), "parent")
            behind.append(written(_merged(dealt.sortWithinPartitions("parent", "cell", "bin")), "level"))
            sums = behind[-1].groupBy(F.col("parent").alias("cell"), F.col("place").alias("bin")).agg(F.sum("bytes").alias("bytes"))
    items.sort(key=lambda x: (-x[0], *x[1:]))
    bins = difference([x[0] for x in items], shards)[0]

    def own(level: int, schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(*x[2:], s) for x, s in zip(items, bins, strict=True) if x[1] == level], schema))

    out = own(-1, "h1 long, h2 long, shard int")
    if behind:
        cells = own(len(behind) - 1, "cell long, bin int, shard int")
        for level in range(len(behind) - 1, 0, -1):
            up = cells.select(F.col("cell").alias("parent"), F.col("bin").alias("place"), "shard")
            cells = own(level - 1, "cell long, bin int, shard int").unionAll(behind[level].join(up, ["parent", "place"]).select("cell", "bin", "shard"))
        out = out.unionAll(behind[0].join(cells, ["cell", "bin"]).select("h1", "h2", "shard"))
    return out, behind


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the law ``bytes``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text counts as empty. Rows of equal texts are one indivisible
    group (texts are told apart by 128 bits of hash). Groups are summed and fall into cells of about CELL_GROUPS
    by their hash; each cell is differenced into CELL_BINS bins, FAN cells into one, and so on. The driver differences what is
    left into shards: the large groups, the bins of RESERVED cells of every level, and some LARGE small groups. At every level the two
    partial partitions of largest spread are combined first. Cells, levels and orders follow from the
    groups alone, so equal rows get equal shards however the input is partitioned or ordered. Rows find their
    group's shard by a join on the group's hash, which Spark may split where one group is hot. Slots number
    the rows of a shard from 0: rows are numbered in buckets by hash and shifted by the counts of the buckets
    before, so no task gets a whole shard. Repeated rows get slots of their own; null ids are rows like any; an empty table gives an
    empty one; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    n = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    placed, behind = _placed(groups, shards)
    buckets = max(1, -(-n // (SLOT_ROWS * shards)))
    out = rows.join(placed, ["h1", "h2"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(buckets)).cast("int").alias("bucket"))
    out = written(out, "placed")
    for table in (rows, groups, *behind):
        discard(table)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = out.withColumn("nth", F.row_number().over(own) - 1).join(counts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
