"""Token files of patched frame-of-reference blocks, written in document order and read back.

An image (all numbers little-endian) is ``PFR1``, then the numbers of values, of values a block and
of blocks, each u32; then the block index, the blocks' byte positions and the image's end, each u32;
then the blocks: minimum u32, width u8, number of exceptions u16, the packed values (``width`` bit planes
of a bit for each value), the exceptions' positions u16 and whole differences u32.
A block's width is that which holds the chosen percentile of its differences from the minimum;
larger ones are exceptions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, piecewise
from .shared import written

MAGIC = b"PFR1"
BLOCK = 256
PERCENTILE = 0.9
#: Ids after which a segment of a file is closed; a document is never cut, so a segment holds one at least.
SEGMENT_IDS = 1 << 17
_HEAD = 7


def pack(values: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The image of unsigned 32-bit ``values``; ``block`` is a multiple of 8."""
    n = len(values)
    m = -(-n // block)
    v = np.zeros(m * block, np.uint32)
    v[:n] = values
    v[n:] = values[-1] if n else 0
    v = v.reshape(m, block)
    low = v.min(axis=1) if m else np.zeros(0, np.uint32)
    r = v - low[:, None]
    bits = np.frexp(r.astype(np.float64))[1].astype(np.uint8)
    width = np.partition(bits, int(percentile * (block - 1)), axis=1)[:, int(percentile * (block - 1))] if m else np.zeros(0, np.uint8)
    rows, cols = np.nonzero(bits > width[:, None])
    extra = np.bincount(rows, minlength=m).astype(np.int64)
    plane = block // 8
    size = _HEAD + width.astype(np.int64) * plane + extra * 6
    first = 16 + 4 * (m + 1)
    start = first + np.cumsum(size) - size
    out = np.zeros(first + int(size.sum()), np.uint8)
    out[:16] = np.frombuffer(MAGIC + struct.pack("<III", n, block, m), np.uint8)
    out[16:first] = np.append(start, len(out)).astype("<u4").view(np.uint8)
    if not m:
        return out.tobytes()
    out[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(m, 4)
    out[start + 4] = width
    out[start[:, None] + np.arange(5, 7)] = extra.astype("<u2").view(np.uint8).reshape(m, 2)
    for w in np.unique(width):
        chosen = np.flatnonzero(width == w)
        for b in range(w):
            bit = np.packbits(((r[chosen] >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1)
            out[start[chosen, None] + _HEAD + b * plane + np.arange(plane)] = bit
    if len(rows):
        tail = start + _HEAD + width.astype(np.int64) * plane
        nth = np.arange(len(rows)) - (np.cumsum(extra) - extra)[rows]
        out[(tail[rows] + 2 * nth)[:, None] + np.arange(2)] = cols.astype("<u2").view(np.uint8).reshape(-1, 2)
        out[(tail[rows] + 2 * extra[rows] + 4 * nth)[:, None] + np.arange(4)] = r[rows, cols].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of the blocks ``first`` to before ``last`` (all, if not given), found by the block index."""
    raw = np.frombuffer(image, np.uint8)
    if bytes(raw[:4]) != MAGIC:
        raise ValueError("not a token image")
    n, block, m = struct.unpack("<III", image[4:16])
    last = m if last is None else min(last, m)
    index = np.frombuffer(image, "<u4", m + 1, 16).astype(np.int64)[first : last + 1]
    start, k, plane = index[:-1], max(0, last - first), block // 8
    if not k:
        return np.zeros(0, np.uint32)
    low = raw[start[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width = raw[start + 4]
    extra = raw[start[:, None] + np.arange(5, 7)].copy().view("<u2")[:, 0].astype(np.int64)
    r = np.zeros((k, block), np.uint32)
    for w in np.unique(width):
        chosen = np.flatnonzero(width == w)
        part = np.zeros((len(chosen), block), np.uint32)
        for b in range(w):
            part |= np.unpackbits(raw[start[chosen, None] + _HEAD + b * plane + np.arange(plane)], axis=1).astype(np.uint32) << np.uint32(b)
        r[chosen] = part
    if extra.any():
        rows = np.repeat(np.arange(k), extra)
        tail = (start + _HEAD + width.astype(np.int64) * plane)[rows]
        nth = np.arange(len(rows)) - (np.cumsum(extra) - extra)[rows]
        cols = raw[(tail + 2 * nth)[:, None] + np.arange(2)].copy().view("<u2")[:, 0]
        r[rows, cols] = raw[(tail + 2 * extra[rows] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    return (r + low[:, None]).reshape(-1)[: n - first * block]


def write_tokens(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end: int = 0) -> DataFrame:
    """Encodes whole texts, appends ``end`` to each and writes the ids in ascending ``doc_id`` order; returns the table of segments.

    Rows are range-partitioned and sorted by ``doc_id`` (equal ids by the text's hash, so repeated rows
    keep a fixed order; a null id comes first); each partition is one file, a sequence of segments. A
    segment holds whole documents, their ids and lengths, and one image with its block index. Segments
    are rows of a Parquet dataset, so Spark's own commit makes a file whole or absent when executors are lost.
    A null text counts as empty and gives the end id alone.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at = number = 0
        keys: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal at, number
            ids, sizes = np.concatenate(held), np.concatenate(lengths)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()),
                    pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary()),
                ],
                ["file", "segment", "start", "n_ids", "doc_ids", "lengths", "image"],
            )
            at, number = at + len(ids), number + 1
            for x in (keys, lengths, held):
                x.clear()
            return row

        for part, ids, rows in piecewise.encoded(batches, vocabulary, end):
            i, n = 0, part.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(rows, rows[i] + SEGMENT_IDS - sum(map(len, held)), side="right")) - 1)
                keys.append(part.column("doc_id").slice(i, j - i))
                lengths.append(np.diff(rows[i : j + 1]))
                held.append(ids[rows[i] : rows[j]])
                i = j
                if i < n or sum(map(len, held)) >= SEGMENT_IDS:
                    yield close()
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    segments = ordered.mapInArrow(run, "file int, segment int, start long, n_ids long, doc_ids array<long>, lengths array<long>, image binary")
    if path is None:
        return written(segments, "tokens")
    segments.write.parquet(path)
    return docs.sparkSession.read.schema(segments.schema).parquet(path)


def read_tokens(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files, ``ids`` as little-endian unsigned 32-bit.

    ``start`` counts the ids of all documents before it. Only the files' totals, a number for each
    file, go through the driver; each segment is decoded on its own.
    """
    spark = segments.sparkSession
    totals = sorted(tuple(r) for r in segments.groupBy("file").agg(F.sum("n_ids").alias("n")).collect())
    base, bases = 0, []
    for file, n in totals:
        bases.append((file, base))
        base += n
    bases = spark.createDataFrame(bases, "file int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in ("start", "base", "doc_ids", "lengths", "image")}
                ids = unpack(row["image"].as_py())
                sizes = row["lengths"].values.to_numpy()
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(ends - sizes + row["start"].as_py() + row["base"].as_py()), pa.array(sizes), blocks.binaries(ids.astype("<u4").view(np.uint8), np.append(0, ends) * 4)],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.join(F.broadcast(bases), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
