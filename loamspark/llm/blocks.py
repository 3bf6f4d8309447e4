"""Arrow and numpy helpers: rows in byte-bounded slices, words as dictionaries, runs of equal keys."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once; bounds the memory of a Python worker.
SLICE_BYTES = 8 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits, and every byte of a longer character.
ALNUM = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _malloc_trim = None


def trim() -> None:
    """Gives freed memory back to the system; workers live on between tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` in row ranges of at most ``limit`` text bytes and ``rows`` rows, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, min(int(np.searchsorted(ends, base + limit, side="right")), at + (rows or n)))
        yield batch.slice(at, stop - at)
        at = stop
    trim()


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, nulls as empty, and the row offsets into them."""
    if array.null_count:
        array = pc.fill_null(array, "")
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def binaries(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary (or string) array over ``data`` without a copy."""
    return pa.Array.from_buffers(kind or pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def words(raw: np.ndarray, rows: np.ndarray, inside: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` bytes in each row: dictionary-encoded, their first bytes, and the word offsets of the rows."""
    mask = inside[raw]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    heads = rows[:-1][rows[:-1] < len(raw)]
    first[heads] = mask[heads]
    starts = np.flatnonzero(first)
    before = np.cumsum(mask, dtype=np.int32)
    offsets = np.append(before[starts] - 1, before[-1] if len(before) else 0)
    return binaries(raw[mask], offsets).dictionary_encode(), starts, np.searchsorted(starts, rows)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys`` from sorted batches; a run never crosses two tables.

    A table holds many short runs or one long one, so its size is bounded by a batch and the
    longest run.
    """
    rest: list[pa.RecordBatch] = []

    def value(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if rest and value(batch, n - 1) == value(rest[-1], rest[-1].num_rows - 1):
            rest.append(batch)
            continue
        change = np.zeros(n, dtype=bool)
        for k in keys:
            col = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        done = [*rest, batch.slice(0, cut)] if cut else rest
        if done:
            yield pa.Table.from_batches(done)
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the runs in ``table``, and its length."""
    change = np.ones(table.num_rows, dtype=bool)
    if table.num_rows:
        same = np.ones(table.num_rows - 1, dtype=bool)
        for k in keys:
            col = table.column(k).to_numpy()
            same &= col[1:] == col[:-1]
        change[1:] = ~same
    return np.append(np.flatnonzero(change), table.num_rows)


def fixed(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """A matrix from binaries of one length without nulls."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = array.chunks if isinstance(array, pa.ChunkedArray) else [array]
    raw = np.concatenate([utf8(p)[0] for p in parts]) if parts else np.zeros(0, np.uint8)
    return raw.view(dtype).reshape(len(array), -1) if len(array) else np.zeros((0, 0), dtype)
