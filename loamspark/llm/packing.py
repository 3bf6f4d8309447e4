"""Harmonic packing of documents into token sequences of one capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, piecewise

CAPACITY = 2048
#: Padding that a full bin of a class may keep, of 2048; pieces that would leave more are cut. (A cut piece may leave up to the capacity's square root.)
SLACK = 16


def cut(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """The piece lengths of a document of ``n`` ids.

    Class k takes lengths over capacity / (k + 1) up to capacity / k, k to a bin. A rest that fills
    k-fold a bin but for ``slack`` stays whole; otherwise a piece of just the next class's size goes,
    which leaves a rest of at most capacity / (k (k + 1)), so there are few cuts.
    """
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Harmonic:
    """The bins of one worker. ``add`` gives the sequences that it fills, ``finish`` the rest.

    A sequence is a list of (document, start, ids). At the end, the bins that lack documents are
    laid one after the other and cut at the capacity; the last rest goes into sequences of powers of two, which need no padding.
    A pending piece holds its own ids alone, so a worker keeps less than one sequence a class, whatever the documents' lengths.
    """

    def __init__(self, capacity: int = CAPACITY, slack: int = SLACK) -> None:
        self.capacity, self.slack = capacity, slack
        self.open: dict[int, list] = {}

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list]:
        at = 0
        for size in cut(len(ids), self.capacity, self.slack):
            k = self.capacity // size
            if k == 1:
                yield [(doc, at, ids[at : at + size])]
            else:
                bin_ = self.open.setdefault(k, [])
                bin_.append((doc, at, ids[at : at + size].copy()))
                if len(bin_) == k:
                    del self.open[k]
                    yield bin_
            at += size

    def finish(self) -> Iterator[list]:
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        total = sum(len(ids) for _, _, ids in rest)
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if (total % self.capacity) >> b & 1]
        i = used = 0
        for size in sizes:
            out = []
            while size:
                doc, at, ids = rest[i]
                take = min(size, len(ids) - used)
                out.append((doc, at + used, ids[used : used + take]))
                size, used = size - take, used + take
                if used == len(ids):
                    i, used = i + 1, 0
            yield out


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = 1, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    Every worker fills its own bins from the rows of its partition, so nothing is shuffled and no
    class can be too large for one task. ``sequence_id`` holds the worker above 33 bits of its own
    counter. A null text counts as empty and packs its end id; repeated rows and null ids are
    documents of their own; an empty table gives an empty one; other columns are not read. ``ids``
    holds little-endian unsigned 32-bit ids.
    """
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Harmonic(capacity, slack)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held: list[np.ndarray] = []

        def put(sequence: list) -> None:
            nonlocal number
            offset = 0
            for (key, n), at, ids in sequence:
                rows.append((key, at, len(ids), n, number, offset))
                held.append(ids)
                offset += len(ids)
            number += 1

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            ends = np.append(0, np.cumsum([len(ids) for ids in held])) * 4
            batch = pa.RecordBatch.from_arrays([*columns, blocks.binaries(np.concatenate(held).astype("<u4").view(np.uint8), ends)], names)
            rows.clear(), held.clear()
            return batch

        for part, ids, ends in piecewise.encoded(batches, vocabulary, end):
            for i, key in enumerate(part.column("doc_id").to_pylist()):
                own = ids[ends[i] : ends[i + 1]]
                for sequence in bins.add((key, len(own)), own):
                    put(sequence)
            if rows:
                yield out()
        for sequence in bins.finish():
            put(sequence)
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))
