"""Product codes of vectors: integer codebooks fitted in rounds, nearest entries found by branch and bound in kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, vectors
from .shared import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Steps of a unit that components are cut to.
SCALE = 1024
#: Entries of a leaf of a kd-tree, and rows that are searched at once.
LEAF = 8
SLICE_ROWS = 8192
#: Up to this number of distinct labels, their sums are broadcast.
BROADCAST_LABELS = 100_000


def largest(size: int) -> int:
    """Cut components of vectors of ``size`` are clamped to this, so that no squared distance leaves a long; it is 2**27, 131,072.0 before the cut, at size 64."""
    return min(2**31 - 1, int((2.0**60 / max(size, 1)) ** 0.5))


@dataclass(frozen=True)
class Tree:
    """A kd-tree over a codebook's entries: boxes of its nodes, their halves, and the ascending entries of its leaves.

    Children come after their parent; -1 marks a leaf. Node 0 is the root.
    """

    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    members: list[np.ndarray]

    @staticmethod
    def build(entries: np.ndarray) -> Tree:
        low, high, axis, cut, left, right, members = [], [], [], [], [], [], []

        def add(own: np.ndarray) -> int:
            at, x = len(low), entries[own]
            low.append(x.min(axis=0))
            high.append(x.max(axis=0))
            wide = int(np.argmax(high[at] - low[at])) if x.shape[1] else 0
            axis.append(wide)
            cut.append(0)
            left.append(-1)
            right.append(-1)
            members.append(np.sort(own))
            if len(own) > LEAF:
                order = own[np.argsort(x[:, wide], kind="stable")] if x.shape[1] else own
                half = len(own) // 2
                cut[at] = int(entries[order[half], wide]) if x.shape[1] else 0
                left[at] = add(order[:half])
                right[at] = add(order[half:])
            return at

        add(np.arange(len(entries)))
        return Tree(entries, np.array(low), np.array(high), *(np.array(v) for v in (axis, cut, left, right)), members)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row by squared distance, ties to the lower index, and that distance; all in integers.

        Each row first meets the leaf that it falls into. Then the tree is walked from its root with the rows whose best is not nearer than a node's box:
        a box at the same distance is entered too, since a lower index may tie there. Doubles hold the integers where none of them can pass 2**53.
        """
        n, most = len(x), max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.float64 if x.shape[1] * (2 * most) ** 2 < 2**53 else np.int64
        x, entries, low, high = (v.astype(kind) for v in (x, self.entries, self.low, self.high))
        length, own_length = (x * x).sum(axis=1), (entries * entries).sum(axis=1)
        best, at = np.full(n, np.inf if kind is np.float64 else np.iinfo(np.int64).max, kind), np.full(n, len(entries))
        home = np.zeros(n, np.int64)
        while True:
            inner = np.flatnonzero(self.left[home] >= 0)
            if not len(inner):
                break
            node = home[inner]
            home[inner] = np.where(x[inner, self.axis[node]] < self.cut[node], self.left[node], self.right[node])

        def meet(leaf: int, rows: np.ndarray) -> None:
            own = self.members[leaf]
            far = length[rows, None] - 2 * (x[rows] @ entries[own].T) + own_length[own]
            first = far.argmin(axis=1)
            near, index = far[np.arange(len(rows)), first], own[first]
            better = (near < best[rows]) | ((near == best[rows]) & (index < at[rows]))
            best[rows[better]], at[rows[better]] = near[better], index[better]

        for leaf in np.unique(home).tolist():
            meet(leaf, np.flatnonzero(home == leaf))
        stack = [(0, np.arange(n))]
        while stack:
            node, rows = stack.pop()
            y = x[rows]
            gap = y - np.clip(y, low[node], high[node])
            rows = rows[np.einsum("ij,ij->i", gap, gap) <= best[rows]]
            if self.left[node] >= 0:
                if len(rows):
                    stack += [(int(self.left[node]), rows), (int(self.right[node]), rows)]
            elif len(rows := rows[home[rows] != node]):
                meet(node, rows)
        return at, best.astype(np.int64)


def cut_rows(table: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, label, ints`` of the rows that take part, components floor(SCALE * x) as 32-bit integers, padded by zeros to a multiple of PARTS; and their number of components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(F.col("embedding").isNotNull() & ~bad)
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("ints")).limit(0), 0
    wide = -(-size["size"] // PARTS) * PARTS
    most = largest(wide)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, wide), np.int32)
            with np.errstate(over="ignore"):
                x[:, : size["size"]] = np.clip(np.floor(SCALE * vectors.matrix(batch.column("embedding"))), -most, most)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), blocks.binaries(x.view(np.uint8).reshape(-1), np.arange(batch.num_rows + 1) * wide * 4)], ["vec_id", "label", "ints"])

    kind = next(f.dataType for f in rows.schema if f.name == "label").simpleString()
    return rows.where(F.size("embedding") == size["size"]).mapInArrow(cut, f"vec_id long, label {kind}, ints binary"), wide


def _parts(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their rows as ``(rows, PARTS, components of a part)``."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE_ROWS):
            piece = batch.slice(a, SLICE_ROWS)
            yield piece, blocks.utf8(piece.column("ints"))[0].view(np.int32).astype(np.int64).reshape(piece.num_rows, PARTS, wide // PARTS)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, every entry with parts becomes the floor of their mean by component, the others stay.

    A task returns a row of sums for each entry that it met; what reaches the driver is one row for each entry.
    """
    own = books.shape[2]
    trees = rows.sparkSession.sparkContext.broadcast([Tree.build(b) for b in books])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, x in _parts(batches, PARTS * own):
            for p, tree in enumerate(trees.value):
                at, _ = tree.nearest(x[:, p])
                np.add.at(total[p], at, x[:, p])
                count[p] += np.bincount(at, minlength=books.shape[1])
        part, entry = np.nonzero(count)
        if len(part):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * own, pa.int32()), pa.array(total[part, entry].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), sums], ["part", "entry", "n", "total"])

    sums = rows.mapInArrow(add, "part long, entry long, n long, total array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(own)))
    out = books.copy()
    for part, entry, n, *total in sums.collect():
        out[part, entry] = np.floor_divide(np.array(total, np.int64), n)
    return out


def fit(rows: DataFrame, wide: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks, ``(PARTS, entries, components of a part)``: at first the parts of the ENTRIES rows of the smallest ids, then refined ``rounds`` times."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(ENTRIES).select("ints").collect()
    start = np.array([np.frombuffer(r.ints, np.int32) for r in first], np.int64).reshape(len(first), PARTS, wide // PARTS)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        books = refined(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every row: an index byte for each part, and the squared distances added up."""
    trees = rows.sparkSession.sparkContext.broadcast([Tree.build(b) for b in books])
    own = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _parts(batches, PARTS * own):
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees.value)]
            code = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), piece.column("label"), blocks.binaries(code.reshape(-1), np.arange(len(x) + 1) * PARTS), pa.array(sum(far for _, far in found))], ["vec_id", "label", "code", "error"]
            )

    kind = next(f.dataType for f in rows.schema if f.name == "label").simpleString()
    return rows.mapInArrow(assign, f"vec_id long, label {kind}, code binary, error long")


def decoded(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """``codes`` and ``approximation``, the entries that a code (bytes) names, divided by SCALE; a null code gives null."""
    table = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<double>")
    def entries(column):
        return column.map(lambda c: None if c is None else np.concatenate([table.value[p, i] for p, i in enumerate(c)]) / SCALE)

    return codes.withColumn("approximation", entries(F.col(code)))


def compress(table: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error, label_error`` of every row that takes part, and the codebooks.

    Components become floor(SCALE * x) and vectors PARTS equal parts; ``fit`` says how the codebooks come about and ``Tree.nearest`` how an entry is found. ``label_error`` is the error
    summed over the rows of an equal label, null labels being equal. Rows whose vector is null or holds null or non-finite components take no part; zero vectors do. Of vectors of several lengths, those of the
    most frequent (the shorter at a tie) take part; a length that PARTS does not divide is filled up with zeros. Cut components are clamped to ``largest``. Rows without id are coded, and start
    codebooks last; repeated rows are rows of their own, and of an id with several vectors the smaller bytes start first. With under ENTRIES rows there are as many entries as rows. Other columns are not read; an empty table gives an empty one.
    """
    cut, wide = cut_rows(table)
    rows = written(cut, "cut")
    books = fit(rows, wide)
    if not books.shape[1]:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    codes = written(assigned(rows, books), "codes")
    errors = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own")
    few = errors.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    out = codes.join(F.broadcast(errors) if few else errors, F.col("label").eqNullSafe(F.col("own")))
    return out.drop("own"), books
