"""Sums over what two items share, for all pairs of items, by blocks of items: no join on a shared key, so a feature that all samples have is no hot key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.session import saved

#: Items of a block, about: a task holds one sum for each pair of two blocks' items. Axes that are multiplied at once.
BLOCK = 1024
_AXES = 512


class _Sums:
    """One pair of blocks: its items by side, the sums of all pairs, and each item's own sum and sum of squares. Cells come in the order of their axes."""

    def __init__(self, key: tuple, kind: str) -> None:
        self.key, self.kind, self.one = key, kind, key[-2] == key[-1]
        self.index: tuple[dict, dict] = ({}, {})
        self.pair, self.own = np.zeros((64, 64)), [np.zeros((64, 2)), np.zeros((64, 2))]
        self.rest: pd.DataFrame | None = None

    def add(self, cells: pd.DataFrame) -> None:
        """Takes all cells but those of the last axis, which may go on in the next batch."""
        cells = cells if self.rest is None else pd.concat([self.rest, cells], ignore_index=True)
        axis = cells["axis"].to_numpy()
        start = len(cells) - int(np.argmax((axis[::-1] != axis[-1]))) if (axis != axis[-1]).any() else 0
        self._take(cells.iloc[:start])
        self.rest = cells.iloc[start:].reset_index(drop=True)

    def _take(self, cells: pd.DataFrame) -> None:
        if cells.empty:
            return
        second = cells["own"].to_numpy() != self.key[-2]
        axis, value = pd.factorize(cells["axis"])[0], cells["value"].to_numpy(float)
        at = np.zeros(len(cells), int)
        for side in (0, 1):
            mine = np.flatnonzero(second == bool(side))
            codes, names = pd.factorize(cells["item"].iloc[mine])
            known = self.index[side]
            at[mine] = np.array([known.setdefault(n, len(known)) for n in names], int)[codes] if len(mine) else 0
            while len(known) > len(self.own[side]):
                self.own[side] = np.concatenate([self.own[side], np.zeros_like(self.own[side])])
            np.add.at(self.own[side], at[mine], np.stack([value[mine], value[mine] ** 2], axis=1))
        want = (len(self.own[0]), len(self.own[0 if self.one else 1]))
        if self.pair.shape != want:
            grown = np.zeros(want)
            grown[: self.pair.shape[0], : self.pair.shape[1]] = self.pair
            self.pair = grown
        for a in range(0, axis.max() + 1, _AXES):
            some = np.flatnonzero((axis >= a) & (axis < a + _AXES) & (value != 0))
            left, right = (some, some) if self.one else (some[~second[some]], some[second[some]])
            if self.kind == "dot":
                x, y = np.zeros((want[0], _AXES)), np.zeros((want[1], _AXES))
                np.add.at(x, (at[left], axis[left] - a), value[left])
                np.add.at(y, (at[right], axis[right] - a), value[right])
                self.pair += x @ y.T
            else:
                for v in np.unique(axis[some]):
                    r, c = left[axis[left] == v], right[axis[right] == v]
                    np.add.at(self.pair, (at[r][:, None], at[c][None]), np.minimum.outer(value[r], value[c]))

    def rows(self) -> tuple[np.ndarray, ...]:
        """First and second item, in their own order, their sum, and both items' own sums."""
        if self.rest is not None:
            self._take(self.rest)
        names = [np.array(list(i), object) for i in (self.index[0], self.index[0 if self.one else 1])]
        r, c = np.triu_indices(len(names[0]), 1) if self.one else (v.reshape(-1) for v in np.indices((len(names[0]), len(names[1]))))
        a, b, own = names[0][r], names[1][c], (self.own[0][r], self.own[0 if self.one else 1][c])
        swap = (a > b).astype(bool)
        first, second = np.where(swap, b, a), np.where(swap, a, b)
        one, other = np.where(swap[:, None], own[1], own[0]), np.where(swap[:, None], own[0], own[1])
        return first, second, self.pair[r, c], one[:, 0], other[:, 0], one[:, 1], other[:, 1]


def pair_sums(cells: DataFrame, kind: str, by: str | None = None) -> DataFrame:
    """``a, b, m, ta, tb, qa, qb`` (and ``by``) of all pairs of items a < b of ``cells(item, axis, value)``, within each group ``by`` if given.

    m is the sum of products (``kind`` dot) or of the smaller values (min) over the axes that both have; t and q are an item's own sum and sum of squares. An item needs one cell to be there, which may be 0. Cells go to every
    pair of blocks that theirs is in, so the table is sent as often as there are blocks; a task streams its cells by axis and holds a square of sums. The sums are saved as a table when this is called, since what reads them often reads them twice.
    """
    if kind not in ("dot", "min"):
        raise ValueError(kind)
    count = max(1, -(-(cells.agg(F.approx_count_distinct("item")).first()[0]) // BLOCK))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    keys = [*([by] if by else []), "i", "j"]
    own = cells.select(*([by] if by else []), "item", "axis", F.col("value").cast("double").alias("value"), F.pmod(F.xxhash64("item"), F.lit(count)).cast("int").alias("own"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")
    ordered = sent.repartition(*keys).sortWithinPartitions(*keys, "axis")
    out = [*([by] if by else []), "a", "b", "m", "ta", "tb", "qa", "qb"]
    types = {f.name: f.dataType for f in ordered.schema}
    from pyspark.sql.pandas.types import to_arrow_type

    item_type, by_type = to_arrow_type(types["item"]), to_arrow_type(types[by]) if by else None

    def done(sums: _Sums) -> Iterator[pa.RecordBatch]:
        first, second, *numbers = sums.rows()
        if len(first):
            group = [pa.array([sums.key[0]] * len(first), by_type)] if by else []
            yield pa.RecordBatch.from_arrays([*group, pa.array(first.tolist(), item_type), pa.array(second.tolist(), item_type), *map(pa.array, numbers)], out)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: _Sums | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.to_pandas()
            changed = np.append(True, np.any([frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1] for k in keys], axis=0))
            starts = np.append(np.flatnonzero(changed), len(frame))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                key = tuple(frame[k].iloc[a] for k in keys)
                if sums is None or sums.key != key:
                    if sums is not None:
                        yield from done(sums)
                    sums = _Sums(key, kind)
                sums.add(frame.iloc[a:b][["item", "axis", "value", "own"]].reset_index(drop=True))
        if sums is not None:
            yield from done(sums)

    group = f"{by} {kinds[by]}, " if by else ""
    return saved(ordered.mapInArrow(add_up, f"{group}a {kinds['item']}, b {kinds['item']}, m double, ta double, tb double, qa double, qb double"), "pairs")
