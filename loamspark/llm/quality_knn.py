"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .toxicity import training_rows

#: Labelled documents at most that are searched for neighbours; their vectors are broadcast (1 MB).
MAX_LABELLED = 4000
#: Hashed byte trigrams of the term space, and the terms beside them.
TRIGRAMS = 2048
SHAPES = 5
DIMENSIONS = 64
NEIGHBOURS = 15
#: Similarities are raised to this power before they weight a label.
SHARPNESS = 8
#: Cosines no further apart than rounding are tied.
_TIED = 1e-6
#: Text bytes and rows of a slice; a row's terms take some 50 kB while they are worked on.
_SLICE = (4 << 20, 1024)


@dataclass
class Model:
    """Weights and latent axes of the terms, and the labelled vectors of unit length."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def terms(part: pa.RecordBatch) -> np.ndarray:
    """A row of weighted counts for each text: hashed byte trigrams, then its shape (repeated words, capitals, signs, words, lines)."""
    raw, rows = blocks.utf8(part.column("text"))
    n, size = part.num_rows, np.diff(rows)
    out = np.zeros((n, TRIGRAMS + SHAPES), np.float32)
    if len(raw) < 3:
        return out
    b = raw.astype(np.uint32)
    h = (b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(2246822519) + b[2:] * np.uint32(3266489917)) * np.uint32(668265263) >> np.uint32(21)
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    same = doc[2:] == doc[:-2]
    counts = np.bincount(doc[2:][same] * TRIGRAMS + h[same], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    out[:, :TRIGRAMS] = np.log1p(counts)
    coded, _, at = blocks.words(raw, rows, blocks.NOT_SPACE)
    index = coded.indices.to_numpy()
    total = lambda mask, edges: np.diff(np.append(0, np.cumsum(mask))[edges])
    again = np.append(False, index[1:] == index[:-1]) if len(index) else np.zeros(0, bool)
    again[at[:-1][at[:-1] < len(index)]] = False
    capital = (raw >= 65) & (raw <= 90)
    sign = (raw > 32) & (raw < 127) & ~blocks.ALNUM[raw]
    word = np.maximum(np.diff(at), 1)
    byte = np.maximum(size, 1)
    out[:, TRIGRAMS] = total(again, at) / word
    out[:, TRIGRAMS + 1] = total(capital, rows) / byte
    out[:, TRIGRAMS + 2] = total(sign, rows) / byte
    out[:, TRIGRAMS + 3] = np.log1p(np.diff(at)) / 10
    out[:, TRIGRAMS + 4] = total(raw == 10, rows) / word
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _normal(x: np.ndarray) -> np.ndarray:
    """Term rows with trigrams of unit length, beside which the shape has a fixed weight."""
    return np.hstack([_unit(x[:, :TRIGRAMS]), x[:, TRIGRAMS:]])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Latent axes and labelled vectors from at most MAX_LABELLED labelled documents.

    ``labels`` holds the rows that may be learnt from, any other columns of either table are not read; ids that are null or have no
    label 0 or 1 are not learnt from, an id with both labels counts as the more frequent, a tie as 1. Null and empty texts have the zero vector; rows that
    repeat an id are learnt from each. Without labelled documents, or with an empty table, the model has no vectors. The model depends on no order of the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text", *_SLICE):
                x = terms(part)
                yield pa.RecordBatch.from_arrays([part.column("label"), blocks.binaries(x.view(np.uint8).reshape(-1), np.arange(len(x) + 1) * x.shape[1] * 4)], ["label", "terms"])

    rows = training_rows(docs, labels, label, MAX_LABELLED).mapInArrow(run, "label int, terms binary").collect()
    rows.sort(key=lambda r: (bytes(r["terms"]), r["label"]))
    if not rows:
        return Model(np.ones(TRIGRAMS + SHAPES, np.float32), np.zeros((TRIGRAMS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    x = np.stack([np.frombuffer(r["terms"], np.float32) for r in rows])
    weight = np.ones(TRIGRAMS + SHAPES, np.float32)
    weight[:TRIGRAMS] = np.log((1 + len(x)) / (1 + (x[:, :TRIGRAMS] > 0).sum(axis=0))) + 0.1
    z = _normal(x * weight)
    # Randomised range finder with power steps; the seed is fixed, so equal rows give equal axes.
    q = np.random.default_rng(7).standard_normal((z.shape[1], DIMENSIONS + 16)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(z.T @ (z @ q))[0]
    right = np.linalg.svd(z @ q, full_matrices=False)[2][:DIMENSIONS]
    axes = (q @ right.T).astype(np.float32)
    return Model(weight, axes, _unit(z @ axes).astype(np.float32), np.array([r["label"] for r in rows], np.float32))


def vote(x: np.ndarray, model: Model) -> np.ndarray:
    """The share of label 1 among the nearest labelled vectors, weighted by cosine; 1 where there is no vector to compare.

    All vectors that are tied in the last place vote, with that place's share of the weight each. So the zero vector, equally
    far from all, gets the share of all labels.
    """
    if not len(model.labels):
        return np.ones(len(x))
    z = _unit(_normal(x * model.weight) @ model.axes)
    out = np.empty(len(z))
    k = min(NEIGHBOURS, len(model.labels))
    for at in range(0, len(z), 512):
        cos = z[at : at + 512] @ model.vectors.T
        near = np.argpartition(cos, -k, axis=1)[:, -k:]
        found = np.take_along_axis(cos, near, 1)
        w = np.maximum(found.astype(np.float64), 1e-3) ** SHARPNESS
        votes, weight = (w * model.labels[near]).sum(axis=1), w.sum(axis=1)
        edge = found.min(axis=1)
        for i in np.flatnonzero((cos >= edge[:, None] - _TIED).sum(axis=1) > k):
            tied = np.abs(cos[i] - edge[i]) <= _TIED
            above = (cos[i] > edge[i]) & ~tied
            w = np.maximum(cos[i][above].astype(np.float64), 1e-3) ** SHARPNESS
            last = (k - above.sum()) * max(float(edge[i]), 1e-3) ** SHARPNESS
            votes[i] = (w * model.labels[above]).sum() + last * model.labels[tied].mean()
            weight[i] = w.sum() + last
        out[at : at + 512] = votes / weight
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``: the weighted vote of the NEIGHBOURS nearest labelled documents for label 1, from 0 to 1.

    Only the whole text counts. Null and empty texts have the zero vector, equally far from all, and score the share of all labels. Repeated rows and
    null ids keep their rows; other columns are not read; an empty table gives an empty one. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text", *_SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(vote(terms(part), shared.value))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, whose text scores at least ``threshold``.

    Null and empty texts score the share of all labels, so all of them stay or go together; repeated rows and rows without id are judged like any;
    an empty table stays empty; a model without labelled vectors keeps all. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text", *_SLICE):
                yield part.filter(pa.array(vote(terms(part), shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
