"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .shared import discard, written

#: Labelled documents at most that a model is fitted on, taken in the order of a hash of their ids.
MAX_TRAINING = 20_000
#: Documents that must hold a token for it to have log-odds of its own; others have those of their longest known prefix.
LEAST_DOCUMENTS = 3
#: Weight of a token's prior, in documents; its mean is the next shorter prefix's share of toxic documents.
PRIOR = 2.5
#: Log-odds from which a word raises a segment's score; those of ordinary words lie between this and 0 by chance.
TOXIC_FROM = 1.5
#: Segments expected by chance in a document, at most, for a segment to count as significant.
MAX_EXPECTED = 0.5
_PREFIXES = (4, 5, 6, 7, 8)
_EDGES = "¿¡«»“”„‘’‚…–—·•  ​﻿"


@dataclass
class Model:
    """Tokens and their log-odds by prefix length (0: the whole word), and what turns segments into a score."""

    scores: dict[int, tuple[pa.Array, np.ndarray]] = field(default_factory=dict)
    drift: float = -0.03
    decay: float = 1.0
    k: float = 0.1
    weights: tuple[float, float, float] = (-4.0, 1.0, 0.0)


def _lowered(words: pa.Array) -> pa.Array:
    """Words as the model spells them; ``words`` are UTF-8 binaries."""
    return pc.utf8_trim(pc.utf8_lower(words.cast(pa.string())), characters=_EDGES)


def _units(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the word of every place, its first byte, and the rows' offsets into the places."""
    raw, rows = blocks.utf8(part.column("text"))
    coded, starts, at = blocks.words(raw, rows, blocks.ALNUM)
    return _lowered(coded.dictionary), coded.indices.to_numpy(), np.append(starts, len(raw)), at


def _counts(train: DataFrame) -> DataFrame:
    """``size, token, n0, n1, h0, h1``: documents of either label that hold the word (size 0) or a word with the prefix, and those of the first half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                words, index, _, at = _units(part)
                label, half = part.column("label").to_numpy(), part.column("half").to_numpy()
                doc = np.repeat(np.arange(part.num_rows), np.diff(at))
                for size in (0, *_PREFIXES):
                    coded = (pc.utf8_slice_codeunits(words, 0, size) if size else words).dictionary_encode()
                    n = len(coded.dictionary)
                    pairs = np.unique(doc * max(1, n) + coded.indices.to_numpy()[index].astype(np.int64))
                    token, own, first = pairs % max(1, n), label[pairs // max(1, n)], half[pairs // max(1, n)] == 0
                    sums = [np.bincount(token[(own == y) & which], minlength=n) for which in (np.True_, first) for y in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), coded.dictionary, *map(pa.array, sums)], ["size", "token", "n0", "n1", "h0", "h1"])

    counted = train.mapInArrow(run, "size int, token string, n0 long, n1 long, h0 long, h1 long")
    return counted.groupBy("size", "token").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "h0", "h1")]).where(F.col("n0") + F.col("n1") >= LEAST_DOCUMENTS)


def _log_odds(counts: pa.Table, n0: int, n1: int, zero: str, one: str) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Every token's log-odds against the corpus, with a Dirichlet prior about the share of its longest known prefix."""
    base = (n1 + 1) / (n0 + n1 + 2)
    means: dict[int, tuple[pa.Array, np.ndarray]] = {}
    for size in (*_PREFIXES, 0):
        own = counts.filter(pc.and_(pc.equal(counts.column("size"), size), pc.greater(pc.add(counts.column(zero), counts.column(one)), 1)))
        tokens = pa.concat_arrays([pa.array([], pa.string()), *own.column("token").chunks])
        a, b = (own.column(c).to_numpy().astype(float) for c in (zero, one))
        prior = np.full(len(tokens), base)
        for shorter, (known, share) in means.items():
            at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(tokens, 0, shorter), value_set=known), -1).to_numpy()
            prior[at >= 0] = share[at[at >= 0]]
        means[size] = tokens, (b + PRIOR * prior) / (a + b + PRIOR)
    return {size: (tokens, np.log(m / (1 - m)) - math.log(base / (1 - base))) for size, (tokens, m) in means.items()}


def _word_scores(words: pa.Array, model: Model) -> np.ndarray:
    """The log-odds of each word, or of its longest known prefix, or 0 where none is known."""
    found = np.zeros(len(words))
    for size in (*_PREFIXES, 0):
        if size not in model.scores:
            continue
        tokens, scores = model.scores[size]
        at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, 0, size) if size else words, value_set=tokens), -1).to_numpy()
        found[at >= 0] = scores[at[at >= 0]]
    return found


def _steps(odds: np.ndarray, model: Model) -> np.ndarray:
    """What a word adds to a segment: its log-odds, if they are toxic; else the drift, which is that of no toxic word, and its log-odds below 0."""
    return np.where(odds >= TOXIC_FROM, odds, np.minimum(odds, 0) + model.drift)


def segments(places: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as first place, last place and score (Ruzzo and Tompa's linear scan).

    ``places`` are those of positive scores, ``before`` and ``after`` the running total before and after each.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    for p, a, b in zip(places, before, after, strict=True):
        start, j = p, len(low) - 1
        while True:
            while j >= 0 and low[j] >= a:
                j -= 1
            if j < 0 or high[j] >= b:
                break
            start, a = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:]
            j -= 1
        first.append(start), last.append(p), low.append(a), high.append(b)
    return [(f, e, h - g) for f, e, g, h in zip(first, last, low, high, strict=True)]


def _scan(part: pa.RecordBatch, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray]]:
    """Number of words, maximal segments by word, and the byte of every word's start, for each row."""
    words, index, starts, at = _units(part)
    score = _steps(_word_scores(words, model), model)[index] if len(index) else np.zeros(0)
    # Log-odds are of documents that hold a word, however often, so a toxic word right after itself says nothing new.
    score[1:][(index[1:] == index[:-1]) & (score[1:] > 0)] = model.drift
    total = np.append(0.0, np.cumsum(score))
    hot = np.flatnonzero(score > 0)
    of = np.searchsorted(hot, at)
    for i in range(part.num_rows):
        p = hot[of[i] : of[i + 1]]
        yield int(at[i + 1] - at[i]), (segments(p.tolist(), total[p].tolist(), total[p + 1].tolist()) if len(p) else []), starts


def _evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """The significant segments' summed log-improbability, the same by word, and the segments."""
    chance = math.log(model.k * max(n, 1))
    kept = [(a, b, model.decay * s - chance) for a, b, s in found if model.decay * s - chance >= -math.log(MAX_EXPECTED)]
    total = sum(x for _, _, x in kept)
    return total, total / max(n, 1), kept


def _features(total: float, density: float) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * density)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_TRAINING) -> DataFrame:
    """``label, half, text`` of at most ``limit`` labelled ids, in the order of a hash; ids with both labels count as the more frequent."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("key"))
    ids = ids.agg((F.avg(label) >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(limit)
    ids = ids.select("key", "label", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(2)).cast("int").alias("half"))
    return docs.select(F.col("doc_id").cast("long").alias("key"), "text").join(F.broadcast(ids), "key").select("label", "half", "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from at most MAX_TRAINING labelled documents: calibrated on one half with the log-odds of the other, then given those of all.

    ``labels`` holds the rows that may be learnt from, any other columns of either table are not read; ids that are null or have no label 0 or 1 are not
    learnt from, an id with both labels counts as the more frequent, a tie as 1. Null and empty texts hold no word; rows that repeat an id are learnt from each. Without
    labels of both kinds in both halves, as with an empty table, the model scores everything 0.5 or less.
    """
    train = written(training_rows(docs, labels, label), "train")
    sizes = {(r["half"], r["label"]): r["n"] for r in train.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    if not all(sizes.get((h, y)) for h in (0, 1) for y in (0, 1)):
        discard(train)
        return Model(weights=(-1.0, 0.0, 0.0))
    n0, n1 = sizes[0, 0] + sizes[1, 0], sizes[0, 1] + sizes[1, 1]
    counted = written(_counts(train), "counts")
    share = F.col("n1") / (F.col("n0") + F.col("n1"))
    # Tokens that toxic documents favour clearly, and all tokens with the first letters of those that they favour at all; the others are ordinary.
    strong = (share >= 0.4) & (F.col("n1") >= LEAST_DOCUMENTS)
    stems = counted.where((F.col("size") == _PREFIXES[0]) & (share >= 1.5 * n1 / (n0 + n1))).select(F.col("token").alias("stem"), F.lit(True).alias("near"))
    counts = counted.join(stems, F.substring("token", 1, _PREFIXES[0]) == F.col("stem"), "left").where(strong | F.col("near")).drop("stem", "near")
    counts = counts.orderBy("size", "token").toArrow()
    # On one half's documents, with the log-odds of the other.
    model = Model(scores=_log_odds(counts, sizes[0, 0], sizes[0, 1], "h0", "h1"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                words, index, _, at = _units(part)
                hot = np.append(0, np.cumsum((_word_scores(words, model) >= TOXIC_FROM)[index]))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.diff(at)), pa.array(np.diff(hot[at]))], ["label", "n", "hot"])

    seen = train.where("half = 1").mapInArrow(hits, "label int, n long, hot long").groupBy("label").agg(F.sum("n").alias("n"), F.sum("hot").alias("hot")).collect()
    rate = {r["label"]: (r["hot"] + 1) / (r["n"] + 100) for r in seen}
    model.drift = min(-1e-3, math.log1p(-min(0.5, rate.get(1, 0.02))) - math.log1p(-min(0.5, rate.get(0, 0.0))))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                got = [(n, max((x for _, _, x in found), default=0.0)) for n, found, _ in _scan(part, model)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([x for _, x in got], pa.float64())], ["n", "high"])

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                got = [_evidence(n, found, model)[:2] for n, found, _ in _scan(part, model)]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([x for x, _ in got], pa.float64()), pa.array([x for _, x in got], pa.float64())], ["label", "total", "density"])

    half = train.where("half = 1")
    # Gumbel's location by maximum likelihood over the clean documents; scores are log-odds, so they decay with 1.
    clean = half.where("label = 0").mapInArrow(highest, "n long, high double").where("n > 0").collect()
    model.k = min(1.0, max(1e-9, len(clean) / max(1e-9, sum(r["n"] * math.exp(-model.decay * r["high"]) for r in clean))))
    rows = half.mapInArrow(evidence, "label int, total double, density double").collect()
    for table in (counted, train):
        discard(table)
    x = [(1.0, *_features(r["total"], r["density"])) for r in rows]
    model.weights = tuple(_logistic(np.array(x), np.array([r["label"] for r in rows], float)))
    # What was calibrated on unseen documents holds for the log-odds from all of them.
    model.scores = _log_odds(counts, n0, n1, "n0", "n1")
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method, the slopes kept from falling below zero."""
    free = np.ones(x.shape[1], dtype=bool)
    while True:
        w = np.zeros(x.shape[1])
        z = x[:, free]
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w[free], -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w[free])
            w[free] += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        bad = (w < 0) & (np.arange(len(w)) > 0)
        if not bad.any():
            return w
        free &= ~bad


def _score(part: pa.RecordBatch, model: Model) -> Iterator[tuple[float, list[dict]]]:
    w0, w1, w2 = model.weights
    rows = blocks.utf8(part.column("text"))[1]
    for i, (n, found, starts) in enumerate(_scan(part, model)):
        total, density, kept = _evidence(n, found, model)
        a, b = _features(total, density)
        spans = [{"start": int(starts[f] - rows[i]), "end": int(min(starts[e + 1], rows[i + 1]) - rows[i]), "evidence": x} for f, e, x in kept]
        yield 1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w1 * a + w2 * b)))), spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, spans``: the probability that the text is toxic, and its significant passages in bytes of the UTF-8 text.

    Only the whole text counts. Null and empty texts have no passage and get the score of no evidence.
    Repeated rows and null ids keep their rows; other columns are not read; an empty table gives an empty one.
    A span ends where the word after it starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                got = list(_score(part, model))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([x for _, x in got], _SPANS)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, evidence: double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, whose text scores below ``threshold``.

    Null and empty texts have no passage and stay, as the score of no evidence is low; repeated rows and rows without id are judged like any; an
    empty table stays empty. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                yield part.filter(pa.array([s < threshold for s, _ in _score(part, model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
