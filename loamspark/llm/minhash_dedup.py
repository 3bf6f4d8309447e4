"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join, and exact shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .shared import connected_components, discard, written

#: Words of a shingle; documents are linked where 100 * intersection >= LEAST * union, or another threshold of RADII.
WORDS = 5
LEAST = 85
#: Slots of a signature, each of 8 bits, and the slots in which two may differ. Of pairs at the threshold itself about one in a
#: thousand differs in more (binomial tail of 40 slots at 0.15), of pairs at 0.9 one in 10 million.
SLOTS = 40
RADIUS = 13
#: The slots in which two may differ, by threshold: at 80, too, one in a thousand of the pairs at the threshold itself differs in more (tail at 0.2).
RADII = {LEAST: RADIUS, 80: 16}
#: Chunks that a signature is split into.
CHUNKS = 10
#: Rows of one key that are compared in one task; a larger bucket is dealt to tasks by pairs of parts.
BUCKET_ROWS = 1024
#: Documents of one part of a cluster, up to MAX_PARTS parts; then parts grow, up to so many shingles.
PART_DOCS = 64
MAX_PARTS = 64
PART_SHINGLES = 1 << 20
#: Keys of large buckets up to which their table is broadcast (12 bytes each); more are joined by shuffling.
BROADCAST_KEYS = 100_000

_FOLD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(2024)
_XOR = _rng.integers(0, 2**64, SLOTS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def layout(slots: int = SLOTS, radius: int = RADIUS, chunks: int = CHUNKS) -> list[tuple[int, int, int]]:
    """First slot, end and allowed errors of each chunk.

    By the pigeonhole principle, signatures that differ in at most ``radius`` slots differ in no more than the allowed
    errors in one chunk at least, as errors + 1 summed over the chunks is radius + 1. Chunks with an
    error more are a slot wider.
    """
    if chunks > radius + 1:
        raise ValueError("more chunks than errors to share")
    base, more = divmod(radius + 1, chunks)
    errors = [base - 1 + (i < more) for i in range(chunks)]
    free, over = divmod(slots - sum(errors), chunks)
    ends = np.cumsum([e + free + (i < over) for i, e in enumerate(errors)]).tolist()
    return [(a, b, e) for a, b, e in zip([0, *ends], ends, errors, strict=False)]


def keys_of(signatures: np.ndarray, slots: int = SLOTS, radius: int = RADIUS, chunks: int = CHUNKS) -> np.ndarray:
    """A column of keys for each chunk and choice of that many slots left out as the allowed errors.

    Two signatures within ``radius`` share a key. Keys are 64-bit hashes of chunk, choice and the slots kept.
    """
    out = []
    for first, end, errors in layout(slots, radius, chunks):
        for left in combinations(range(first, end), errors):
            h = np.full(len(signatures), len(out) + 1, np.uint64) * _FOLD
            for i in range(first, end):
                if i not in left:
                    h = (h ^ (signatures[:, i].astype(np.uint64) + np.uint64(1))) * _FOLD
                    h ^= h >> np.uint64(29)
            out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def shingle_sets(part: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's shingles, whole texts of fewer words as one; none for none."""
    raw, rows = blocks.utf8(part.column("text"))
    coded, _, at = blocks.words(blocks.LOWER[raw], rows, blocks.NOT_SPACE)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    n = max(0, len(word) - WORDS + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(WORDS):
        rolled = rolled * np.uint64(0x100000001B3) + word[j : n + j]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            s = np.sort(rolled[a : b - WORDS + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * np.uint64(0x100000001B3) + w
                out.append(mixed(np.array([h])))
        else:
            out.append(word[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SLOTS bytes for each set, none of which may be empty."""
    flat, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SLOTS), np.uint8)
    for k in range(SLOTS):
        least = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], first)
        out[:, k] = ((least ^ (least >> np.uint64(32))) * _FOLD) >> np.uint64(56)
    return out


def _narrow(docs: DataFrame) -> DataFrame:
    """``doc_id, t, n, s1, s2, sig``: the text's hash, the set's size and identity (128 bits) and its signature, null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                sets = shingle_sets(part)
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full)) if full else iter(())
                ids = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(i[0]) for i in ids], pa.int64()), pa.array([int(i[1]) for i in ids], pa.int64()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "t", "n", "s1", "s2", "sig"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(run, "doc_id long, t long, n long, s1 long, s2 long, sig binary")


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of ``near``'s graph; ``near(i, others)`` tells which others are linked with i."""
    left, a, b = np.arange(n), [], []
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = near(i, left)
            if hit.any():
                new = left[hit]
                left = left[~hit]
                a.append(np.full(len(new), i)), b.append(new)
                stack.extend(new.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


def _edges(ids: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    """Distinct pairs of ids, smaller first."""
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, int)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, int)
    if not len(a):
        return None
    x = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], ["a", "b"])


def _parts(df: DataFrame, id_: str) -> DataFrame:
    """``df`` with ``part``: rows of ``k`` parts are copied so that every pair of rows meets in one part."""
    k = F.col("k")
    own = F.pmod(F.xxhash64(id_, F.lit(5)), k).cast("int")
    code = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.least(j, own).cast("long") * k + F.greatest(j, own))
    return df.withColumn("part", F.explode(code)).drop("k")


def candidate_edges(reps: DataFrame, least: int = LEAST) -> DataFrame:
    """``a, b``: in every bucket of a key, a spanning forest of the pairs within the threshold's radius whose sizes allow a link."""
    radius = RADII[least]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(blocks.fixed(batch.column("sig"), np.uint8), radius=radius)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *(batch.column(c).take(rows) for c in ("id", "n", "sig"))], ["key", "id", "n", "sig"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.runs(batches, ["key", "part"]):
            starts = blocks.run_starts(table, ["key", "part"])
            sizes = np.diff(starts)
            if not (sizes > 1).any():
                continue
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            sig = blocks.fixed(table.column("sig"), np.uint8)

            def near(i: int | np.ndarray, j: np.ndarray, n: np.ndarray = n, sig: np.ndarray = sig) -> np.ndarray:
                return ((sig[i] != sig[j]).sum(axis=-1) <= radius) & (100 * np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]))

            two = starts[:-1][sizes == 2]
            two = two[near(two, two + 1)]
            pairs = [(two, two + 1)]
            for s in np.flatnonzero(sizes > 2):
                base = starts[s]
                a, b = forest(int(sizes[s]), lambda i, j, base=base: near(i + base, j + base))
                pairs.append((a + base, b + base))
            if (found := _edges(ids, pairs)) is not None:
                yield found

    keyed = reps.mapInArrow(explode, "key long, id long, n long, sig binary")
    # A sixteenth of the ids tells which buckets to split; it decides where pairs are compared, never whether.
    large = keyed.where("pmod(xxhash64(id), 16) = 0").groupBy("key").count().where(F.col("count") * 16 > BUCKET_ROWS)
    large = written(large.select("key", F.ceil(F.col("count") * 16 / BUCKET_ROWS).cast("int").alias("k")), "large")
    known = large.count()
    rows = keyed.withColumn("part", F.lit(0).cast("long"))
    if known:
        # Only the rows of large buckets are copied to parts.
        large = F.broadcast(large) if known <= BROADCAST_KEYS else large
        rows = rows.join(large, "key", "left_anti").unionByName(_parts(keyed.join(large, "key"), "id"))
    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return ordered.mapInArrow(compare, "a long, b long")


def exact_edges(docs: DataFrame, clusters: DataFrame, least: int = LEAST) -> DataFrame:
    """``a, b``: a spanning forest of the links within each cluster, by the full sets of its documents.

    ``clusters`` has ``node, component, n`` and ``id, t``, the document and text that stand for the node. A cluster's documents are dealt to parts; every pair of parts is a task's unit, so
    no cluster meets in one task. Every pair of a cluster's documents is compared unless it is connected already.
    """
    size = clusters.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    size = size.select("component", F.greatest(F.least(F.ceil(F.col("docs") / PART_DOCS), F.lit(MAX_PARTS)), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int").alias("k"))
    members = written(clusters.join(size, "component").select("node", "id", "t", "component", "k"), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                found = shingle_sets(part)
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                rows = blocks.binaries(flat.view(np.uint8), np.cumsum([0, *map(len, found)]) * 8)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("component"), part.column("k"), rows], ["id", "component", "k", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.runs(batches, ["component", "part"]):
            starts = blocks.run_starts(table, ["component", "part"])
            ids = table.column("id").to_numpy()
            rows = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            pairs = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a > 1:
                    x, y = linked(rows[a:b], least)
                    pairs.append((x + a, y + a))
            if (found := _edges(ids, pairs)) is not None:
                yield found

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), "text").join(members.hint("shuffle_hash"), ["id", "t"])
    rows = texts.mapInArrow(sets, "id long, component long, k int, shingles binary")
    ordered = _parts(rows, "id").repartition("component", "part").sortWithinPartitions("component", "part")
    return ordered.mapInArrow(compare, "a long, b long")


def linked(sets: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets that the threshold links, by exact intersections."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        hit = size.min() > 0 and 100 * both >= least * (size.sum() - both)
        return np.zeros(int(hit), int), np.ones(int(hit), int)
    known, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    mark = np.zeros(len(known), bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        fit = np.flatnonzero((size[others] > 0) & (100 * np.minimum(size[i], size[others]) >= least * np.maximum(size[i], size[others])))
        if len(fit):
            j = others[fit]
            own = code[first[i] : first[i] + size[i]]
            mark[own] = True
            both = np.add.reduceat(mark[code[blocks.spread(first[j], size[j])]].astype(np.int32), np.cumsum(size[j]) - size[j])
            mark[own] = False
            out[fit] = 100 * both >= least * (size[i] + size[j] - both)
        return out

    return forest(len(sets), near)


def _components(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, t, n, node, name`` of every row: its text's hash, its set's size, and the component's number and smallest id (null for an empty set and without id)."""
    narrow = written(_narrow(docs), "sets")
    known = narrow.where("n > 0 and doc_id is not null")
    same = known.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "t", "sig")).alias("first"))
    # Sets are numbered, as one id can have several.
    reps = same.select("s1", "s2", "n", F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("id"), F.col("first.t").alias("t"), F.col("first.sig").alias("sig"))
    reps = written(reps, "reps")
    clusters = connected_components(candidate_edges(reps.select(F.col("node").alias("id"), "n", "sig"), least))
    links = connected_components(exact_edges(docs, clusters.join(reps.select("node", "id", "t", "n"), "node"), least)).withColumnRenamed("component", "root")
    found = written(reps.select("s1", "s2", "n", "node", "id").join(links, "node", "left"), "found")
    names = found.where("root is not null").groupBy("root").agg(F.min("id").alias("name"))
    found = found.join(names, "root", "left").select("s1", "s2", "n", F.coalesce("root", "node").alias("node"), F.coalesce("name", "id").alias("name"))
    out = narrow.select("doc_id", "t", "n", "s1", "s2").join(found, ["s1", "s2", "n"], "left")
    return out.select("doc_id", "t", "n", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("node", "name")))


def _checked(least: int) -> int:
    if least not in RADII:
        raise ValueError("radii are calibrated for the thresholds of RADII")
    return least


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``, linked at ``least`` hundredths, a threshold of RADII.

    Words are runs of other than blank, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased; a set holds the text's
    distinct runs of WORDS words, of a text of fewer words its one sequence; null and empty texts, and those without a word, have an empty set and
    are linked with nothing. Rows of equal sets are one document from the start (a group's rows are aggregated before
    they are shuffled); their signatures meet in the multi-index Hamming join, pairs within the threshold's radius form clusters, and within a
    cluster the links are confirmed on the full sets. ``component_id`` is the smallest id that links reach, the
    document's own included, and ``kept`` tells the rows that it names. Rows that repeat an id and its set are one document; of different sets under one id each row has its own set's component. A row
    without id is linked with nothing, has no component and is kept. Other columns are not read; an empty
    table gives an empty one.
    """
    rows = _components(docs, _checked(least))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, but for near duplicates at ``least``: one document of each of ``dedup``'s groups.

    A group keeps the document of the smallest id, of several texts under that id the one of the smallest hash. Texts without a word are in no group
    and stay, so do rows without id. Of rows that repeat an id and its text one stays, the one whose columns have the smallest hash
    as JSON. So nothing depends on the order or the partitions of the rows. An empty table stays empty.
    """
    rows = _components(docs, _checked(least)).where("doc_id is not null")
    texts = written(rows.groupBy(F.col("doc_id").alias("id"), "t").agg(F.max("node").alias("node"), F.count("*").alias("rows")), "texts")
    first = texts.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "t")).alias("first")).select(F.col("first.id").alias("id"), F.col("first.t").alias("t"), F.lit(True).alias("first"))
    kept = written(texts.join(first, ["id", "t"], "left").select("id", "t", "rows", (F.col("node").isNull() | F.coalesce("first", F.lit(False))).alias("stays")), "kept")
    discard(texts)
    # The row travels as one column, so its names clash with nothing.
    nested = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), F.struct("*").alias("row"))
    out = nested.join(kept.where("not stays").select("id", "t"), ["id", "t"], "left_anti")
    twice = kept.where("stays and rows > 1").select("id", "t")
    if not twice.isEmpty():
        again = out.join(twice, ["id", "t"], "left_semi").groupBy("id", "t").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        out = out.join(twice, ["id", "t"], "left_anti").unionByName(again)
    return out.select("row.*")
