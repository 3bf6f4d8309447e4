"""Pairwise distances of samples, and permutation tests on them.

Distances are rows ``(s1, s2, d)`` with s1 < s2; labels are ``(sample_id, grp)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.functions.frames import counts_below, sql
from loamspark.operators.composition import permutations
from loamspark.session import saved


#: Samples and cells of a block, about.
BLOCK = 2048
CELLS = 1 << 22
#: Pairs of samples that a task counts at once, about, and meetings of their features. Samples of the second block that stand together in the result.
PAIRS = 1 << 18
MEETINGS = 1 << 20
TILE = 256


def bray_curtis(table: DataFrame) -> DataFrame:
    """1 - 2 sum(min) / (sum + sum): only features that both samples have meet; pairs without any are 1, two empty samples null."""
    return sql(
        """WITH n AS (SELECT sample_id, sum(value) AS t FROM {t} GROUP BY sample_id),
                o AS (SELECT x.sample_id AS s1, y.sample_id AS s2, sum(least(x.value, y.value)) AS m FROM {t} x JOIN {t} y ON x.feature_id = y.feature_id AND x.sample_id < y.sample_id GROUP BY ALL)
           SELECT a.sample_id AS s1, b.sample_id AS s2, 1 - 2 * coalesce(o.m, 0D) / nullif(a.t + b.t, 0) AS d
           FROM n a JOIN n b ON a.sample_id < b.sample_id LEFT JOIN o ON o.s1 = a.sample_id AND o.s2 = b.sample_id""",
        t=table,
    )


def jaccard(table: DataFrame) -> DataFrame:
    """1 - both / either over presences; two empty samples are 0 apart.

    A sample is one list of its features. The lists are saved once, as blocks of samples in their order, and each pair of blocks is read from there and counted in arrays: no row is made for a feature that two
    samples share, and nothing is shuffled or saved more than once, however many blocks there are. The result itself has a row for every pair.
    """
    present = F.collect_list(F.when(F.col("value") > 0, F.col("feature_id")))
    lists = saved(table.where("sample_id IS NOT NULL").groupBy("sample_id").agg(present.alias("features")), "presences")
    n = lists.agg(F.count("*").alias("samples"), F.coalesce(F.sum(F.size("features")), F.lit(0)).alias("cells")).first()
    parts = max(1, -(-n["samples"] // BLOCK), -(-n["cells"] // CELLS))
    ordered = lists.repartitionByRange(parts, "sample_id").sortWithinPartitions("sample_id")
    blocks = saved(ordered.mapInArrow(_pack, "block binary").withColumn("own", F.monotonically_increasing_id()), "blocks")
    # A pair of blocks comes twice, in either order. As a product of partitions, both sides are read where they are saved.
    pairs = blocks.hint("shuffle_replicate_nl").crossJoin(blocks.select(F.col("block").alias("beside"), F.col("own").alias("other")))
    kind = {f.name: f.dataType.simpleString() for f in lists.schema}["sample_id"]
    return pairs.mapInArrow(_jaccard, f"s1 {kind}, s2 {kind}, d double")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's samples, each as Arrow's bytes: samples, their numbers of features, the features in order, and which ones the samples have."""
    some, cells = [], 0
    for batch in batches:
        some.append(batch)
        cells += len(batch.column("features").flatten())
        if cells >= 2 * CELLS:
            yield _packed(some)
            some, cells = [], 0
    if sum(b.num_rows for b in some):
        yield _packed(some)


def _packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(some).combine_chunks()
    ids, lists = (rows.column(c).chunk(0) for c in ("sample_id", "features"))
    found = lists.flatten().dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    parts = {"ids": ids, "sizes": pc.list_value_length(lists), "features": found.dictionary.take(pa.array(order)), "code": pa.array(rank[found.indices.to_numpy(zero_copy_only=False)])}
    one = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in parts.values()], list(parts))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(one)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


class _Block:
    """A block of samples: their ids, sizes and cells, which are codes of its features."""

    def __init__(self, block: pa.Buffer) -> None:
        one = pa.ipc.open_stream(block).read_next_batch()
        self.ids, sizes, self.features, code = (one.column(c).flatten() for c in ("ids", "sizes", "features", "code"))
        self.sizes, self.code = sizes.to_numpy().astype(np.int64), code.to_numpy()
        self.start = np.append(0, np.cumsum(self.sizes))
        self.sample = np.repeat(np.arange(len(self.sizes)), self.sizes)


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distances within a block of samples, or between the first half of the earlier block and the later one; the other half comes with the blocks in the other order."""
    kept: tuple[int, _Block] | None = None
    for batch in batches:
        for own, other, block, beside in zip(*(batch.column(c) for c in ("own", "other", "block", "beside")), strict=True):
            i, j = own.as_py(), other.as_py()
            if kept is None or kept[0] != i:
                kept = (i, _Block(block.as_buffer()))
            one = kept[1]
            half = len(one.ids) // 2
            if i == j:
                yield from _distances(one, one, 0, len(one.ids))
            elif i < j:
                yield from _distances(one, _Block(beside.as_buffer()), 0, half)
            else:
                earlier = _Block(beside.as_buffer())
                yield from _distances(earlier, one, len(earlier.ids) // 2, len(earlier.ids))


def _distances(left: _Block, right: _Block, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """Of left's samples from begin to end to right's samples, or to those after them if both are one block; about PAIRS at once, in tiles: so ordered, files of the result are small."""
    wide = len(right.ids)
    met = _meetings(left, right)
    shape = None
    for a in range(begin, end, max(1, PAIRS // wide)):
        b = min(end, a + max(1, PAIRS // wide))
        if shape != b - a or left is right:
            shape = b - a
            at = np.concatenate([(np.arange(shape)[:, None] * wide + np.arange(t, min(wide, t + TILE))).reshape(-1) for t in range(0, wide, TILE)])
            if left is right:
                at = at[at // wide + a < at % wide]
            x, y = np.divmod(at, wide)
            seconds, far = right.ids.take(pa.array(y)), pa.array(np.ones(len(at)))
        if not len(at):
            continue
        both = met(a, b)
        if both is None and left.sizes[a:b].all():
            d = far
        else:
            m = np.zeros(len(at), np.int64) if both is None else both[at]
            either = left.sizes[x + a] + right.sizes[y] - m
            d = pa.array(np.where(either > 0, 1 - m / np.maximum(either, 1), 0.0))
        yield pa.RecordBatch.from_arrays([left.ids.take(pa.array(x + a)), seconds, d], ["s1", "s2", "d"])


def _meetings(left: _Block, right: _Block) -> Callable[[int, int], np.ndarray | None]:
    """For left's samples from a to b, how many features they share with each of right's; None if none of them any."""
    one, other = left.features, right.features
    if not len(one) or not len(other) or one[-1].as_py() < other[0].as_py() or other[-1].as_py() < one[0].as_py():
        return lambda a, b: None
    code = pc.fill_null(pc.index_in(one, value_set=other), -1).to_numpy()
    if (code < 0).all():
        return lambda a, b: None
    cell, wide = code[left.code], len(right.ids)
    of = right.sample[np.argsort(right.code)]
    many = np.bincount(right.code, minlength=len(other))
    first = np.cumsum(many) - many

    def met(a: int, b: int) -> np.ndarray | None:
        rows = left.start[a] + np.flatnonzero(cell[left.start[a] : left.start[b]] >= 0)
        if not len(rows):
            return None
        both = np.zeros((b - a) * wide, np.int64)
        # Each feature of a left sample meets the right samples that have it, about so many meetings at once.
        ends = np.cumsum(many[cell[rows]])
        for part in np.split(rows, np.searchsorted(ends, np.arange(MEETINGS, ends[-1], MEETINGS))):
            n = many[cell[part]]
            meets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[cell[part]], n)
            both += np.bincount(np.repeat((left.sample[part] - a) * wide, n) + of[meets], minlength=len(both))
        return both

    return met


def _checked(distances: DataFrame, labels: DataFrame) -> DataFrame:
    lost = sql("SELECT s FROM (SELECT s1 AS s FROM {d} UNION SELECT s2 FROM {d}) LEFT ANTI JOIN {l} l ON l.sample_id = s", d=distances, l=labels).first()
    if lost is not None:
        raise KeyError(lost["s"])
    return labels


def within(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """``perm, n, groups, sst, ssw`` for labels ``(perm, sample_id, grp)``: the sums of squares of every labelling at once."""
    return sql(
        """WITH g AS (SELECT perm, grp, count(*) AS n FROM {l} GROUP BY ALL),
                k AS (SELECT perm, sum(n) AS n, count(*) AS groups FROM g GROUP BY perm),
                w AS (SELECT a.perm, sum(d.d * d.d / g.n) AS ssw FROM {d} d JOIN {l} a ON a.sample_id = d.s1 JOIN {l} b ON b.sample_id = d.s2 AND b.perm = a.perm AND b.grp = a.grp
                      JOIN g ON g.perm = a.perm AND g.grp = a.grp GROUP BY a.perm)
           SELECT k.perm, k.n, k.groups, (SELECT sum(d * d) FROM {d}) / k.n AS sst, coalesce(w.ssw, 0D) AS ssw FROM k LEFT JOIN w ON w.perm = k.perm""",
        d=distances, l=labels,
    )


def permanova(distances: DataFrame, meta: DataFrame, n: int = 99) -> DataFrame:
    """Pseudo-F, R squared and permutation p; KeyError if a sample has no label; F is 0 without variance within."""
    f = sql(
        """SELECT perm, 1 - ssw / nullif(sst, 0) AS r2, CASE WHEN n = groups OR ssw = 0 THEN 0D WHEN groups > 1 THEN ((sst - ssw) / (groups - 1)) / (ssw / (n - groups)) END AS f FROM {w}""",
        w=within(distances, permutations(_checked(distances, meta), n)),
    )
    return sql("SELECT max(o.f) AS f, max(o.r2) AS r2, (count_if(x.perm > 0 AND x.f >= o.f - 1e-9D) + 1) / {b} AS p FROM {f} x CROSS JOIN (SELECT f, r2 FROM {f} WHERE perm = 0) o", f=f, b=float(n + 1))


def pairwise_permanova(distances: DataFrame, meta: DataFrame, n: int = 99) -> DataFrame:
    """PERMANOVA of every pair of groups in one plan, with q across the pairs."""
    pairs = sql("SELECT a.grp AS g1, b.grp AS g2 FROM (SELECT DISTINCT grp FROM {m}) a JOIN (SELECT DISTINCT grp FROM {m}) b ON a.grp < b.grp", m=meta)
    return sql(
        """WITH m AS (SELECT g1, g2, sample_id, grp, row_number() OVER (PARTITION BY g1, g2 ORDER BY sample_id) AS rn FROM {p} JOIN {m} ON grp IN (g1, g2)),
                x AS (SELECT g1, g2, perm, sample_id, row_number() OVER (PARTITION BY g1, g2, perm ORDER BY md5(concat(cast(perm AS STRING), ':', cast(sample_id AS STRING)))) AS rn
                      FROM m LATERAL VIEW explode(sequence(1, {n})) AS perm),
                l AS (SELECT x.g1, x.g2, x.perm, x.sample_id, m.grp FROM x JOIN m ON m.g1 = x.g1 AND m.g2 = x.g2 AND m.rn = x.rn UNION ALL SELECT g1, g2, 0, sample_id, grp FROM m),
                c AS (SELECT g1, g2, perm, grp, count(*) AS n FROM l GROUP BY ALL),
                k AS (SELECT g1, g2, perm, sum(n) AS n FROM c GROUP BY ALL),
                b AS (SELECT a.g1, a.g2, a.perm, sum(d.d * d.d) AS dd, coalesce(sum(d.d * d.d / c.n) FILTER (WHERE a.grp = z.grp), 0D) AS ssw
                      FROM {d} d JOIN l a ON a.sample_id = d.s1 JOIN l z ON z.sample_id = d.s2 AND z.g1 = a.g1 AND z.g2 = a.g2 AND z.perm = a.perm
                      JOIN c ON c.g1 = a.g1 AND c.g2 = a.g2 AND c.perm = a.perm AND c.grp = a.grp GROUP BY ALL),
                f AS (SELECT b.g1, b.g2, b.perm, 1 - ssw / nullif(dd / k.n, 0) AS r2, CASE WHEN k.n <= 2 OR ssw = 0 THEN 0D ELSE (dd / k.n - ssw) / (ssw / (k.n - 2)) END AS f
                      FROM b JOIN k ON k.g1 = b.g1 AND k.g2 = b.g2 AND k.perm = b.perm),
                r AS (SELECT f.g1, f.g2, max(o.f) AS f, max(o.r2) AS r2, (count_if(f.perm > 0 AND f.f >= o.f - 1e-9D) + 1) / {b} AS p
                      FROM f JOIN f o ON o.g1 = f.g1 AND o.g2 = f.g2 AND o.perm = 0 GROUP BY f.g1, f.g2),
                s AS (SELECT *, row_number() OVER (ORDER BY p, g1, g2) AS rn, count(*) OVER () AS m FROM r)
           SELECT g1, g2, f, r2, p, least(1D, min(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM s""",
        d=distances, m=_checked(distances, meta), p=pairs, n=n, b=float(n + 1),
    )


def anosim(distances: DataFrame, meta: DataFrame, n: int = 99) -> DataFrame:
    """R from average ranks between and within groups, and permutation p; 0 where either kind of pair is missing. Distances are saved first: they meet their ranks by value."""
    distances = saved(distances, "distances")
    r = sql(
        """WITH k AS (SELECT d.s1, d.s2, c.below + (c.n + 1) / 2D AS r, c.total AS m FROM {d} d JOIN {c} c ON c.d = d.d)
           SELECT a.perm, coalesce((avg(r) FILTER (WHERE a.grp <> b.grp) - avg(r) FILTER (WHERE a.grp = b.grp)) / (max(m) / 2D), 0D) AS r
           FROM k JOIN {l} a ON a.sample_id = s1 JOIN {l} b ON b.sample_id = s2 AND b.perm = a.perm GROUP BY a.perm""",
        d=distances, c=counts_below(distances, "d"), l=permutations(_checked(distances, meta), n),
    )
    return sql("SELECT max(o.r) AS r, (count_if(x.perm > 0 AND x.r >= o.r - 1e-9D) + 1) / {b} AS p FROM {r} x CROSS JOIN (SELECT r FROM {r} WHERE perm = 0) o", r=r, b=float(n + 1))


def variance_partition(distances: DataFrame, meta: DataFrame, variables: list[str]) -> DataFrame:
    """``component, fraction``: the pure part of each variable, the shared and the residual part of the variance."""
    sets = {"full": variables} | {f"without {v}": [w for w in variables if w != v] for v in variables if len(variables) > 1}
    labels = None
    for name, used in sets.items():
        part = meta.selectExpr(f"'{name}' AS perm", "sample_id", f"concat_ws('|', {', '.join(f'coalesce(cast({v} AS STRING), \"\")' for v in used)}) AS grp")
        labels = part if labels is None else labels.unionAll(part)
    r2 = {r["perm"]: 1 - r["ssw"] / r["sst"] if r["sst"] else 0.0 for r in within(distances, labels).collect()}
    pure = {v: max(0.0, r2["full"] - r2[f"without {v}"]) if len(variables) > 1 else r2["full"] for v in variables}
    rows = [*pure.items(), ("shared", max(0.0, r2["full"] - sum(pure.values()))), ("residual", 1 - r2["full"])]
    return distances.sparkSession.createDataFrame(rows, "component string, fraction double")


def gower_centred(distances: DataFrame) -> DataFrame:
    """``a, b, g``: -d squared / 2, doubly centred, for every ordered pair."""
    return sql(
        """WITH x AS (SELECT s1 AS a, s2 AS b, -d * d / 2 AS e FROM {d} UNION ALL SELECT s2, s1, -d * d / 2 FROM {d} UNION ALL SELECT s, s, 0D FROM (SELECT s1 AS s FROM {d} UNION SELECT s2 FROM {d}))
           SELECT a, b, e - avg(e) OVER (PARTITION BY a) - avg(e) OVER (PARTITION BY b) + (SELECT avg(e) FROM x) AS g FROM x""",
        d=distances,
    )
