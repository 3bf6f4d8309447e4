"""Ordination of distances ``(s1, s2, d)`` and resampling of abundances.

Principal axes come from tiles of the distances spread over the cluster. For non-metric scaling a distance matrix of n samples is one task's work, n squared numbers; draws are spread by sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.functions.frames import sql

#: Samples along a side of a tile of distances, and samples whose numbers are broadcast at most.
TILE = 512
BROADCAST_SAMPLES = 500_000


def square(pairs: pd.DataFrame) -> tuple[list, np.ndarray]:
    names = sorted(set(pairs["s1"]) | set(pairs["s2"]))
    at = {v: i for i, v in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    i, j = pairs["s1"].map(at).to_numpy(), pairs["s2"].map(at).to_numpy()
    d[i, j] = d[j, i] = pairs["d"].to_numpy(float)
    return names, d


def principal(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates on the k largest axes and their parts of the positive eigenvalues; each axis has its largest entry positive."""
    n = len(d)
    k = min(k, max(n - 1, 0))
    e = -0.5 * d**2
    e = e - e.mean(axis=0) - e.mean(axis=1)[:, None] + e.mean()
    value, vector = np.linalg.eigh(e)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    if k:
        vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(k)])
    positive = np.clip(np.linalg.eigvalsh(e), 0, None).sum()
    return vector * np.sqrt(np.clip(value, 0, None)), np.clip(value, 0, None) / positive if positive else np.zeros(k)


def _one_task(distances: DataFrame, f, schema: str) -> DataFrame:
    return distances.groupBy().applyInPandas(lambda pdf: f(pdf), schema)


def _tiles(distances: DataFrame, names: list) -> DataFrame:
    """``i, j, e``: tiles of TILE by TILE samples, each the numbers of its pairs and minus half their squared distances as bytes. Pairs are dealt by tile, so no task holds all of them."""
    spark, kind = distances.sparkSession, distances.schema["s1"].dataType.simpleString()
    numbers = spark.createDataFrame([(v, i) for i, v in enumerate(names)], f"name {kind}, number int")
    numbers = F.broadcast(numbers) if len(names) <= BROADCAST_SAMPLES else numbers
    coded = distances.join(numbers.select(F.col("name").alias("s1"), F.col("number").alias("i")), "s1").join(numbers.select(F.col("name").alias("s2"), F.col("number").alias("j")), "s2")
    coded = coded.where("i <> j").select("i", "j", (-0.5 * F.col("d").cast("double") * F.col("d")).alias("e"), F.floor(F.col("i") / TILE).alias("x"), F.floor(F.col("j") / TILE).alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A piece of a tile at a time: products add up.
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in ("i", "j", "e")], ["i", "j", "e"])

    return coded.repartition("x", "y").sortWithinPartitions("x", "y").select("i", "j", "e").mapInArrow(pack, "i binary, j binary, e binary")


def _product(tiles: DataFrame, x: np.ndarray) -> np.ndarray:
    """The centred matrix times a thin block: tasks multiply their tiles, Spark adds up by row."""
    x = x - x.mean(axis=0)
    shared = tiles.sparkSession.sparkContext.broadcast(x)
    k = x.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        y, met = np.zeros_like(own), np.zeros(len(own), bool)
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, e = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("i", np.int32), ("j", np.int32), ("e", np.float64)))
                np.add.at(y, i, e[:, None] * own[j])
                np.add.at(y, j, e[:, None] * own[i])
                met[i] = met[j] = True
        rows = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(y[rows, c]) for c in range(k))], ["row", *(f"y{c}" for c in range(k))])

    found = tiles.mapInArrow(multiply, ", ".join(["row long", *(f"y{c} double" for c in range(k))])).groupBy("row").agg(*(F.sum(f"y{c}").alias(f"y{c}") for c in range(k))).toPandas()
    y = np.zeros_like(x)
    y[found["row"].to_numpy(int)] = found[[f"y{c}" for c in range(k)]].to_numpy(float)
    shared.unpersist()
    return y - y.mean(axis=0)


def leading(tiles: DataFrame, n: int, axes: int, block: int = 8, steps: int = 60, tolerance: float = 1e-11) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of the centred matrix, their vectors, and the sum of the positive ones, by a block Krylov space with full orthogonalisation.

    Each step is one product with the tiles; the driver holds thin blocks, n rows each, and a small projected matrix. It ends where the wanted pairs' residuals are within ``tolerance`` of the largest
    eigenvalue, or where the space is complete. The sum of the positive eigenvalues is exact in a complete space; else it is the random start block's quadrature.
    """
    rng = np.random.default_rng(42)
    start = rng.standard_normal((n, min(block, n)))
    q = np.linalg.qr(start - start.mean(axis=0))[0][:, : max(n - 1, 0)]
    basis, image, width = np.zeros((n, 0)), np.zeros((n, 0)), q.shape[1]
    value, vector, total = np.zeros(0), np.zeros((n, 0)), 0.0
    for _ in range(steps):
        if not q.shape[1]:
            break
        w = _product(tiles, q)
        basis, image = np.column_stack([basis, q]), np.column_stack([image, w])
        t = basis.T @ image
        theta, y = np.linalg.eigh((t + t.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        k = min(axes, len(theta))
        value, vector = theta[:k], basis @ y[:, :k]
        gap = np.linalg.norm(image @ y[:, :k] - vector * value, axis=0)
        size = max(np.abs(theta).max(), 1e-300)
        rest = w - basis @ (basis.T @ w)
        rest -= basis @ (basis.T @ rest)
        u, s, _ = np.linalg.svd(rest - rest.mean(axis=0), full_matrices=False)
        q = u[:, s > 1e-10 * size][:, : max(n - 1 - basis.shape[1], 0)]
        complete = not q.shape[1]
        positive = np.clip(theta, 0, None)
        total = float(positive.sum()) if complete else float((y[:width] ** 2 @ positive).sum() * (n - 1) / width)
        if complete or (len(theta) >= axes and (gap[value > 1e-12 * size] <= tolerance * size).all()):
            break
    return value, vector, total


def pcoa(distances: DataFrame, axes: int = 2) -> DataFrame:
    """``sample_id, axis, value, explained``: coordinates on the largest axes, and their parts of the positive eigenvalues; each axis has its largest entry positive.

    Distances stay in tiles over the cluster; the driver holds the samples' names and thin blocks (``leading``). An absent pair has distance 0.
    """
    spark, kind = distances.sparkSession, distances.schema["s1"].dataType.simpleString()
    tiled = distances.select("s1", "s2", "d").persist()
    try:
        names = [r[0] for r in tiled.select(F.col("s1").alias("name")).unionAll(tiled.select("s2")).distinct().orderBy("name").collect()]
        n, k = len(names), min(axes, max(len(names) - 1, 0))
        schema = f"sample_id {kind}, axis int, value double, explained double"
        if not k:
            return spark.createDataFrame([], schema)
        tiles = _tiles(tiled, names).persist()
        try:
            value, vector, total = leading(tiles, n, k)
        finally:
            tiles.unpersist()
    finally:
        tiled.unpersist()
    x = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(value))]) * np.sqrt(np.clip(value, 0, None))
    part = np.clip(value, 0, None) / total if total else np.zeros(len(value))
    rows = pd.DataFrame({"sample_id": np.repeat(np.array(names, object), len(value)), "axis": np.tile(np.arange(1, len(value) + 1), n), "value": x.reshape(-1), "explained": np.tile(part, n)})
    return spark.createDataFrame(rows, schema)


def isotonic(y: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling neighbours that violate the order."""
    level: list[list[float]] = []
    for v in y:
        level.append([v, 1])
        while len(level) > 1 and level[-2][0] > level[-1][0]:
            v2, n2 = level.pop()
            v1, n1 = level.pop()
            level.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.repeat([v for v, _ in level], [int(n) for _, n in level])


def scaled(d: np.ndarray, k: int = 2, rounds: int = 300, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Non-metric scaling by majorisation from the principal coordinates: distances are fitted by a monotone function of the dissimilarities. Returns the points and stress 1."""
    n = len(d)
    x = principal(d, k)[0]
    x = np.pad(x, ((0, 0), (0, k - x.shape[1]))) + np.random.default_rng(42).normal(0, 1e-6, (n, k))
    i, j = np.triu_indices(n, 1)
    order = np.argsort(d[i, j], kind="stable")
    last, stress = np.inf, 0.0
    for _ in range(rounds):
        far = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))
        fit = np.empty_like(far)
        fit[order] = isotonic(far[order])
        fit *= np.sqrt(far @ far / max(fit @ fit, 1e-300))
        stress = float(np.sqrt(((far - fit) ** 2).sum() / max((far**2).sum(), 1e-300)))
        if last - stress < tolerance:
            break
        last = stress
        ratio = np.zeros((n, n))
        ratio[i, j] = ratio[j, i] = fit / np.maximum(far, 1e-12)
        x = (np.diag(ratio.sum(axis=1)) - ratio) @ x / n
    return x, stress


def nmds(distances: DataFrame, axes: int = 2) -> DataFrame:
    """``sample_id, axis, value, stress``."""
    kind = distances.schema["s1"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = square(pdf)
        x, stress = scaled(d, axes)
        return pd.DataFrame([(s, a + 1, x[i, a], stress) for i, s in enumerate(names) for a in range(axes)], columns=["sample_id", "axis", "value", "stress"])

    return _one_task(distances, run, f"sample_id {kind}, axis int, value double, stress double")


def permdisp(distances: DataFrame, meta: DataFrame, n: int = 99) -> DataFrame:
    """F of the distances to the groups' centroids on two principal axes, with a permutation p of the labels."""
    from loamspark.operators.composition import permutations

    points = pcoa(distances, 2).groupBy("sample_id").pivot("axis", [1, 2]).agg(F.first("value")).select("sample_id", F.coalesce("1", F.lit(0.0)).alias("x"), F.coalesce("2", F.lit(0.0)).alias("y"))
    spread = sql(
        """WITH g AS (SELECT p.sample_id, m.grp, p.x, p.y FROM {p} p JOIN {m} m ON m.sample_id = p.sample_id), c AS (SELECT grp, avg(x) AS x, avg(y) AS y FROM g GROUP BY grp)
           SELECT g.sample_id, sqrt(pow(g.x - c.x, 2) + pow(g.y - c.y, 2)) AS z FROM g JOIN c ON c.grp = g.grp""",
        p=points, m=meta,
    )
    f = sql(
        """WITH a AS (SELECT l.perm, l.grp, count(*) AS n, avg(z) AS m, sum(z * z) AS q, sum(z) AS s FROM {z} z JOIN {l} l ON l.sample_id = z.sample_id GROUP BY ALL),
                t AS (SELECT perm, sum(n) AS n, count(*) AS g, sum(q) AS q, sum(s) AS s, sum(s * s / n) AS b FROM a GROUP BY perm)
           SELECT perm, CASE WHEN g > 1 AND n > g AND q - b > 1e-12D THEN ((b - s * s / n) / (g - 1)) / ((q - b) / (n - g)) ELSE 0D END AS f FROM t""",
        z=spread, l=permutations(meta, n),
    )
    return sql("SELECT max(o.f) AS f, (count_if(x.perm > 0 AND x.f >= o.f - 1e-9D) + 1) / {b} AS p FROM {f} x CROSS JOIN (SELECT f FROM {f} WHERE perm = 0) o", f=f, b=float(n + 1))


def rarefaction(table: DataFrame, depths: int = 20, draws: int = 10, seed: int = 42) -> DataFrame:
    """``sample_id, depth, mean and sd of richness and Shannon``: multinomial draws of every sample at depths up to the smallest total."""
    low = int(table.groupBy("sample_id").agg(F.sum("value").alias("t")).agg(F.min("t")).first()[0] or 0)
    at = np.unique(np.linspace(max(1, int(0.1 * low)), low, depths).astype(int)) if low > 0 else np.array([0])
    kind = table.schema["sample_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature_id")
        v = pdf["value"].to_numpy(float)
        p = v / v.sum() if v.sum() else np.zeros(len(v))
        rng = np.random.default_rng([seed, abs(hash(str(key[0]))) % 2**31 if isinstance(key[0], str) else int(key[0])])
        out = []
        for depth in at.tolist():
            if depth > v.sum() or not v.sum():
                out.append((key[0], depth, None, None, None, None) if v.sum() else (key[0], depth, 0.0, 0.0, 0.0, 0.0))
                continue
            x = rng.multinomial(depth, p, draws)
            share = np.where(x > 0, x / depth, 1.0)
            r, h = (x > 0).sum(axis=1), -(share * np.log(share)).sum(axis=1)
            out.append((key[0], depth, r.mean(), r.std(), h.mean(), h.std()))
        return pd.DataFrame(out, columns=["sample_id", "depth", "richness", "richness_sd", "shannon", "shannon_sd"])

    return table.groupBy("sample_id").applyInPandas(run, f"sample_id {kind}, depth long, richness double, richness_sd double, shannon double, shannon_sd double")


def expected_richness(table: DataFrame, depth: int) -> DataFrame:
    """What draws of a depth show on average: the sum of 1 - (1 - share) ^ depth."""
    return sql("SELECT sample_id, sum(1 - pow(1 - p, {n})) AS richness FROM (SELECT sample_id, value / sum(value) OVER (PARTITION BY sample_id) AS p FROM {t} WHERE value > 0) GROUP BY sample_id", t=table, n=depth)
