"""Proportionality networks: edges ``(src, dst, phi)`` with src < dst, and nodes ``(feature_id)`` that may have none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.functions import graphs
from loamspark.functions.frames import sql
from loamspark.operators.pairs import pair_sums
from loamspark.session import saved


_PHI = "CASE WHEN k > 1 THEN greatest((qa + qb - 2 * m - pow(ta - tb, 2) / k) / (k - 1), 0D) END"


def phi(table: DataFrame, min_prevalence: float = 0.0, pseudocount: float = 1.0) -> DataFrame:
    """Variance of the log-ratio of every two features with enough prevalence, over all samples, by blocks of features (``pairs``).

    var(x - y) = var x + var y - 2 cov, with logarithms taken relative to an empty cell's, so absent cells add nothing and the
    covariance needs only the samples that both features have.
    """
    logs = sql(
        """WITH x AS (SELECT feature_id AS item, sample_id AS axis, ln((value + {c}) / {c}) AS value FROM {t} WHERE value > 0),
                f AS (SELECT item FROM x GROUP BY item HAVING count(*) >= {p} * (SELECT count(DISTINCT sample_id) FROM {t}))
           SELECT x.* FROM x LEFT SEMI JOIN f ON f.item = x.item""",
        t=table, p=min_prevalence, c=pseudocount,
    )
    counted = sql("SELECT *, (SELECT count(DISTINCT sample_id) FROM {t}) AS k FROM {s}", s=pair_sums(logs, "dot"), t=table)
    return counted.selectExpr("a AS src", "b AS dst", f"{_PHI} AS phi")


def phi_by_group(table: DataFrame, meta: DataFrame, min_prevalence: float = 0.0, pseudocount: float = 1.0) -> DataFrame:
    """``grp, src, dst, phi`` within the samples of every group ``(sample_id, grp)``; a feature that a group lacks is one of equal values there."""
    logs = sql(
        """WITH t AS (SELECT m.grp, t.feature_id, t.sample_id, t.value FROM {t} t JOIN {m} m ON m.sample_id = t.sample_id),
                k AS (SELECT grp, count(DISTINCT sample_id) AS n FROM t GROUP BY grp),
                x AS (SELECT grp, feature_id AS item, sample_id AS axis, ln((value + {c}) / {c}) AS value FROM t WHERE value > 0),
                c AS (SELECT grp, item, count(*) AS c FROM x GROUP BY grp, item),
                a AS (SELECT feature_id AS item, explode((SELECT collect_set(grp) FROM k)) AS grp FROM (SELECT DISTINCT feature_id FROM {t})),
                f AS (SELECT a.grp, a.item FROM a JOIN k ON k.grp = a.grp LEFT JOIN c ON c.grp = a.grp AND c.item = a.item WHERE coalesce(c.c, 0) >= {p} * k.n)
           SELECT f.grp, f.item, x.axis, coalesce(x.value, 0D) AS value FROM f LEFT JOIN x ON x.grp = f.grp AND x.item = f.item""",
        t=table, m=meta.select("sample_id", "grp"), p=min_prevalence, c=pseudocount,
    )
    return sql(
        f"""WITH k AS (SELECT m.grp, count(DISTINCT t.sample_id) AS k FROM {{t}} t JOIN {{m}} m ON m.sample_id = t.sample_id GROUP BY m.grp)
            SELECT s.grp, a AS src, b AS dst, {_PHI} AS phi FROM {{s}} s JOIN k ON k.grp = s.grp""",
        s=pair_sums(logs, "dot", "grp"), t=table, m=meta.select("sample_id", "grp"),
    )


def group_networks(pairs: DataFrame, percentile: float = 5.0, limit: float | None = None) -> DataFrame:
    """Edges of every group's network: under its own percentile of phi, or under one ``limit`` for all (a global or a fixed one). Groups of one sample have none."""
    if limit is not None:
        return network_at(pairs, limit)
    return sql("SELECT p.* FROM {p} p JOIN (SELECT grp, percentile(phi, {q}) AS t FROM {p} GROUP BY grp) c ON c.grp = p.grp WHERE p.phi <= c.t", p=pairs, q=percentile / 100)


def threshold(pairs: DataFrame, percentile: float) -> float:
    """The phi at a percentile of all pairs; 0 without pairs."""
    return pairs.agg(F.expr(f"percentile(phi, {percentile / 100!r})").alias("t")).first()["t"] or 0.0


def network(pairs: DataFrame, percentile: float = 5.0) -> DataFrame:
    return sql("SELECT * FROM {p} WHERE phi <= (SELECT percentile(phi, {q}) FROM {p})", p=pairs, q=percentile / 100)


def network_at(pairs: DataFrame, limit: float) -> DataFrame:
    return pairs.where(F.col("phi") <= limit)


def sensitivity(pairs: DataFrame, percentiles: list[float] | None = None) -> DataFrame:
    """Threshold and number of edges at every percentile, from one pass over the pairs."""
    at = percentiles or [float(i) for i in range(1, 21)]
    cuts = pairs.agg(F.expr(f"percentile(phi, array({', '.join(repr(p / 100) for p in at)}))").alias("t"))
    cuts = cuts.select(F.posexplode("t").alias("i", "limit")).select(F.element_at(F.array(*[F.lit(p) for p in at]), F.col("i") + 1).alias("percentile"), "limit")
    return pairs.join(F.broadcast(cuts), F.col("phi") <= F.col("limit")).groupBy("percentile", "limit").agg(F.count("*").alias("edges"))


def sensitivity_modules(pairs: DataFrame, percentiles: list[float] | None = None) -> DataFrame:
    """``percentile, limit, edges, modularity, modules`` at every percentile: each network's modules are found in a task of its own.

    Modules merge without weights; their modularity is weighted by phi. Features without an edge are modules of one.
    """
    at = percentiles or [float(i) for i in range(1, 21)]
    cuts = pairs.agg(F.expr(f"percentile(phi, array({', '.join(repr(p / 100) for p in at)}))").alias("t"))
    cuts = cuts.select(F.posexplode("t").alias("i", "limit")).select(F.element_at(F.array(*[F.lit(p) for p in at]), F.col("i") + 1).alias("percentile"), "limit")
    # Networks are nested: one of a percentile has all edges of the lower ones.
    size = pairs.select(F.col("src").alias("x")).unionAll(pairs.select("dst")).distinct().agg(F.count("*").alias("size"))
    kept = pairs.join(F.broadcast(cuts), F.col("phi") <= F.col("limit")).crossJoin(F.broadcast(size)).select("percentile", "limit", "size", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "phi")

    def modules(pdf: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(np.concatenate([pdf["src"].to_numpy(str), pdf["dst"].to_numpy(str)]), return_inverse=True)
        a, b, w = code[: len(pdf)], code[len(pdf) :], pdf["phi"].to_numpy(float)
        own, total = graphs.greedy_modules(len(names), a, b), w.sum()
        inner = np.bincount(own[a], w * (own[a] == own[b]), len(names))
        ends = np.bincount(own[a], w, len(names)) + np.bincount(own[b], w, len(names))
        q = float((inner / total - (ends / (2 * total)) ** 2).sum()) if total else 0.0
        found = len(np.unique(own)) + int(pdf["size"].iloc[0]) - len(names)
        return pd.DataFrame([(pdf["percentile"].iloc[0], pdf["limit"].iloc[0], len(pdf), q, found)], columns=["percentile", "limit", "edges", "modularity", "modules"])

    return kept.groupBy("percentile").applyInPandas(modules, "percentile double, limit double, edges long, modularity double, modules long")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).unionAll(edges.select(F.col("dst").alias("node"), F.col("src").alias("near")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree, and its part of all other nodes, of every node."""
    return sql(
        """SELECT n.feature_id, coalesce(d.degree, 0) AS degree, coalesce(coalesce(d.degree, 0) / nullif((SELECT count(*) FROM {n}) - 1, 0), 0D) AS degree_centrality
           FROM {n} n LEFT JOIN (SELECT node, count(*) AS degree FROM {b} GROUP BY node) d ON d.node = n.feature_id""",
        n=nodes, b=both_ways(edges),
    )


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return sql("SELECT n, n * (n - 1) / 2 AS possible, e AS edges, coalesce(e / nullif(n * (n - 1) / 2, 0), 0D) AS density FROM (SELECT count(*) AS n FROM {n}) CROSS JOIN (SELECT count(*) AS e FROM {e})", n=nodes, e=edges)


def shortest_paths(nodes: DataFrame, edges: DataFrame, sources: int | None = None, batch_rows: int = 200_000_000) -> DataFrame:
    """``feature_id, betweenness, closeness`` of every node by shortest paths without weights, level by level for many sources at once.

    A level is a table ``(source, node, depth, ways)``: the neighbours of the level before that neither it nor the one before it holds. From the deepest level back,
    a node's share of the paths through it is summed over the next level's neighbours. Edges are joined, never collected, and only row counts reach the driver.
    Sources are taken in batches by hash, so that a batch's levels hold ``batch_rows`` rows at most on average. With ``sources``, so many nodes, in the order of a hash, are searched from: betweenness is then scaled up by
    their part of all, and closeness is null for the others. A node without an edge has 0 in both; closeness is scaled by the part that a node reaches.
    """
    spark = nodes.sparkSession
    named = nodes.select("feature_id").where("feature_id IS NOT NULL").distinct()
    n = named.count()
    kind = nodes.schema["feature_id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"feature_id {kind}, betweenness double, closeness double")
    near = saved(both_ways(edges.where("src <> dst")).distinct(), "neighbours")
    asked = named if sources is None or sources >= n else named.orderBy(F.xxhash64("feature_id"), "feature_id").limit(sources)
    count = n if sources is None else min(n, sources)
    batches = max(1, -(-count * n // batch_rows))
    asked = saved(asked.withColumn("batch", F.pmod(F.xxhash64("feature_id", F.lit(3)), F.lit(batches))), "sources")
    through, reached = [], []
    for batch in range(batches):
        levels = [saved(asked.where(F.col("batch") == batch).select(F.col("feature_id").alias("source"), F.col("feature_id").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("ways")), "level")]
        while not levels[-1].isEmpty():
            last = levels[-1]
            known = last if len(levels) == 1 else last.unionAll(levels[-2])
            met = last.join(near, "node").groupBy("source", F.col("near").alias("node")).agg(F.sum("ways").alias("ways"))
            levels.append(saved(met.join(known.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(len(levels)).alias("depth"), "ways"), "level"))
        share = None
        for level in reversed(levels[1:-1]):
            own = level.select("source", "node", "ways")
            if share is None:
                share = own.withColumn("share", F.lit(0.0))
            else:
                back = share.join(near, "node").select("source", F.col("near").alias("node"), ((1 + F.col("share")) / F.col("ways")).alias("part"))
                part = back.groupBy("source", "node").agg(F.sum("part").alias("part"))
                share = saved(own.join(part, ["source", "node"], "left").select("source", "node", "ways", F.coalesce(F.col("ways") * F.col("part"), F.lit(0.0)).alias("share")), "shares")
            through.append(share.groupBy("node").agg(F.sum("share").alias("share")))
        for level in levels[1:-1]:
            reached.append(level.groupBy("source").agg(F.sum("depth").alias("far"), F.count("*").alias("n")))
    scale = (n / count) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    total = _union(through, "node").groupBy("node").agg((F.sum("share") * scale).alias("betweenness")) if through else None
    close = _union(reached, "source").groupBy("source").agg((F.sum("n") / F.sum("far") * F.sum("n") / (n - 1)).alias("closeness")) if reached else None
    out = named.join(asked.select("feature_id", F.lit(0.0).alias("zero")), "feature_id", "left")
    out = out.join(total.withColumnRenamed("node", "feature_id"), "feature_id", "left") if total is not None else out.withColumn("betweenness", F.lit(0.0))
    out = out.join(close.withColumnRenamed("source", "feature_id"), "feature_id", "left") if close is not None else out.withColumn("closeness", F.lit(None).cast("double"))
    return out.select("feature_id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("closeness", "zero").alias("closeness"))


def _union(frames: list[DataFrame], key: str) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``feature_id, hub, module`` of every node of one graph. Modules merge one after the other, so the driver holds the graph's edges."""
    spark = nodes.sparkSession
    names = [r[0] for r in nodes.select("feature_id").distinct().orderBy("feature_id").collect()]
    index = {v: i for i, v in enumerate(names)}
    rows = edges.select("src", "dst", "phi").collect()
    a, b, w = (np.array([f(r) for r in rows]) for f in (lambda r: index[r[0]], lambda r: index[r[1]], lambda r: float(r[2])))
    hub, module = graphs.hubs(len(names), a.astype(int), b.astype(int), w), graphs.greedy_modules(len(names), a.astype(int), b.astype(int))
    kind = nodes.schema["feature_id"].dataType.simpleString()
    return spark.createDataFrame([(v, float(hub[i]), int(module[i])) for i, v in enumerate(names)], f"feature_id {kind}, hub double, module int")


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Betweenness and closeness by ``shortest_paths``, hub score and module by ``modules``, of every node of one graph."""
    return shortest_paths(nodes, edges).join(modules(nodes, edges), "feature_id").select("feature_id", "betweenness", "closeness", "hub", "module")


def modularity(edges: DataFrame, modules: DataFrame, weight: str | None = "phi") -> DataFrame:
    """``q`` of the modules ``(feature_id, module)``: the sum over modules of the inner share less the squared share of ends; 0 without edges."""
    w = weight or "1D"
    return sql(
        f"""WITH e AS (SELECT m.module AS x, n.module AS y, cast({w} AS DOUBLE) AS w FROM {{e}} JOIN {{m}} m ON m.feature_id = src JOIN {{m}} n ON n.feature_id = dst),
                 t AS (SELECT sum(w) AS t FROM e),
                 s AS (SELECT module, sum(inner_w) AS i, sum(w) AS d FROM (SELECT x AS module, CASE WHEN x = y THEN w ELSE 0D END AS inner_w, w FROM e UNION ALL SELECT y, 0D, w FROM e) GROUP BY module)
            SELECT coalesce(sum(i / t.t - pow(d / (2 * t.t), 2)), 0D) AS q FROM s CROSS JOIN t""",
        e=edges, m=modules,
    )


def keystones(nodes: DataFrame, abundance: DataFrame, b_percentile: float = 0.5, a_percentile: float = 0.5) -> DataFrame:
    """Score and verdict of every node ``(feature_id, betweenness)``: high betweenness and low mean abundance."""
    return sql(
        """WITH k AS (SELECT count(DISTINCT sample_id) AS n FROM {a}),
                m AS (SELECT t.feature_id, t.betweenness AS b, coalesce(s.v, 0D) / k.n AS a FROM {t} t CROSS JOIN k LEFT JOIN (SELECT feature_id, sum(value) AS v FROM {a} GROUP BY feature_id) s ON s.feature_id = t.feature_id),
                x AS (SELECT max(b) AS bm, max(a) AS am, percentile(b, {bp}) AS bc, percentile(a, {ap}) AS ac FROM m)
           SELECT feature_id, b AS betweenness, a AS mean_abundance, coalesce(b / nullif(bm, 0), 0D) * (1 - coalesce(a / nullif(am, 0), 0D)) AS score, bm > 0 AND b >= bc AND am > 0 AND a <= ac AS is_keystone FROM m CROSS JOIN x""",
        t=nodes, a=abundance, bp=b_percentile, ap=a_percentile,
    )


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges of two networks as conserved, lost (only in the first) or gained."""
    return sql(
        """SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN a.src IS NULL THEN 'gained' WHEN b.src IS NULL THEN 'lost' ELSE 'conserved' END AS status
           FROM {a} a FULL OUTER JOIN {b} b ON b.src = a.src AND b.dst = a.dst""",
        a=first.select("src", "dst"), b=second.select("src", "dst"),
    )


def roles(modules: DataFrame, edges: DataFrame, z: float = 2.5, p: float = 0.62) -> DataFrame:
    """Within-module z of the degree, participation, and the role hub, bridge or peripheral."""
    return sql(
        """WITH d AS (SELECT e.node, y.module AS near, count(*) AS k FROM {b} e JOIN {m} y ON y.feature_id = e.near GROUP BY ALL),
                s AS (SELECT m.feature_id, m.module, coalesce(sum(d.k), 0) AS k, coalesce(sum(d.k) FILTER (WHERE d.near = m.module), 0) AS own, coalesce(sum(cast(d.k AS DOUBLE) * d.k), 0D) AS sq
                      FROM {m} m LEFT JOIN d ON d.node = m.feature_id GROUP BY ALL),
                w AS (SELECT *, avg(own) OVER (PARTITION BY module) AS mu, stddev_pop(own) OVER (PARTITION BY module) AS sd FROM s),
                r AS (SELECT feature_id, k, CASE WHEN sd > 1e-12D THEN (own - mu) / sd ELSE 0D END AS z, CASE WHEN k > 0 THEN 1 - sq / (cast(k AS DOUBLE) * k) ELSE 0D END AS p FROM w)
           SELECT feature_id, z, p AS participation, CASE WHEN k = 0 THEN 'peripheral' WHEN z >= {z} THEN 'hub' WHEN p >= {p} THEN 'bridge' ELSE 'peripheral' END AS role FROM r""",
        b=both_ways(edges), m=modules, z=z, p=p,
    )


def module_composition(modules: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Size, commonest phylum and its part of every module."""
    return sql(
        """WITH c AS (SELECT m.module, coalesce(nullif(t.phylum, ''), 'Unclassified') AS phylum, count(*) AS n FROM {m} m LEFT JOIN {t} t ON t.feature_id = m.feature_id GROUP BY ALL)
           SELECT module, size, phylum AS dominant, n / size AS fraction FROM (SELECT *, sum(n) OVER (PARTITION BY module) AS size, row_number() OVER (PARTITION BY module ORDER BY n DESC, phylum) AS rn FROM c) WHERE rn = 1""",
        m=modules, t=taxonomy,
    )


def null_model(edges: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """``i, q``: modularity of n networks rewired by degree-preserving swaps, spread over the cluster."""
    spark = edges.sparkSession
    rows = edges.select("src", "dst").collect()
    names = {v: i for i, v in enumerate(sorted({x for r in rows for x in r}))}
    a, b = np.array([names[r[0]] for r in rows], int), np.array([names[r[1]] for r in rows], int)
    shared = spark.sparkContext.broadcast((len(names), a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, a, b = shared.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            q = []
            for i in ids:
                x, y = graphs.rewire(a, b, np.random.default_rng([seed, int(i)]))
                q.append(graphs.modularity(size, x, y, graphs.greedy_modules(size, x, y)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(q, pa.float64())], ["i", "q"])

    return spark.range(n).repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "i long, q double")


def null_summary(null: DataFrame, observed: float) -> DataFrame:
    return sql("SELECT {q} AS observed, avg(q) AS mean_q, stddev_pop(q) AS sd_q, CASE WHEN stddev_pop(q) > 0 THEN ({q} - avg(q)) / stddev_pop(q) ELSE 0D END AS z, (count_if(q >= {q}) + 1) / (count(*) + 1) AS p FROM {n}", n=null, q=float(observed))
