"""Betweenness and closeness against a search from every node, and distributed principal axes against the exact ones."""

from __future__ import annotations

from collections import deque

import numpy as np
import pytest

from loamspark.operators import network as nw
from loamspark.operators import ordination as od


def brute(names, edges):
    near = {v: set() for v in names}
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    between, close, n = dict.fromkeys(names, 0.0), {}, len(names)
    for s in names:
        far, ways, order, todo = {s: 0}, {s: 1.0}, [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for u in near[v]:
                if u not in far:
                    far[u] = far[v] + 1
                    todo.append(u)
                if far[u] == far[v] + 1:
                    ways[u] = ways.get(u, 0.0) + ways[v]
        share = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in near[u]:
                if far[v] == far[u] - 1:
                    share[v] += ways[v] / ways[u] * (1 + share[u])
            if u != s:
                between[u] += share[u]
        total = sum(far.values())
        close[s] = (len(far) - 1) ** 2 / total / (n - 1) if total else 0.0
    return {v: (between[v] / ((n - 1) * (n - 2)), close[v]) for v in names}


def frames(spark, names, edges):
    return spark.createDataFrame([(v,) for v in names], "feature_id string"), spark.createDataFrame([(a, b, 0.1) for a, b in edges], "src string, dst string, phi double")


def test_paths_equal_a_search_from_every_node(spark):
    rng = np.random.default_rng(3)
    names = [f"v{i}" for i in range(20)]
    edges = sorted({tuple(sorted(rng.choice(names[:17], 2, False))) for _ in range(26)})
    nodes, table = frames(spark, names, [*edges, ("v1", "v1")])
    want = brute(names, edges)
    for rows in (200_000_000, 200):
        got = {r.feature_id: (r.betweenness, r.closeness) for r in nw.shortest_paths(nodes, table, batch_rows=rows).collect()}
        assert got.keys() == want.keys()
        for v in names:
            assert got[v] == pytest.approx(want[v], abs=1e-12), v


def test_sampled_sources_and_small_graphs(spark):
    names = [f"v{i}" for i in range(12)]
    ring = [(names[i], names[(i + 1) % 12]) for i in range(12)]
    nodes, table = frames(spark, names, ring)
    some = nw.shortest_paths(nodes, table, sources=6).collect()
    assert sum(r.closeness is not None for r in some) == 6
    # A ring is alike everywhere, so the mean over nodes is that of all sources.
    assert sum(r.betweenness for r in some) == pytest.approx(sum(b for b, _ in brute(names, ring).values()))
    assert nw.shortest_paths(nodes.limit(0), table).collect() == []
    alone = nw.shortest_paths(nodes, table.limit(0)).collect()
    assert len(alone) == 12 and all((r.betweenness, r.closeness) == (0, 0) for r in alone)


def pairs_of(spark, d):
    i, j = np.triu_indices(len(d), 1)
    return spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(i, j, d[i, j], strict=True)], "s1 int, s2 int, d double").repartition(5)


@pytest.mark.parametrize("n,tile", [(40, 8), (150, 64)])
def test_axes_equal_the_exact_ones(spark, monkeypatch, n, tile):
    monkeypatch.setattr(od, "TILE", tile)
    rng = np.random.default_rng(n)
    x = rng.random((n, 30)) ** 3
    d = np.abs(x[:, None] - x[None]).sum(axis=2) / (x[:, None] + x[None]).sum(axis=2)
    points, part = od.principal(d, 4)
    got = od.pcoa(pairs_of(spark, d), 4).collect()
    assert len(got) == 4 * n
    for r in got:
        assert r.value == pytest.approx(points[r.sample_id, r.axis - 1], abs=1e-8)
        # Where the space is not complete, the sum of the positive eigenvalues is a quadrature.
        assert r.explained == pytest.approx(part[r.axis - 1], rel=1e-9 if n == 40 else 0.1)


def test_axes_of_few_dimensions_and_few_samples(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    points, part = od.principal(d, 3)
    got = {(r.sample_id, r.axis): (r.value, r.explained) for r in od.pcoa(pairs_of(spark, d), 3).collect()}
    assert all(got[i, a + 1][0] == pytest.approx(points[i, a], abs=1e-7) and got[i, a + 1][1] == pytest.approx(part[a], abs=1e-9) for i in range(60) for a in range(2))
    two = {(r.sample_id, r.axis): r.value for r in od.pcoa(spark.createDataFrame([("a", "b", 1.0)], "s1 string, s2 string, d double"), 3).collect()}
    assert {k: abs(v) for k, v in two.items()} == {("a", 1): pytest.approx(0.5), ("b", 1): pytest.approx(0.5)}
    assert od.pcoa(spark.createDataFrame([], "s1 string, s2 string, d double"), 3).collect() == []
    same = od.pcoa(spark.createDataFrame([("a", "b", 0.0), ("a", "c", 0.0), ("b", "c", 0.0)], "s1 string, s2 string, d double"), 2).collect()
    assert all((r.value, r.explained) == (0, 0) for r in same)
