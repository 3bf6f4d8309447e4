"""Graph algorithms over node numbers, for one graph in one task."""

from __future__ import annotations

import numpy as np


def hubs(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Principal eigenvector of W W^T with sum 1; degrees' shares if it vanishes."""
    if not len(a):
        return np.zeros(n)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        y = np.bincount(a, w * x[b], n) + np.bincount(b, w * x[a], n)
        y = np.bincount(a, w * y[b], n) + np.bincount(b, w * y[a], n)
        if not y.sum():
            d = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            return d / d.sum()
        y /= y.sum()
        if np.abs(y - x).sum() < 1e-10:
            return y
        x = y
    return x


def modularity(n: int, a: np.ndarray, b: np.ndarray, module: np.ndarray) -> float:
    m = len(a)
    if not m:
        return 0.0
    inner = np.bincount(module[a][module[a] == module[b]], minlength=n)
    ends = np.bincount(module[a], minlength=n) + np.bincount(module[b], minlength=n)
    return float((inner / m - (ends / (2 * m)) ** 2).sum())


def greedy_modules(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Modules by greedy merging: the pair of joined modules whose union gains most modularity, until none gains.

    Ties go to the pair of smallest numbers. Modules are numbered by size, largest first, then by smallest member.
    """
    m = len(a)
    if not m:
        return np.zeros(n, int)
    shared: list[dict[int, float]] = [{} for _ in range(n)]
    ends = np.zeros(n)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        shared[x][y] = shared[x].get(y, 0) + 1 / m
        shared[y][x] = shared[y].get(x, 0) + 1 / m
        ends[x] += 1 / (2 * m)
        ends[y] += 1 / (2 * m)
    members = {i: [i] for i in range(n)}
    best: dict[int, tuple[float, int]] = {}

    def look(i: int) -> None:
        gains = [(e - 2 * ends[i] * ends[j], -j) for j, e in shared[i].items()]
        best[i] = (lambda g: (g[0], -g[1]))(max(gains)) if gains else (-1.0, -1)

    for i in range(n):
        look(i)
    while True:
        i = max(members, key=lambda k: (best[k][0], -k))
        gain, j = best[i]
        if gain <= 1e-15:
            break
        keep, gone = min(i, j), max(i, j)
        for k, e in shared[gone].items():
            del shared[k][gone]
            if k != keep:
                shared[keep][k] = shared[k][keep] = shared[keep].get(k, 0) + e
        shared[gone] = {}
        ends[keep] += ends[gone]
        members[keep] += members.pop(gone)
        del best[gone]
        look(keep)
        for k in shared[keep]:
            look(k)
        for k, (_, x) in list(best.items()):
            if x in (gone, keep) and k not in shared[keep] and k != keep:
                look(k)
    out = np.zeros(n, int)
    for number, (_, own) in enumerate(sorted(members.items(), key=lambda kv: (-len(kv[1]), min(kv[1])))):
        out[own] = number
    return out


def rewire(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, tries: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """As many degree-preserving swaps of two edges' ends as there are edges, in at most ``tries`` times as many attempts."""
    a, b = a.copy(), b.copy()
    m = len(a)
    known = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    done = 0
    for _ in range(tries * m):
        if done >= m or m < 2:
            break
        i, j = rng.integers(0, m, 2)
        u, v, x, y = int(a[i]), int(b[i]), int(a[j]), int(b[j])
        if rng.random() < 0.5:
            x, y = y, x
        if len({u, v, x, y}) < 4:
            continue
        p, q = (min(u, y), max(u, y)), (min(x, v), max(x, v))
        if p in known or q in known:
            continue
        known -= {(min(u, v), max(u, v)), (min(x, y), max(x, y))}
        known |= {p, q}
        a[i], b[i], a[j], b[j] = *p, *q
        done += 1
    return a, b
