import random
import re

import numpy as np
import pytest

from loamspark.llm import minhash_dedup as m
from loamspark.llm import queries
from loamspark.llm.shared import connected_components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, least=85):
    """Size and component of every id."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for pair in {(a, b) for ids in by.values() for a in ids for b in ids if a < b}:
        a, b = sets[pair[0]], sets[pair[1]]
        if 100 * len(a & b) >= least * len(a | b):
            x, y = root(pair[0]), root(pair[1])
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_layout_guarantees_the_radius():
    for slots, radius, chunks in ((40, 13, 10), (20, 5, 3), (16, 0, 1), (30, 9, 10)):
        parts = m.layout(slots, radius, chunks)
        assert parts[0][0] == 0 and parts[-1][1] == slots and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert sum(e + 1 for *_, e in parts) == radius + 1
    with pytest.raises(ValueError):
        m.layout(10, 3, 5)


def test_signatures_within_the_radius_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 256, (1, m.SLOTS)).astype(np.uint8)
        b = a.copy()
        at = rng.choice(m.SLOTS, m.RADIUS, replace=False)
        b[0, at] ^= 1
        assert (m.keys_of(a) == m.keys_of(b)).any()
    far = rng.integers(0, 256, (2000, m.SLOTS)).astype(np.uint8)
    keys = m.keys_of(far)
    assert sum(len(np.unique(k)) for k in keys.T) > 0.999 * keys.size


def test_signature_distance_follows_similarity():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 2**63, 2000).astype(np.uint64))
    for drop in (0, 100, 400):
        d = []
        for _ in range(30):
            other = np.append(rng.choice(base, 2000 - drop, replace=False), rng.integers(0, 2**63, drop).astype(np.uint64))
            s = m.signatures([base, np.sort(other)])
            d.append((s[0] != s[1]).mean())
        assert abs(np.mean(d) - (1 - (2000 - drop) / (2000 + drop))) < 0.03


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(900, i) for i in range(300, 700, 7)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(700)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges[:-2]:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for a, b in edges[:-2] if a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def fixture():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5)))
    rows = [None, "", " \t\n", "one", "One", "a b c d", "a  B\nc d", "a b c", "\x0b\x0c", "x y z", "x y z"]
    for _ in range(40):
        base = [word() for _ in range(rng.choice([6, 30, 60, 150, 400]))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((" " if rng.random() < 0.5 else "\n").join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    rows += ["hot copy of a text with several words"] * 60
    base = [word() for _ in range(120)]
    for _ in range(150):  # a chain: each copy differs from the one before
        base[rng.randrange(120)] = word()
        rows.append(" ".join(base))
    return list(enumerate(rows))


@pytest.mark.parametrize("split", [False, True])
def test_dedup_is_brute_force(spark, split, monkeypatch):
    if split:
        for name, value in (("PART_DOCS", 7), ("BUCKET_ROWS", 16), ("BROADCAST_KEYS", 0)):
            monkeypatch.setattr(m, name, value)
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    want = brute(rows)
    got = m.dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r


def test_dedup_edges(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(None, text), (None, None), (4, text), (4, text), (9, text), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, m.dedup(docs).collect()), key=str)
    assert got == sorted([(None, 4, None, True), (None, 0, None, True), (4, 4, 4, True), (4, 4, 4, True), (9, 4, 4, False), (5, 0, 5, True)], key=str)
    assert m.dedup(docs.limit(0)).count() == 0


def test_dedup_query(spark, small):
    small = small.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_minhash_dedup(spark, small).collect()} == want
