import corpus_pipeline as c
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamspark.llm import minhash_dedup as m

from test_minhash import fixture, shingles


def brute(rows, least):
    """Component of every id by all pairs, and the number of pairs of different sets at least so similar but under 0.85."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by, between = {}, 0
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for a, b in {(a, b) for ids in by.values() for a in ids for b in ids if a < b}:
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 100 * both >= least * either:
            between += 100 * both < 85 * either
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, between


def test_stage_links_at_four_fifths(spark, small):
    sf = small.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, between = brute([(r.doc_id, r.text) for r in docs.collect()], 80)
    assert between >= 4
    assert {r.doc_id for r in c.drop_near_duplicates(spark, docs, sf).collect()} == {i for i, root in want.items() if i == root}


@pytest.mark.parametrize("split", [False, True])
def test_dedup_at_four_fifths_is_brute_force(spark, split, monkeypatch):
    if split:
        for name, value in (("PART_DOCS", 7), ("BUCKET_ROWS", 16), ("BROADCAST_KEYS", 0)):
            monkeypatch.setattr(m, name, value)
    rows = fixture()
    want, between = brute(rows, 80)
    assert between
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in m.dedup(docs, 80).collect()} == want
    with pytest.raises(ValueError):
        m.dedup(docs, 50)


def test_signatures_within_the_radius_at_four_fifths_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 256, (1, m.SLOTS)).astype(np.uint8)
        b = a.copy()
        b[0, rng.choice(m.SLOTS, m.RADII[80], replace=False)] ^= 1
        assert (m.keys_of(a, radius=m.RADII[80]) == m.keys_of(b, radius=m.RADII[80])).any()


def test_keep_first_whatever_the_columns_and_the_order(spark):
    """Columns named like the code's own, ids with several texts, repeated rows: one text of each group stays, by no order."""
    one, two, three = "a b c d e f", "totally different words of another text", "q r s t u v w x y z q r s t u v w x y"
    rows = [(7, one), (7, two), (7, three), (3, three + " z"), (4, two), (9, None), (9, ""), (9, one), (None, one), (12, None), (12, None)]
    names = ["id", "t", "n", "s1", "s2", "sig", "node", "name", "row", "root", "component", "k", "part", "key", "stays", "first", "rows", "kept", "a", "b", "size", "__loamspark_id"]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(names)), "'x' AS `with.dot`", "map('a', 1) AS mapped")
    df = df.unionAll(df.where("doc_id = 12").selectExpr(*[f"`{c}`" for c in df.columns[:-3]], "5 AS `__loamspark_id`", "'x' AS `with.dot`", "map('a', 1) AS mapped"))
    want = {(7, one), (3, three + " z"), (4, two), (9, None), (9, ""), (None, one), (12, None)}
    seen = set()
    for order in (1, 2):
        got = m.keep_first(df.orderBy(F.rand(order)).repartition(order * 2), 80)
        assert got.dtypes == df.dtypes
        got = got.collect()
        assert len(got) == len(want) and {(r.doc_id, r.text) for r in got} == want
        seen.add(frozenset((r.doc_id, r.text, r["__loamspark_id"]) for r in got))
    assert len(seen) == 1


def test_one_id_with_several_texts_in_one_group(spark):
    texts = [" ".join(f"w{i}" for i in range(60)) + f" {x}" for x in "abc"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2]), (1, "other words that are in no other text at all"), (2, "x y z")], "doc_id long, text string")
    got = m.keep_first(docs, 80).collect()
    assert len(got) == 3 and {(r.doc_id, r.text) for r in got if r.text not in texts} == {(1, "other words that are in no other text at all"), (2, "x y z")}
    assert all(r.doc_id == 1 for r in got if r.text in texts)
    assert sorted((r.doc_id, r.component_id) for r in m.dedup(docs, 80).collect()) == [(1, 1), (1, 1), (1, 1), (2, 1), (2, 2)]
