import random

import numpy as np
import pyarrow as pa

from loamspark.llm import quality_knn, queries, toxicity


def brute(scores):
    """Maximal scoring segments by their definition, of whole sequences."""
    out = []

    def cut(a, b):
        best, at = 0, None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(scores[i:j])
                if s > best + 1e-12:
                    best, at = s, (i, j)
        if at:
            cut(a, at[0])
            out.append((at[0], at[1] - 1, round(best, 6)))
            cut(at[1], b)

    cut(0, len(scores))
    return out


def test_segments_are_all_maximal_ones():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-1.5, -1, -0.25, 0.75, 2.0, 3.125]) + rng.random() / 9 for _ in range(rng.randint(0, 14))]
        total = np.append(0.0, np.cumsum(scores))
        p = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.segments(p, total[p].tolist(), total[[i + 1 for i in p]].tolist())
        assert abs(sum(s for *_, s in got) - sum(s for *_, s in brute(scores))) < 1e-4
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(scores)]


ODD = [None, "", " \n", "!", "idiot", "x" * 100_000, "word " * 60_000, "é" * 10, " ", "scum scum scum"]


def corpus(spark):
    rng = random.Random(0)
    good = ["the", "river", "runs", "over", "green", "hills", "and", "small", "houses"]
    bad = ["idiot", "scum", "moronic", "morons"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        w = [rng.choice(bad) if toxic and rng.random() < 0.15 else rng.choice(good) for _ in range(60)]
        poor = i % 7 == 0
        rows.append((i, ("!! ".join(x.upper() for x in w) if poor else " ".join(w)), "a"))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000 + i, t, "a") for i, t in enumerate(ODD)] + [(None, "you idiot", "a"), (2000, "same", "a"), (2000, "same", "a")]
    labels += [(None, 1, 1), (5, None, None), (7777, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_fixture(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0 or doc_id is null"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    scores = {r.doc_id: r.score for r in got}
    held = [i for i in range(300) if i % 2]
    assert all((scores[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert all(0 <= s <= 1 for s in scores.values())
    assert all(scores[1000 + i] < 0.7 for i in (0, 1, 2, 3, 5, 6, 7, 8))
    text = {r.doc_id: r.text for r in docs.collect()}
    spans = [text[r.doc_id].encode()[s.start : s.end].decode() for r in got if r.doc_id in (5, 15) for s in r.spans]
    assert spans and all("idiot" in s.lower() or "scum" in s.lower() or "moron" in s.lower() for s in spans)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(str(r.doc_id) for r in got if r.score < 0.7)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {none_score(none)}


def none_score(model):
    return 1 / (1 + np.exp(-model.weights[0]))


def test_quality_on_fixture(spark):
    docs, labels = corpus(spark)
    model = quality_knn.fit(docs, labels.where("doc_id % 2 = 0 or doc_id is null"))
    got = {r.doc_id: r.score for r in quality_knn.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 7 != 0) for i in range(300) if i % 2)
    assert all(0 <= s <= 1 for s in got.values())
    kept = quality_knn.keep_good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_knn.score(docs.limit(0), model).count() == 0
    assert {r.score for r in quality_knn.score(docs, quality_knn.fit(docs, labels.limit(0))).collect()} == {1.0}


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(0)
    size = quality_knn.TRIGRAMS + quality_knn.SHAPES
    x = rng.random((40, size)).astype(np.float32)
    axes = rng.standard_normal((size, 8)).astype(np.float32)
    refs = rng.standard_normal((100, 8)).astype(np.float32)
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)
    model = quality_knn.Model(np.ones(size, np.float32), axes, refs, (rng.random(100) < 0.5).astype(np.float32))
    z = quality_knn._normal(x) @ axes
    cos = (z / np.linalg.norm(z, axis=1, keepdims=True)) @ refs.T
    for row, s in zip(cos, quality_knn.vote(x, model)):
        near = np.argsort(-row)[: quality_knn.NEIGHBOURS]
        w = np.maximum(row[near].astype(float), 1e-3) ** quality_knn.SHARPNESS
        assert abs(s - (w * model.labels[near]).sum() / w.sum()) < 1e-4


def test_ties_in_the_last_place_all_vote():
    """Copies past the last place and the zero vector: the votes depend on no order of the labelled rows."""
    size = quality_knn.TRIGRAMS + quality_knn.SHAPES
    axes = np.zeros((size, 2), np.float32)
    axes[0, 0] = axes[1, 1] = 1
    refs = np.array([[1, 0]] * 40 + [[0, 1]] * 10, np.float32)
    labels = np.array([1] * 10 + [0] * 30 + [1] * 10, np.float32)
    x = np.zeros((2, size), np.float32)
    x[0, 0] = 1
    for order in (np.arange(50), np.arange(50)[::-1]):
        got = quality_knn.vote(x, quality_knn.Model(np.ones(size, np.float32), axes, refs[order], labels[order]))
        assert np.allclose(got, [0.25, 0.4])
    some = np.array([[0.9, 0.1, 0]], np.float32)
    model = quality_knn.Model(np.ones(size, np.float32), axes, refs[5:], labels[5:])
    x[1, :2] = some[0, :2]
    assert abs(quality_knn.vote(x, model)[1] - 5 / 35) < 1e-6


def test_terms_do_not_cross_rows():
    texts = ["abc abc", "", None, "XYZ!\nq", "ab"]
    together = quality_knn.terms(pa.RecordBatch.from_pydict({"text": pa.array(texts)}))
    for i, t in enumerate(texts):
        alone = quality_knn.terms(pa.RecordBatch.from_pydict({"text": pa.array([t, "zzzz"])}))
        assert np.allclose(together[i], alone[0])


def test_held_out_accuracy(spark, small):
    small = small.replace("0.001", "0.1")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for query, label, floor in ((queries.op2_toxicity, "toxic", 0.95), (queries.op8_quality_knn, "quality", 0.97)):
        rows = query(spark, small).collect()
        held = [(r.predicted, labels[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in labels]
        assert np.mean([a == b for a, b in held]) >= floor
        assert all(0 <= r.score <= 1 for r in rows)
