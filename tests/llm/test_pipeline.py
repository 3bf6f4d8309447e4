import zlib

import corpus_pipeline as c
import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from loamspark.llm import packing, quality_knn, toxicity
from loamspark.llm.queries import learnable

from test_minhash import brute


def test_stages_against_brute_force(spark, small):
    sf = small.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = [c.drop_toxic(spark, docs, sf)]
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where(learnable(3, 1)))).collect()}
    left = {i for i in text if scores[i] < 0.7}
    assert {r.doc_id for r in kept[0].collect()} == left and len(left) < len(text)
    docs = spark.createDataFrame(kept[0].collect(), docs.schema)
    good = c.drop_poor(spark, docs, sf)
    votes = {r.doc_id: r.score for r in quality_knn.score(docs, quality_knn.fit(docs, labels.where(learnable(5, 0)))).collect()}
    left = {i for i in left if votes[i] >= 0.3}
    assert {r.doc_id for r in good.collect()} == left
    docs = spark.createDataFrame(good.collect(), docs.schema)
    single = c.drop_near_duplicates(spark, docs, sf)
    assert single.columns == docs.columns
    left = {i for i, (_, root) in brute([(i, text[i]) for i in left], 80).items() if i == root}
    assert {r.doc_id for r in single.collect()} == left
    docs = spark.createDataFrame(single.collect(), docs.schema)
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {}
    for r in c.pack(spark, docs, sf).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {i: b"".join(b for _, b in sorted(p)) for i, p in got.items()} == {i: np.array([*plain.encode(text[i], add_special_tokens=False).ids, 1], "<u4").tobytes() for i in left}
    assert c.run(spark, sf).where("length > 0").select("doc_id").distinct().count() == len(left)


def test_odd_rows(spark, small, tmp_path):
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None, "a"), (2, "", "b"), (None, "x y z w v u", "c"), (3, "x y z w v u", "d"), (3, "x y z w v u", "d"), (4, "X y z w v u", None), (5, "other words " * 20_000, "e")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, `__loamspark_id` string").selectExpr("*", "1 AS label", "2 AS half", "3 AS key", "4 AS score", "5 AS ids", "6 AS id", "7 AS t", "8 AS `row`")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = odd
    for name, stage in c.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.dtypes == odd.dtypes
            docs = spark.createDataFrame(out.collect(), odd.schema)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3", "5", "None"]
    empty = odd.limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert packing.pack(docs).count() >= 5
