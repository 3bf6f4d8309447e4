import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from loamspark.llm import byte_bpe, packing, piecewise, queries, token_files

ODD = [
    None, "", " ", "\n", "  a  b\n\n c\t d ", "a\u00a0b c\u3000d e", "é è\nñ ü  ß\n", "<|endoftext|> x<|startoftext|>", "it's we'll 'S 's\n't", "\u2028 a \u2028b", "a b" * 50,
    "x" * 3000, "0 1\n22 333\r\n4444 \r\n5", "¿Qué? «sí» — no… \U0001f600 \U0001f600\n\u0301a \u0301", "ÀÉ ÊÈ Σας ΣΑΣ İ", "trailing ", " leading", "\x1c a\x1cb \x85c",
    "a'Σ b.Σ ΑΣ' x1y22z", "it's,we'll.'S it'S", "a\0b \0 c\n\0\nd", "…a— “b”… é", "a.\n.b $$$ c%%%", "e\u0301 E\u0301. \u0130x",
]


def texts(small, n=60):
    import pyarrow.parquet as pq

    return pq.read_table(f"{small}/documents.parquet", columns=["text"])["text"].to_pylist()[:n]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(small, name):
    rng = random.Random(3)
    noise = ["".join(rng.choice(" \n\t a'sé.1ñ\u00a0\u3000B-") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    all_ = [*ODD, *texts(small), *noise]
    plain = Tokenizer.from_file(P.path(name))
    plain.encode_special_tokens = True
    want = [e.ids for e in plain.encode_batch([t or "" for t in all_], add_special_tokens=False)]
    for kept in (10, 100_000):
        coder = piecewise.Pieces(P.path(name), kept)
        for _ in range(2):
            ids, ends = coder.encode(pa.array(all_))
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


def test_tiktoken_parts_are_whole(small, monkeypatch):
    enc = byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for size in (1, 7, 1000):
        for t in [x or "" for x in ODD] + texts(small, 20):
            parts = list(byte_bpe.safe_parts(t, size))
            assert "".join(parts) == t
            assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def test_byte_bpe_query(spark, small, tmp_path):
    odd = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "a", 2), (3, "a", 2), (3, "a", 2)], "doc_id long, text string, ids int")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), small):
        enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)._mergeable_ranks, special_tokens={})
        want = []
        for r in spark.read.parquet(f"{d}/documents.parquet").collect():
            ids = enc.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        key = lambda x: (x[0] is None, x)
        assert sorted(map(tuple, queries.op4_byte_bpe(spark, d).collect()), key=key) == sorted(want, key=key)


def test_images_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (1, 2, 300, 50_000, 2**32):
            v = rng.integers(0, top, n).astype(np.uint32)
            v[rng.random(n) < 0.03] = 2**32 - 1
            image = token_files.pack(v)
            assert (token_files.unpack(image) == v).all()
            assert (token_files.unpack(image, 1, 3) == v[256:768]).all()
    small = token_files.pack(rng.integers(1000, 1016, 2560).astype(np.uint32))
    assert len(small) < 2560 * 5 / 8 + 300
    with pytest.raises(ValueError):
        token_files.unpack(b"nope" * 8)


def test_token_files(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a", "x"), (3, "a b", "x"), (3, "a b", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    for d in (small, str(tmp_path)):
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
        got = sorted(map(tuple, queries.op6_token_files(spark, d).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == sorted((r.doc_id for r in docs), key=lambda x: -1 if x is None else x)
        at, want = 0, set()
        for i, start, n, _ in got:
            assert start == at
            at += n
        for r in docs:
            ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
            want.add((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert {(i, n, c) for i, _, n, c in got} == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_tokens(token_files.write_tokens(empty)).count() == 0


def test_cut_and_bins():
    for n in [*range(0, 2100), 5000, 123_457]:
        pieces = packing.cut(n)
        assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces) and len(pieces) <= n // 2048 + 6
    rng = random.Random(1)
    bins, out, total = packing.Harmonic(), [], 0
    for i in range(3000):
        n = rng.randint(1, 3000)
        total += n
        out += bins.add(i, np.arange(n))
    pending = [ids for pieces in bins.open.values() for _, _, ids in pieces]
    assert all(ids.base is None for ids in pending) and sum(map(len, pending)) <= 2048 * len(bins.open)
    full = len(out)
    out += bins.finish()
    for _, at, ids in (piece for q in out for piece in q):
        assert ids[0] == at and ids[-1] == at + len(ids) - 1
    sizes = [sum(len(ids) for _, _, ids in q) for q in out]
    assert all(2048 - 45 <= s <= 2048 for s in sizes[:full])
    assert sum(sizes) == total and all(s == 2048 or s & (s - 1) == 0 for s in sizes[full:])
    assert not list(bins.finish())


def test_packing_query(spark, small, tmp_path):
    rows = [(i, t, 5) for i, t in enumerate(ODD)] + [(None, "a", 5), (3, "b c", 5), (3, "b c", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    for d in (small, str(tmp_path)):
        want = {}
        for r in spark.read.parquet(f"{d}/documents.parquet").collect():
            want.setdefault(r.doc_id, []).append([*plain.encode(r.text or "", add_special_tokens=False).ids, 1])
        got = queries.op9_packing(spark, d).collect()
        by_doc, by_seq = {}, {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_seq.setdefault(r.sequence_id, []).append(r)
        assert set(by_doc) == set(want)
        for k, all_ in want.items():
            if len(all_) == 1:
                at = 0
                for r in sorted(by_doc[k], key=lambda r: r.start):
                    assert r.start == at and r.doc_tokens == len(all_[0])
                    assert r.ids_crc32 == zlib.crc32(np.array(all_[0][at : at + r.length], "<u4").tobytes())
                    at += r.length
                assert at == len(all_[0])
            else:
                assert sum(r.length for r in by_doc[k]) == sum(map(len, all_))
        padding = total = 0
        for q in by_seq.values():
            at = 0
            for r in sorted(q, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048
            total += at
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding <= 0.02 * total
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
