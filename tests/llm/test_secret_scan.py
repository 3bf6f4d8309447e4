import base64
import hashlib
import math
import random
import re
import time
from collections import Counter

from loamspark.llm import queries
from loamspark.llm import secret_scan as s

BASE = {
    "assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def base(text):
    out = []
    for turn, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            if {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}[kind](m):
                out.append((m.start(), turn, m.end(), kind))
    return sorted(out)


def brute(text):
    """Every window's entropy counted anew."""
    found = base(text)
    spans = list(found)
    for turn, c in enumerate(s.CLASSES, 3):
        for m in re.finditer(f"{c.chars}{{{c.window},}}", text):
            if re.search(s.ALLOWED, m[0].lower()):
                continue
            hot = []
            for i in range(len(m[0]) - c.window + 1):
                w = m[0][i : i + c.window]
                h = -sum(n / c.window * math.log2(n / c.window) for n in Counter(w).values())
                if h >= c.bits - 1e-9 and not re.search(c.allowed, w):
                    hot.append(i)
            if hot:
                start = m.start() + hot[0]
                if not any(a <= start < b for a, _, b, _ in found):
                    spans.append((start, turn, m.start() + hot[-1] + c.window, c.kind))
    return found, sorted(spans)


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in df.transform(s.scan).select("doc_id", s.digest("base").alias("base"), s.digest("spans").alias("spans")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        found, spans = brute(text or "")
        assert (got[i].base, got[i].spans) == (written(found), written(spans)), (text or "")[:200]


def test_patterns(spark):
    h = "0123456789abcdef"
    check(
        spark,
        [
            None, "", "token", "no secret here", 'token = "abcdefgh', "TOKEN:abcdefg", "Api_Key='a.b-c_d=/+x", "apikey==abcdefghij", "api__key=abcdefghij", "passwd   :   12345678 password: 1234567",
            # A match that is too short still takes what the next one would need.
            "token=secret:abcdefghij", "token=secret=abcdefghij", "secret secret=aaaaaaaa;secret='bbbbbbbb'", "ſecret=abcdefghij toKen=abcdefghij", "é😀 token=😀abcdefgh token=abcdefgh😀",
            "AKIA", "AKIAABCDEFGHIJK", "AKIAABCDEFGHIJKL", "xAKIAAKIAAKIAAKIA1 AKIA-AKIA2222222222222", h + h, h + h[:-1], "g" + h * 3 + "G" + h * 2, "token=" + h * 2, h * 2 + "=AKIA" + "Z" * 12, "AKIA" + h.upper() + h,
        ],
    )


def test_windows_equal_counting_anew(spark):
    rng = random.Random(7)
    code = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    words = ["thequickbrownfoxjumpsoverthelazydog", "some-long-slug-of-words-in-a-web-address-2024", "A" * 60, "ab1" * 20, "1234567890" * 5, "0F" * 20, "abcdefgh" + code(30), "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY1"]
    texts = [*words, *(code(n) for n in (12, 17, 18, 30, 200, 500)), *(rng.randbytes(n).hex().upper() for n in (9, 10, 11, 40))]
    texts += [f"müll {code(24)} {rng.randbytes(12).hex()}, token={code(30)} x={code(25)}_{'a' * 300}{code(25)}" for _ in range(30)]
    texts += ["".join(rng.choice("aB3/") for _ in range(70)) + code(15) for _ in range(20)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 900))) for alphabet in ("0123456789abcdefABCDEF", "abcdefghijklmnop0123", "abcdefgh 01234567 +/_-=") for _ in range(15)]
    check(spark, texts)


def test_long_texts(spark):
    """Time grows about as the length: many matches, one very long candidate, names followed by blanks."""
    rng = random.Random(9)
    many = " ".join(f"token={rng.randbytes(8).hex()}" for _ in range(20_000))
    one = base64.b64encode(rng.randbytes(60_000)).decode().replace("+", "/")
    t = time.time()
    check(spark, [many, one, "token" + " " * 200_000 + "x", "word " * 100_000])
    print(time.time() - t)
    assert time.time() - t < 120


def test_rows_and_clashes(spark):
    rows = [(1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, None), (None, "token=abcdefgh")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS assign", "2 AS found", "3 AS base", "4 AS spans", "5 AS matches", "6 AS hex", "7 AS starts", "8 AS reach", "9 AS entropy_hex")
    got = sorted((r.doc_id or 0, len(r.spans)) for r in s.scan(df).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert s.scan(df.limit(0)).collect() == []


def test_plan_is_native(spark, small):
    plan = queries.op12_secret_scan(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_query_equals_brute_force(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op12_secret_scan(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        found, spans = brute(docs[r.doc_id])
        assert (r.base_sha256, r.spans) == (hashlib.sha256(written(found).encode()).hexdigest(), written(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[3] for x in found) for k in BASE)
