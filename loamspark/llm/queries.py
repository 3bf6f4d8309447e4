"""The thin queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, hard_negatives, hilbert_ann, minhash_dedup, packing, quality_knn, secret_scan, sharding, token_files, toxicity, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % divisor


def learnable(divisor: int, held_out: int) -> Column:
    """Rows whose labels may be learnt from."""
    return _remainder(divisor) != held_out


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return hilbert_ann.search(table, table.where("vec_id % 100 = 0"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(learnable(3, 1))))
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_files.read_tokens(token_files.write_tokens(_table(spark, sf_dir, "documents")))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(_table(spark, sf_dir, "embeddings"))


def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality_knn.score(docs, quality_knn.fit(docs, labels.where(learnable(5, 0))))
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(table, F.col("vec_id") % 100 == 0)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secret_scan.BASE), F.sha2(secret_scan.digest(F.col("base")), 256).alias("base_sha256"), secret_scan.digest(F.col("spans")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hilbert_ann, op2_toxicity, op3_sharding, op4_byte_bpe, op5_minhash_dedup, op6_token_files, op7_embedding_dedup, op8_quality_knn, op9_packing, op10_url_filter, op11_hard_negatives, op12_secret_scan, op13_vector_codes)}

OP10_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END AS raw_host,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
hosts AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
fits AS (
  SELECT *, host = 'net' OR ends_with(host, '.net') AS net, host = 'example.net' OR ends_with(host, '.example.net') AS example_net,
         host = 'example.com' OR ends_with(host, '.example.com') AS example_com, host = 'org' OR ends_with(host, '.org') AS org FROM hosts),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN example_net AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN net AND starts_with(path, '/') THEN 'net/'
              WHEN example_com AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN org AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule
  FROM fits)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

OP11_SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER best AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 10
"""


def _op12_sql() -> str:
    """Matches by cutting the texts at them, and every window's characters counted anew."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    steps = ["t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    # Short runs of hexadecimal digits are no matches and take nothing from others.
    kinds = [(k, "[0-9a-f]{32,}" if k == "hex" else p) for k, p in secret_scan.BASE.items()] + [(c.kind, c.pattern) for c in secret_scan.CLASSES]
    for kind, pattern in kinds:
        steps.append(f"""cut_{kind} AS MATERIALIZED (SELECT r, i, m[i] AS match, sum(length(p[i]) + CASE WHEN i > 1 THEN length(m[i - 1]) ELSE 0 END) OVER (PARTITION BY r ORDER BY i)::BIGINT AS start
            FROM (SELECT r, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, {quoted(pattern)}) AS m, string_split_regex(text, {quoted(pattern)}) AS p FROM t)))""")
    found = []
    for turn, kind in enumerate(secret_scan.BASE):
        size = f"length(regexp_extract(match, {quoted(secret_scan.BASE[kind])}, 2))" if kind == "assign" else "length(match)"
        found.append(f"SELECT r, start, {turn} AS turn, start + length(match) AS stop, '{kind}' AS kind FROM cut_{kind} WHERE {size} >= {secret_scan.LEAST[kind]}")
    steps.append(f"base AS MATERIALIZED ({' UNION ALL '.join(found)})")
    added = []
    for turn, c in enumerate(secret_scan.CLASSES, len(secret_scan.BASE)):
        steps.append(f"""hot_{c.kind} AS (SELECT r, i, w, start FROM (
            SELECT r, i, start, w, window_text, unnest(string_split(window_text, '')) AS ch FROM (
              SELECT r, i, start, w, substr(match, w + 1, {c.window}) AS window_text FROM (
                SELECT *, unnest(range(0, length(match) - {c.window} + 1)) AS w FROM cut_{c.kind} WHERE NOT regexp_matches(lower(match), {quoted(secret_scan.ALLOWED)}))))
            WHERE NOT regexp_matches(window_text, {quoted(c.allowed)}) GROUP BY r, i, w, start, ch)""".replace("SELECT r, i, w, start FROM", f"SELECT r, i, w, start, {c.costs}[count(*) + 1] AS cost FROM", 1))
        steps.append(f"warm_{c.kind} AS (SELECT r, i, start, w FROM hot_{c.kind} GROUP BY ALL HAVING sum(cost) <= {c.most})")
        added.append(f"SELECT r, start + min(w) AS start, {turn} AS turn, start + max(w) + {c.window} AS stop, '{c.kind}' AS kind FROM warm_{c.kind} GROUP BY r, i, start")
    steps.append(f"""spans AS (SELECT * FROM base UNION ALL SELECT * FROM ({' UNION ALL '.join(added)}) a
        WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.start <= a.start AND a.start < b.stop))""")
    text = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, turn), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secret_scan.BASE)
    return f"""WITH {", ".join(steps)},
        b AS (SELECT r, {counts}, {text} AS base FROM base GROUP BY r), s AS (SELECT r, {text} AS spans FROM spans GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN b ON b.r = t.r LEFT JOIN s ON s.r = t.r"""


def _op13_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment by brute force and of floors of means, written out one after the other."""
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""pieces AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) r(p))""",
        f"""b0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM pieces) WHERE e < {entries})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, label, p, v, min(row(d, e)) AS best FROM (
            SELECT t.vec_id, t.label, t.p, t.v, b.e, list_sum(list_transform(list_zip(t.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pieces t JOIN b{i} b ON b.p = t.p) GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT p, e, list(m ORDER BY pos) AS v FROM (
                SELECT p, best[2] AS e, pos, floor(sum(v[pos]) / count(*))::BIGINT AS m FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS pos FROM a{i}) GROUP BY p, best[2], pos) GROUP BY p, e)""")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e)")
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM coded"""


ORACLE_SQL: dict[str, str] = {"op10_url_filter": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_secret_scan": _op12_sql(), "op13_vector_codes": _op13_sql()}
