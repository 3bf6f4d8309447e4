"""Classification of amplicon reads against references ``(species, marker, sequence)``: primers name the marker, a coarse sketch the
candidate species, full k-mer sets the hits.

Each index part is a table joined on the k-mer's hash, so reads are handled in parallel whatever their number. Species and markers are
integers; their order settles ties.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.functions import dna
from loamspark.functions.frames import sql
from loamspark.operators import kmers as km
from loamspark.session import saved


@dataclass(frozen=True)
class Index:
    """``coarse(species, hash)`` under the scale's limit, ``fine(species, marker, k, hash)`` and ``primers(marker, hash)``."""

    coarse: DataFrame
    fine: DataFrame
    primers: DataFrame
    scale: float
    coarse_k: int = 21
    primer_k: int = 15
    fine_ks: tuple[int, ...] = (21,)


def _keyed(rows: DataFrame, k: int, *keys: str, scale: float = 1.0, reads: DataFrame | None = None) -> DataFrame:
    """Distinct hashes of ``sequence`` beside its keys; with reads, only those that they have."""
    found = km.hashes(rows.select(F.struct(*keys).alias("id"), "sequence"), k, scale=scale)
    found = found if reads is None else km.met(found, km.hashes(reads, k, scale=scale))
    return found.select(*[F.col(f"id.{c}").alias(c) for c in keys], "hash").distinct()


def _sized(refs: DataFrame, k: int, primer_k: int) -> DataFrame:
    """References with their ``k``."""
    shortest = F.when(F.length("sequence") < k, F.greatest(F.length("sequence"), F.lit(primer_k))).otherwise(k)
    return refs.where("sequence IS NOT NULL").withColumn("k", shortest)


def fine_sizes(refs: DataFrame, k: int = 21, primer_k: int = 15) -> DataFrame:
    """``species, marker, n``: the rows of each in the fine index of these references, counted without hashing or making one."""
    sized = saved(_sized(refs, k, primer_k), "references")
    parts = [km.distinct_counts(sized.where(F.col("k") == r["k"]), r["k"], r["letters"], "species", "marker") for r in sized.groupBy("k").agg(F.sum(F.length("sequence")).alias("letters")).collect()]
    counts = reduce(DataFrame.unionAll, parts) if parts else sized.selectExpr("species", "marker", "0L AS n")
    return counts.groupBy("species", "marker").agg(F.sum("n").alias("n"))


def build(refs: DataFrame, primers: DataFrame, k: int = 21, primer_k: int = 15, scale: float | None = None, reads: DataFrame | None = None) -> Index:
    """The index of references and ``primers(marker, sequence)``; with ``reads(id, sequence)``, the part of it that these reads meet, which classifies them alike.

    A reference shorter than k gives k-mers of its own length, 15 at least. Without a scale, one that suits the shortest reference is taken.
    """
    sized = _sized(refs, k, primer_k)
    facts = sized.agg(F.min(F.length("sequence")).alias("shortest"), F.collect_set("k").alias("ks")).first()
    scale = scale or km.auto_scale(facts["shortest"] or 0, k)
    coarse = _keyed(sized, k, "species", scale=scale, reads=reads)
    ks = tuple(sorted(facts["ks"])) or (k,)
    fine = None
    for n in ks:
        part = _keyed(sized.where(F.col("k") == n), n, "species", "marker", reads=reads).select("species", "marker", F.lit(n).alias("k"), "hash")
        fine = part if fine is None else fine.unionAll(part)
    return Index(coarse, fine, _keyed(primers, primer_k, "marker"), scale, k, primer_k, ks)


def save(index: Index, path: str) -> None:
    """The index's tables and, beside them, its scale and sizes."""
    for name in ("coarse", "fine", "primers"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    facts = index.coarse.sparkSession.createDataFrame([(index.scale, index.coarse_k, index.primer_k, list(index.fine_ks))], "scale double, coarse_k int, primer_k int, fine_ks array<int>")
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/facts")


def load(spark: SparkSession, path: str) -> Index:
    f = spark.read.schema("scale double, coarse_k int, primer_k int, fine_ks array<int>").json(f"{path}/facts").first()
    return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("coarse", "fine", "primers")), f["scale"], f["coarse_k"], f["primer_k"], tuple(f["fine_ks"]))


def detect_marker(reads: DataFrame, index: Index, least: float = 0.1) -> DataFrame:
    """``id, marker, score`` of reads of whose k-mer positions at least this part is in a marker's primers; ties go to the lower marker."""
    return sql(
        """WITH n AS (SELECT id, count(*) AS n FROM {r} GROUP BY id), h AS (SELECT r.id, p.marker, count(*) AS c FROM {r} r JOIN {p} p ON p.hash = r.hash GROUP BY ALL),
                s AS (SELECT h.id, h.marker, h.c / n.n AS score, row_number() OVER (PARTITION BY h.id ORDER BY h.c DESC, h.marker) AS rn FROM h JOIN n ON n.id = h.id)
           SELECT id, marker, score FROM s WHERE rn = 1 AND score >= {least}""",
        r=km.hashes(reads, index.primer_k), p=index.primers, least=least,
    )


def candidates(reads: DataFrame, index: Index, least: float = 0.05) -> DataFrame:
    """``id, species`` that the read's sketch allows. Reads too short for a sketch of more than two hashes have no rows and allow all species."""
    return sql(
        """WITH l AS (SELECT id FROM {reads} WHERE cast((length(sequence) - {k} + 1) * {scale} AS INT) > 2),
                q AS (SELECT DISTINCT r.id, r.hash FROM {r} r JOIN l ON l.id = r.id WHERE r.hash < {limit}), n AS (SELECT id, count(*) AS n FROM q GROUP BY id),
                o AS (SELECT q.id, c.species, count(*) AS c FROM q JOIN {c} c ON c.hash = q.hash GROUP BY ALL)
           SELECT o.id, o.species FROM o JOIN n ON n.id = o.id WHERE o.c / n.n >= {least}""",
        reads=reads.select("id", "sequence"), r=km.hashes(reads, index.coarse_k), c=index.coarse, k=index.coarse_k, scale=index.scale, limit=dna.below(index.scale), least=least,
    )


def fine_scores(reads: DataFrame, index: Index) -> DataFrame:
    """``id, species, marker, containment``: the part of a read's k-mer positions found in each reference."""
    out = None
    for k in index.fine_ks:
        part = sql(
            """WITH n AS (SELECT id, count(*) AS n FROM {r} GROUP BY id), o AS (SELECT r.id, f.species, f.marker, count(*) AS c FROM {r} r JOIN {f} f ON f.hash = r.hash WHERE f.k = {k} GROUP BY ALL)
               SELECT o.id, o.species, o.marker, o.c / n.n AS containment FROM o JOIN n ON n.id = o.id""",
            r=km.hashes(reads, k), f=index.fine, k=k,
        )
        out = part if out is None else out.unionAll(part)
    return out.groupBy("id", "species", "marker").agg(F.max("containment").alias("containment")) if len(index.fine_ks) > 1 else out


def classify(reads: DataFrame, index: Index, least: float = 0.3, coarse: float = 0.05, one_marker: bool = True) -> DataFrame:
    """``id, marker, species, containment`` of every hit; a read's marker is the detected one.

    Without one, the first species in order with a hit fixes it by its best marker, and the others must fit that; if not
    ``one_marker``, each species keeps its own best. Thresholds for long noisy reads: 0.1 and 0.02.
    """
    scale, k = index.scale, index.coarse_k
    return sql(
        """WITH s AS (SELECT id, cast((length(sequence) - {k} + 1) * {scale} AS INT) <= 2 AS short FROM {reads}),
                f AS (SELECT f.*, d.marker AS known FROM {fine} f JOIN s ON s.id = f.id LEFT JOIN {cand} c ON c.id = f.id AND c.species = f.species LEFT JOIN {marker} d ON d.id = f.id
                      WHERE f.containment >= {least} AND (s.short OR c.species IS NOT NULL)),
                b AS (SELECT *, row_number() OVER (PARTITION BY id, species ORDER BY containment DESC, marker) AS best FROM f WHERE known IS NULL OR known = marker),
                m AS (SELECT *, first_value(marker) OVER (PARTITION BY id ORDER BY species, best) AS fixed FROM b)
           SELECT id, marker, species, containment FROM m WHERE CASE WHEN known IS NOT NULL OR {one} THEN marker = coalesce(known, fixed) ELSE best = 1 END""",
        reads=reads.select("id", "sequence"), fine=fine_scores(reads, index), cand=candidates(reads, index, coarse), marker=detect_marker(reads, index), k=k, scale=scale, least=least, one=one_marker,
    )


def summary(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """``kind, key, n``: all reads, classified reads, classified reads of each marker, and hits of each species."""
    return sql(
        """SELECT 'total' AS kind, cast(NULL AS BIGINT) AS key, count(*) AS n FROM {r}
           UNION ALL SELECT 'classified', NULL, count(DISTINCT id) FROM {h}
           UNION ALL SELECT 'marker', cast(marker AS BIGINT), count(DISTINCT id) FROM {h} GROUP BY marker
           UNION ALL SELECT 'species', cast(species AS BIGINT), count(*) FROM {h} GROUP BY species""",
        r=reads, h=hits,
    )
