"""Sketches, inverted indexes and read classification over k-mers.

Sequences are ``(id, sequence)``; k-mer tables are ``(id, pos, hash)``. Indexes are plain tables, joined on the hash, so a large one is shuffled and a
small one broadcast by Spark's own choice.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.functions import dna
from loamspark.functions.frames import sql
from loamspark.session import saved
from loamspark.sources.fastq_files import read_fastq

#: K-mers of a piece that a sequence is cut into. Rows of a batch of k-mers, at most, and k-mers hashed at once.
PIECE = 256
ROWS = 65536
CACHED = 16384
#: K-mers that a task sorts at once, and those of a bucket of ``distinct_counts``, about, at most.
SORTED = 1 << 22


def spread(sequences: DataFrame) -> DataFrame:
    """Fewer partitions than cores are dealt anew: k-mers cost far more than moving their sequences. Larger inputs and streams stay as they are."""
    if sequences.isStreaming:
        return sequences
    cores = sequences.sparkSession.sparkContext.defaultParallelism
    return sequences.repartition(cores) if sequences.rdd.getNumPartitions() < cores else sequences


def windows(sequences: DataFrame, k: int, bases: str = "ACGT") -> DataFrame:
    """``id, pos, kmer, back`` of every valid k-mer, back its reverse complement."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    # Sequences are cut into overlapping pieces first: a substring walks from its string's start, and every k-mer row carries the
    # string that it is cut from, so both would grow with the square of a long sequence. A piece is complemented and checked as a whole.
    rows = spread(sequences.select("id", "sequence")).select("id", F.upper("sequence").alias("s"))
    cut = rows.select("id", "s", F.explode(F.when(F.length("s") >= k, F.sequence(F.lit(0), F.length("s") - k, F.lit(PIECE)))).alias("at"))
    pieces = cut.select("id", "at", F.substring(F.col("s"), F.col("at") + 1, F.lit(PIECE + k - 1)).alias("piece"))
    ready = pieces.select("id", "at", "piece", dna.revcomp(F.col("piece")).alias("back"), dna.valid(F.col("piece"), bases).alias("clean"), (F.length("piece") - k).alias("last"))
    at = ready.select("id", "at", "piece", "back", "clean", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    kmer = F.substring(F.col("piece"), F.col("i") + 1, F.lit(k))
    back = F.substring(F.col("back"), F.col("last") - F.col("i") + 1, F.lit(k))
    return at.where(F.col("clean") | dna.valid(kmer, bases)).select("id", (F.col("at") + F.col("i")).alias("pos"), kmer.alias("kmer"), back.alias("back"))


def hashes(sequences: DataFrame, k: int, bases: str = "ACGT", scale: float = 1.0) -> DataFrame:
    """``id, pos, hash`` of every valid canonical k-mer; with a scale, only of those whose hash is under its limit, so that a sketch's other k-mers never leave their task.

    K-mers of A, C, G and T up to k = 31 are hashed in Arrow batches, many at once; others by Spark's own functions.
    """
    limit = dna.below(scale)
    if k < 1:
        raise ValueError("k must be 1 or more")
    if bases != "ACGT" or k > 31:
        rows = windows(sequences, k, bases).select("id", "pos", dna.hash_hex(F.least("kmer", "back")).alias("hash"))
        return rows if scale == 1 else rows.where(F.col("hash") < limit)
    under = np.uint64(min(int(limit, 16), 2**64 - 1))

    def found(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, codes = dna.canonical_codes(raw, k)
        numbers = dna.md5_numbers(codes, k)
        kept = np.flatnonzero(numbers < under) if scale != 1 else slice(None)
        return at[kept], numbers[kept]

    def digits(numbers: np.ndarray) -> pa.Array:
        ends = np.arange(0, 16 * len(numbers) + 1, 16, dtype=np.int32)
        return pa.StringArray.from_buffers(len(numbers), pa.py_buffer(ends), pa.py_buffer(dna.hex_digits(numbers)))

    return _at_places(sequences, k, found, digits, "hash string")


def _at_places(sequences: DataFrame, n: int, found: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], column: Callable[[np.ndarray], pa.Array], field: str) -> DataFrame:
    """``id, pos`` and a column of what ``found`` tells of the windows of n letters, given upper-case texts in ASCII: their places and a number for each.

    Sequences are put together, apart by a byte that ASCII does not have, and given in parts that stay in the processor's cache, whatever the length of one.
    """
    kind, name = sequences.schema["id"].dataType.simpleString(), field.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, texts, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append((text.as_py() or "").encode("ascii", "replace"))  # a letter beyond ASCII is one place and no base
                size += len(texts[-1])
                if size >= ROWS or i + 1 == batch.num_rows:
                    yield from together(batch.column(0), first, texts)
                    first, texts, size = i + 1, [], 0

    def together(ids: pa.Array, first: int, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(b"\xff".join(texts), np.uint8)
        starts, last = np.cumsum([0, *[len(t) + 1 for t in texts]]), len(raw) - n + 1
        for begin in range(0, last, ROWS):
            end = min(begin + ROWS, last)
            parts = [(at, *found(raw[at : min(at + CACHED, end) + n - 1])) for at in range(begin, end, CACHED)]
            place, number = np.concatenate([at + x for at, x, _ in parts]), np.concatenate([y for _, _, y in parts])
            if len(place):
                row = np.searchsorted(starts, place, side="right") - 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + row)), pa.array((place - starts[row]).astype(np.int32)), column(number)], ["id", "pos", name])

    return spread(sequences.select("id", "sequence")).select("id", F.upper("sequence").alias("sequence")).mapInArrow(run, f"id {kind}, pos int, {field}")


def mixed_hashes(sequences: DataFrame, k: int) -> DataFrame:
    """``id, pos, hash`` of every k-mer of A, C, G and T, k at most 32: the smaller, as unsigned numbers, of the mixed two-bit codes of both strands.

    Hashes are the 64 bits as a signed long. All is generated code: each step is a projection of its own, since the next one uses it several times.
    """
    if not 1 <= k <= 32:
        raise ValueError("k must be from 1 to 32")
    rows = windows(sequences, k).select("id", "pos", dna.code("kmer").alias("a"), dna.code("back").alias("b"))
    for step in dna.MIX:
        rows = rows.select("id", "pos", *[F.expr(step(c)).alias(c) for c in ("a", "b")])
    sign = "shiftleft(1L, 63)"
    return rows.select("id", "pos", F.expr(f"CASE WHEN (a ^ {sign}) < (b ^ {sign}) THEN a ELSE b END").alias("hash"))


def sketch(table: DataFrame, scale: float) -> DataFrame:
    """Distinct hashes under the scale's limit."""
    return table.where(F.col("hash") < dna.below(scale)).select("id", "hash").distinct()


#: Distinct hashes that are broadcast at most.
BROADCAST = 500_000


def met(table: DataFrame, reads: DataFrame) -> DataFrame:
    """The rows of a k-mer table whose hash some read has, the only ones that a search of these reads meets: of a large table the others never leave their task.

    The reads' hashes are counted before they are broadcast; more than ``BROADCAST`` are joined as Spark chooses.
    """
    wanted = saved(reads.select("hash").distinct(), "wanted")
    return table.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, "hash", "left_semi").select(table.columns)


def containment(a: DataFrame, b: DataFrame, distinct: bool = True, jaccard: bool = True) -> DataFrame:
    """``a, b, shared, containment, jaccard`` of all pairs that share a hash; over positions of a instead of distinct hashes if not ``distinct``.

    Without ``jaccard``, b's own hashes are not counted, so those that a does not have are left out before they are shuffled.
    """
    x = a.select("id", "hash").distinct() if distinct else a.select("id", "hash")
    if not jaccard:
        x = saved(x, "hashes")
        return sql(
            """WITH n AS (SELECT id, count(*) AS n FROM {x} GROUP BY id), o AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM {x} x JOIN {y} y ON y.hash = x.hash GROUP BY ALL)
               SELECT o.a, o.b, o.shared, o.shared / n.n AS containment FROM o JOIN n ON n.id = o.a""",
            x=x, y=met(b, x).select("id", "hash").distinct(),
        )
    return sql(
        """WITH n AS (SELECT id, count(*) AS n FROM {x} GROUP BY id), m AS (SELECT id, count(*) AS m FROM {y} GROUP BY id),
                o AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM {x} x JOIN {y} y ON y.hash = x.hash GROUP BY ALL)
           SELECT o.a, o.b, o.shared, o.shared / n.n AS containment, o.shared / (n.n + m.m - o.shared) AS jaccard FROM o JOIN n ON n.id = o.a JOIN m ON m.id = o.b""",
        x=x, y=b.select("id", "hash").distinct(),
    )


def distinct_counts(sequences: DataFrame, k: int, letters: int, *keys: str) -> DataFrame:
    """``keys..., n``: the distinct canonical k-mers of A, C, G and T of the sequences of each key; k at most 31, ``letters`` about all of the sequences'.

    A k-mer is its code of two bits a base, multiplied by an odd number within those bits, which no two share, so its first bits spread codes over buckets. A
    task sorts many at once and sends those of a key and bucket as one row, without the first bits; a bucket's are sorted again. No k-mer is a row of its own.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be from 1 to 31")
    bits = min(2 * k, max(6, math.ceil(math.log2(max(letters, 1) / SORTED))))
    low, width = 2 * k - bits, max(1, -(-(2 * k - bits) // 8))
    kinds = ", ".join(f"{c} {sequences.schema[c].dataType.simpleString()}" for c in keys)

    def rows(held: dict[tuple, list[np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for key, parts in held.items():
            codes = np.concatenate(parts).astype("<u8")
            codes *= np.uint64(0x9E3779B97F4A7C15)
            codes &= np.uint64((1 << 2 * k) - 1)
            codes.sort()
            codes = codes[np.r_[True, codes[1:] != codes[:-1]]]
            buckets = (codes >> np.uint64(low)).astype(np.int32)
            starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            codes &= np.uint64((1 << low) - 1)
            ends = (np.r_[starts, len(codes)] * width).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(codes.view(np.uint8).reshape(-1, 8)[:, :width].tobytes())])
            own = [pa.array([x], schema.field(c).type).take(pa.array(np.zeros(len(starts), np.int32))) for c, x in zip(keys, key, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(buckets[starts]), packed], [*keys, "bucket", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, schema = {}, 0, None
        for batch in batches:
            texts, schema = {}, batch.schema
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*keys, "sequence")), strict=True):
                texts.setdefault(tuple(key), []).append((text or "").encode("ascii", "replace"))
            for key, own in texts.items():
                raw = np.frombuffer(b"\xff".join(own), np.uint8)
                for at in range(0, len(raw) - k + 1, CACHED):
                    codes = dna.canonical_codes(raw[at : at + CACHED + k - 1], k)[1]
                    if len(codes):
                        held.setdefault(key, []).append(codes)
                        size += len(codes)
                    if size >= SORTED:
                        yield from rows(held, schema)
                        held, size = {}, 0
        yield from rows(held, schema)

    def counted(bucket: pa.Table) -> pa.Table:
        own: dict[tuple, list[bytes]] = {}
        for *key, packed in zip(*(bucket[c].to_pylist() for c in (*keys, "codes")), strict=True):
            own.setdefault(tuple(key), []).append(packed)
        n = []
        for parts in own.values():
            raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
            codes = np.zeros((len(raw), 8), np.uint8)
            codes[:, :width] = raw
            codes = np.sort(codes.view("<u8").ravel())
            n.append(1 + int(np.count_nonzero(codes[1:] != codes[:-1])))
        return pa.table([*(pa.array([key[i] for key in own], bucket.schema.field(c).type) for i, c in enumerate(keys)), pa.array(n, pa.int64())], [*keys, "n"])

    packed = spread(sequences.select(*keys, "sequence")).select(*keys, F.upper("sequence").alias("sequence")).mapInArrow(run, f"{kinds}, bucket int, codes binary")
    return packed.groupBy("bucket").applyInArrow(counted, f"{kinds}, n long").groupBy(*keys).agg(F.sum("n").alias("n"))


def merge(sketches: DataFrame) -> DataFrame:
    return sketches.select("hash").distinct()


def same(a: DataFrame, b: DataFrame) -> bool:
    x, y = a.select("hash").distinct(), b.select("hash").distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def coarse_index(strains: DataFrame, table: DataFrame, scale: float) -> DataFrame:
    """``species, hash``: the merged sketch of every species, given ``(id, species)``."""
    return sketch(table, scale).join(strains, "id").select("species", "hash").distinct()


def coarse_query(reads: DataFrame, index: DataFrame, scale: float, top: int = 3, least: float = 0.0) -> DataFrame:
    """The ``top`` species of each read by containment of its sketch; reads whose sketch is empty use all their hashes."""
    return sql(
        """WITH h AS (SELECT DISTINCT id, hash FROM {r}),
                f AS (SELECT id, hash, count(*) OVER (PARTITION BY id) AS n, count_if(hash < {limit}) OVER (PARTITION BY id) AS sketched FROM h),
                u AS (SELECT id, hash, CASE WHEN sketched = 0 THEN n ELSE sketched END AS n FROM f WHERE hash < {limit} OR sketched = 0),
                s AS (SELECT u.id, i.species, count(*) / u.n AS containment FROM u JOIN {i} i ON i.hash = u.hash GROUP BY u.id, i.species, u.n)
           SELECT id, species, containment, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY containment DESC, species) AS rn FROM s WHERE containment >= {least}) WHERE rn <= {top}""",
        r=reads, i=index, limit=dna.below(scale), top=top, least=least,
    )


def genes_at(table: DataFrame, genes: DataFrame, bin_size: int = 1000, order: str = "start") -> DataFrame:
    """Every k-mer with the first gene, by start or by another column of the annotation (its line, say), whose [start, end) holds its position; null without one.

    A bin of a sequence has one row with the genes that overlap it, in order, so a k-mer meets one row at most and is neither sorted nor counted.
    """
    return sql(
        """WITH g AS (SELECT id, struct({o} AS nth, start, gene, `end`) AS gene, explode(sequence(cast(floor(start / {w}) AS INT), cast(floor((`end` - 1) / {w}) AS INT))) AS bin FROM {g} WHERE `end` > start),
                b AS (SELECT id, bin, sort_array(collect_list(gene)) AS genes FROM g GROUP BY id, bin)
           SELECT t.id, t.pos, t.hash, get(filter(b.genes, x -> x.start <= t.pos AND t.pos < x.`end`), 0).gene AS gene
           FROM {t} t LEFT JOIN b ON b.id = t.id AND b.bin = cast(floor(t.pos / {w}) AS INT)""",
        t=table, g=genes, w=bin_size, o=F.col(order),
    )


def fine_query(reads: DataFrame, index: DataFrame, least: float = 0.1, best: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Strains of each read by the part of its distinct hashes that they hold, and the gene with most votes.

    Every index row is a vote; without a gene wins only if no gene has as many. With ``best(id, species)``, a read meets only index rows of its species.
    The index is joined once: a read's hash in a strain counts as one hit, whatever its votes. With ``folder``,
    the hashes to look up are written there first, so that their size is known where Spark chooses between a broadcast and a shuffle of the index.
    """
    pruned = best is not None
    q = sql(
        f"""WITH h AS (SELECT id, hash, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT id, hash FROM {{r}}))
            SELECT h.* {", b.species FROM h JOIN {b} b ON b.id = h.id" if pruned else "FROM h"}""",
        r=reads, **({"b": best} if pruned else {}),
    )
    if folder:
        path = f"{folder}/looked-up-{uuid.uuid4().hex}"
        q.write.parquet(path)
        q = q.sparkSession.read.schema(q.schema).parquet(path)
    return sql(
        f"""WITH m AS (SELECT q.id, q.n, i.id AS strain, q.hash, i.gene, count(*) AS votes FROM {{q}} q JOIN {{i}} i ON i.hash = q.hash {"AND i.species = q.species" if pruned else ""} GROUP BY ALL),
                o AS (SELECT id, n, strain, collect_list(struct(gene, votes)) AS genes FROM m GROUP BY id, n, strain, hash),
                v AS (SELECT id, n, strain, x.gene, sum(x.votes) AS votes, count_if(p = 0) AS hits FROM o LATERAL VIEW posexplode(genes) e AS p, x GROUP BY id, n, strain, x.gene),
                w AS (SELECT id, strain, sum(hits) / n AS containment, min_by(gene, struct(-votes, gene IS NULL, gene)) AS gene FROM v GROUP BY id, n, strain)
           SELECT id, strain, containment, gene FROM w WHERE containment >= {{least}}""",
        q=q, i=index, least=least,
    )


def classify(reads: DataFrame, strains: DataFrame, coarse: DataFrame, fine: DataFrame, scale: float, top: int = 3, least: float = 0.1, folder: str | None = None) -> DataFrame:
    """Coarse then fine: only strains of a read's best species are looked up. An index without its strains' species is given them from ``strains``."""
    best = coarse_query(reads, coarse, scale, top).select("id", "species")
    keyed = fine if "species" in fine.columns else fine.join(strains.select("id", "species"), "id")
    return fine_query(reads, keyed, least, best, folder).join(strains.select(F.col("id").alias("strain"), "species"), "strain").select("id", "strain", "containment", "gene", "species")


def _versions(spark: SparkSession, path: str) -> tuple[Any, Any, list[int]]:
    """The index's file system, its folder of manifests, and the versions in it, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return system, folder, sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n))


def _manifest(spark: SparkSession, path: str) -> dict:
    _, folder, versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(f"{folder}/{versions[-1]}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Writes a manifest under its version, which must be new: of two that add at once, the second fails and nothing of it is seen."""
    system, folder, versions = _versions(spark, path)
    if manifest["version"] in versions:
        raise ValueError(f"version {manifest['version']} of {path} was written by another")
    out = system.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{manifest['version']}.json"), False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()


def _write_part(more: DataFrame, known: DataFrame | None, scale: float, path: str, part: str) -> tuple[str, str]:
    """Writes a part of the ``fine`` table, its files by species and in the order of the hash, and ``coarse`` from its files, less what is known; returns their schemas."""
    spark = more.sparkSession
    # A range of (species, hash) splits a species with very many rows, and lets a file's statistics tell which hashes it may hold.
    more.repartitionByRange("species", "hash").sortWithinPartitions("species", "hash").write.partitionBy("species").parquet(f"{path}/fine/part={part}")
    coarse = spark.read.schema(more.schema).parquet(f"{path}/fine/part={part}").where(F.col("hash") < dna.below(scale)).select("species", "hash").distinct()
    coarse = coarse if known is None else coarse.join(known, ["species", "hash"], "left_anti")
    coarse.write.parquet(f"{path}/coarse/part={part}")
    return more.schema.json(), coarse.schema.json()


def save_index(strains: DataFrame, table: DataFrame, genes: DataFrame, scale: float, path: str) -> None:
    """Writes an index: ``fine(id, species, hash, gene)``, partitioned by species, and ``coarse(species, hash)``; sequences are hashed once.

    Tables lie in parts, folders of their own, and a manifest of a version, written last, names the parts and the scale, so readers see whole versions only. A path that has an index already is an error.
    """
    spark = table.sparkSession
    if _versions(spark, path)[2]:
        raise FileExistsError(path)
    part = uuid.uuid4().hex
    fine, coarse = _write_part(sql("SELECT t.id, s.species, t.hash, t.gene FROM {t} t JOIN {s} s ON s.id = t.id", t=genes_at(table, genes), s=strains), None, scale, path, part)
    _commit(spark, path, {"version": 1, "scale": float(scale), "parts": [part], "fine": fine, "coarse": coarse})


def load_index(spark: SparkSession, path: str, species: list[str] | None = None) -> tuple[DataFrame, DataFrame, float]:
    """The coarse and fine tables and the scale of a saved index's newest version; of some species only if they are named, which leaves out the others' files."""
    known = _manifest(spark, path)
    read = lambda name: spark.read.schema(T.StructType.fromJson(json.loads(known[name]))).option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/part={p}" for p in known["parts"]])
    coarse, fine = read("coarse").select("species", "hash"), read("fine").select("id", "species", "hash", "gene")
    if species is not None:
        coarse, fine = (x.where(F.col("species").isin(species)) for x in (coarse, fine))
    return coarse, fine, known["scale"]


def add_to_index(strains: DataFrame, table: DataFrame, genes: DataFrame, path: str) -> None:
    """More strains for a saved index, under its scale, as its next version. Hashes that a species of the coarse table has already are not written again.

    A strain that the index has already is refused, so an add that is repeated cannot double its votes; one that fails leaves the last version as it was.
    """
    spark = table.sparkSession
    known = _manifest(spark, path)
    coarse, fine, scale = load_index(spark, path)
    held = fine.select("id").distinct().join(table.select("id").distinct(), "id", "left_semi").first()
    if held is not None:
        raise ValueError(f"strain {held['id']} is in the index already")
    part = uuid.uuid4().hex
    _write_part(sql("SELECT t.id, s.species, t.hash, t.gene FROM {t} t JOIN {s} s ON s.id = t.id", t=genes_at(table, genes), s=strains), coarse, scale, path, part)
    _commit(spark, path, known | {"version": known["version"] + 1, "parts": [*known["parts"], part]})


def classify_file(spark: SparkSession, path: str, index: str, strains: DataFrame, k: int, top: int = 3, least: float = 0.1, min_length: int = 50, split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits ``id, strain, containment, gene, species`` of a FASTQ file's reads in a saved index, and the summary of the file's classification; both are lazy.

    ``path`` is a file, a folder or a pattern, plain or compressed. Reads are split from it by bytes and their k-mers meet the saved tables, in one plan. Reads under ``min_length`` have no hits. A read of a name
    that another has too is told apart by its file and place, which its id then holds.
    """
    found = read_fastq(spark, path, **({"split_bytes": split_bytes} if split_bytes else {}))
    reads = found.select("read_id", F.concat_ws(":", "file", "at").alias("place"), "sequence")
    # Names that repeat are few or none; the place is unique.
    repeated = reads.groupBy("read_id").agg(F.count("*").alias("n")).where("n > 1").select("read_id", F.lit(True).alias("repeated"))
    named = reads.join(repeated, "read_id", "left").select(F.when(F.col("repeated"), F.concat_ws("@", "read_id", "place")).otherwise(F.col("read_id")).alias("id"), "sequence")
    coarse, fine, scale = load_index(spark, index)
    hits = classify(hashes(long_enough(named, min_length), k), strains, coarse, fine, scale, top, least)
    return hits, classification_summary(named, hits, min_length)


def long_enough(reads: DataFrame, least: int = 50) -> DataFrame:
    """Reads of at least so many bases; a read without a sequence is none."""
    return reads.where(F.length("sequence") >= least)


def classification_summary(reads: DataFrame, hits: DataFrame, min_length: int = 50) -> DataFrame:
    """Reads, classified, unclassified (too short ones too), too short, candidates of a classified read, and fractions."""
    return sql(
        """WITH c AS (SELECT id, count(*) AS n FROM {h} GROUP BY id), r AS (SELECT r.id, length(r.sequence) < {m} AS short, CASE WHEN length(r.sequence) < {m} THEN 0 ELSE coalesce(c.n, 0) END AS n FROM {r} r LEFT JOIN c ON c.id = r.id)
           SELECT count(*) AS total, count_if(n > 0) AS classified, count_if(n = 0) AS unclassified, count_if(short) AS too_short, coalesce(avg(n) FILTER (WHERE n > 0), 0D) AS mean_candidates,
                  coalesce(count_if(n > 0) / nullif(count(*), 0), 0D) AS classified_fraction, coalesce(count_if(n = 0) / nullif(count(*), 0), 0D) AS unclassified_fraction FROM r""",
        r=reads, h=hits, m=min_length,
    )


def mean_quality(reads: DataFrame) -> DataFrame:
    """Mean Phred score of the quality string, offset 33; 0 for an empty one."""
    score = F.aggregate(F.split("quality", ""), F.lit(0), lambda acc, c: acc + F.when(c == "", 0).otherwise(F.ascii(c) - 33))
    return reads.select("id", F.when(F.length("quality") > 0, score / F.length("quality")).otherwise(0.0).alias("mean_quality"))


def auto_scale(mean_length: float, k: int, scale: float = 0.001) -> float:
    """A larger scale for short genomes, so that a sketch keeps some five k-mers."""
    return scale if mean_length >= 1_000_000 else min(1.0, max(scale, 5 / max(1.0, mean_length - k + 1)))


# The bases that each IUPAC code stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def primer_hits(sequences: DataFrame, primer: str, mismatches: int = 0) -> DataFrame:
    """``id, pos, mismatches`` of every window that the primer fits, by IUPAC codes, with at most so many mismatches."""
    n, fits = len(primer), np.zeros((len(primer), 256), bool)
    for i, c in enumerate(primer.upper()):
        fits[i, np.frombuffer(IUPAC[c].encode(), np.uint8)] = True

    def found(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last, apart = len(raw) - n + 1, np.concatenate([[0], np.cumsum(raw == 255, dtype=np.int32)])
        missed = np.zeros(last, np.int32)
        for i in range(n):
            missed += ~fits[i][raw[i : i + last]]
        at = np.flatnonzero((missed <= mismatches) & (apart[n:] == apart[:-n]))
        return at, missed[at]

    return _at_places(sequences, n, found, pa.array, "mismatches int")


def amplicons(sequences: DataFrame, forward: str, reverse: str, mismatches: int = 2, shortest: int = 50, longest: int = 2000) -> DataFrame:
    """``id, start, end, mismatches``: the best stretch between the primers of each sequence, its reverse complement only if the sequence has none."""
    back = sequences.select("id", dna.revcomp(F.col("sequence")).alias("sequence"))
    found = None
    for strand, rows in (("+", sequences), ("-", back)):
        f = primer_hits(rows, forward, mismatches)
        r = primer_hits(rows, dna.revcomp_text(reverse), mismatches)
        pairs = sql(
            """SELECT f.id, f.pos AS start, r.pos + {n} AS `end`, f.mismatches + r.mismatches AS mismatches FROM {f} f JOIN {r} r ON r.id = f.id AND r.pos + {n} - f.pos BETWEEN {a} AND {b}""",
            f=f, r=r, n=len(reverse), a=shortest, b=longest,
        )
        pairs = pairs.withColumn("strand", F.lit(strand))
        found = pairs if found is None else found.unionAll(pairs)
    return sql("SELECT id, start, `end`, mismatches, strand FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strand, mismatches, start, `end`) AS rn FROM {p}) WHERE rn = 1", p=found)
