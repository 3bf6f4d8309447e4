"""A saved reference set: species, markers and one sequence for each pair that has one, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.operators import mixture

SPECIES = "species_id string, name string, status string, mito_cn double, dna_yield double"
MARKERS = "marker_id string, primer_f string, primer_r string"
SEQUENCES = "species_id string, marker_id string, sequence string"


@dataclass(frozen=True)
class References:
    species: DataFrame
    markers: DataFrame
    sequences: DataFrame


def builtin(spark: SparkSession) -> References:
    """The species and markers of the library, without sequences."""
    species, markers = mixture.reference_tables(spark)
    return References(species, markers, spark.createDataFrame([], SEQUENCES))


def _unique(rows: DataFrame, *key: str) -> None:
    twice = rows.groupBy(*key).count().where("count > 1").first()
    if twice:
        raise ValueError(f"more than one row of {', '.join(str(twice[k]) for k in key)}")


def add(refs: References, species: DataFrame | None = None, markers: DataFrame | None = None, sequences: DataFrame | None = None) -> References:
    """The set with more rows. ValueError if an id is there already, or a sequence's species or marker is not; pairs without a sequence have no row."""
    s = refs.species.unionByName(species) if species is not None else refs.species
    m = refs.markers.unionByName(markers) if markers is not None else refs.markers
    q = refs.sequences.unionByName(sequences) if sequences is not None else refs.sequences
    q = q.where(F.length("sequence") > 0)
    _unique(s, "species_id"), _unique(m, "marker_id"), _unique(q, "species_id", "marker_id")
    for key, known in (("species_id", s), ("marker_id", m)):
        lost = q.join(known, key, "left_anti").first()
        if lost:
            raise ValueError(f"a sequence of {lost[key]}, which the set does not have")
    return References(s, m, q)


def save(refs: References, path: str) -> None:
    for name in ("species", "markers", "sequences"):
        getattr(refs, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> References:
    """A saved set; a folder with other columns is refused."""
    found = []
    for name, schema in (("species", SPECIES), ("markers", MARKERS), ("sequences", SEQUENCES)):
        rows, want = spark.read.parquet(f"{path}/{name}"), [x.split()[0] for x in schema.split(", ")]
        if not set(want) <= set(rows.columns):
            raise ValueError(f"{path}/{name} is no table of a reference set")
        found.append(rows.select(*want))
    return References(*found)


def named(ids: DataFrame, refs: References) -> DataFrame:
    """``(species_id, marker_id)`` with the species' facts and the sequence, null where the set has none."""
    return ids.join(refs.species, "species_id", "left").join(refs.markers.select("marker_id", "primer_f", "primer_r"), "marker_id", "left").join(refs.sequences, ["species_id", "marker_id"], "left")
