"""Classification of a stream of reads: each micro-batch is a stream-static join with the index, distinct hashes are kept as state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamspark.operators import kmers
from loamspark.session import saved, table_folder


def hits(reads: DataFrame, index: DataFrame, k: int = 21) -> DataFrame:
    """``id, species, hash``: a row for each k-mer of a read ``(id, sequence)``, streamed or not, in ``index(species, hash)``. Sequences are cut into pieces first, as everywhere."""
    return kmers.hashes(reads, k).select("id", "hash").join(index.select("species", "hash"), "hash").select("id", "species", "hash")


def counts(reads: DataFrame, index: DataFrame, k: int = 21, minutes: int | None = None) -> DataFrame:
    """``id, species, hashes`` of a stream: the exact number of a read's distinct hashes that a species holds, a row whenever it has grown.

    The state of a read and species is the set of hashes that met so far, in whatever batches they came; it is bounded by the read's own k-mers and, in a stream without end, given up ``minutes`` after its last row.
    With a time limit Spark asks for timeouts again and again, so a stream that is to end with its source (``availableNow``, as ``latest``) takes none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*reads.schema, *index.schema]}

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = set(state.get[0]) if state.exists else set()
        before = len(known)
        for batch in batches:
            known.update(batch["hash"])
        state.update((sorted(known),))
        if minutes is not None:
            state.setTimeoutDuration(minutes * 60_000)
        if len(known) > before:
            yield pd.DataFrame({"id": [key[0]], "species": [key[1]], "hashes": [len(known)]})

    found = hits(reads, index, k).groupBy("id", "species")
    return found.applyInPandasWithState(update, f"id {kinds['id']}, species {kinds['species']}, hashes long", "hashes array<string>", "update", GroupStateTimeout.NoTimeout if minutes is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest(stream: DataFrame, keys: list[str], value: str, spark: SparkSession, name: str = "stream") -> DataFrame:
    """Runs a stream of growing values over what its source holds now, and returns the largest ``value`` of each key. Batches are tables of the shared folder, numbered, so that one that is run again replaces itself."""
    folder = f"{table_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    return saved(rows.groupBy(*keys).agg(F.max(value).alias(value)), name)
