"""Embedding columns: which vectors take part, distinct vectors, and their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(embedding: str = "embedding") -> Column:
    """Neither null, empty or zero, nor with a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def keyed(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, ok, h1, h2`` with 128 bits of hash that tell vectors apart; rows without id take no part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.select("*", (valid() & F.col("vec_id").isNotNull()).alias("ok"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False)
