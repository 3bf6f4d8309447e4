"""Byte-level BPE with the tiktoken library: whole texts to ids and ids back to bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: A single blank between two other characters: every match of the pattern that takes this blank starts with it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Characters after which a long text is split at the next safe boundary.
LONG_TEXT = 1 << 16


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a local rank file, without special tokens; loaded once in a worker."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_parts(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut only where the pattern cannot match across.

    A blank between two characters that are no white space opens a new match whatever stands
    before it, so the ids of the parts are the ids of the text. A text without such a place stays whole.
    """
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    """The ids of the whole text, little-endian unsigned 32-bit."""
    found = [enc.encode_ordinary(part) for part in safe_parts(text)]
    return np.array(found[0] if len(found) == 1 else [i for part in found for i in part], dtype="<u4")


def decode(ids: np.ndarray, enc: tiktoken.Encoding) -> bytes:
    """The bytes of the ids, which need not be valid UTF-8 when the ids are a part of a text."""
    return enc.decode_bytes(ids.tolist())


def encode_decode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` for every row: the text's ids and the bytes that they decode to.

    ``ids`` holds little-endian unsigned 32-bit ids. A null text counts as empty: no ids, no bytes.
    Every row stands alone: repeated rows and null ids give a row each, other columns are not
    read, an empty table gives an empty one. Nothing is shuffled.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                ids = [encode(t or "", enc) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([decode(x, enc) for x in ids], pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")
