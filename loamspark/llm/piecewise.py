"""The tokenizers library over many texts: texts are cut where no token can cross, each distinct piece is encoded once.

Both vocabularies split a text by a pattern before they merge. A cut is made before a single
blank, and before and after a single line feed, that stand between two characters which are no
white space, and between an ASCII letter and an ASCII sign or digit after it: there the pattern ends one match and
starts another whatever else the text holds, so the ids of the pieces, one after the other, are the ids of the whole text. Other
white space is left inside its piece.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from . import blocks

#: Pieces of at most so many bytes whose ids a worker keeps between slices (about 40 MB); the rest are encoded again in each slice.
KEPT_PIECES = 1_000_000
KEPT_BYTES = 48
#: Pieces that are encoded as one text, with a separator between them.
JOINED = 4096
#: Text between pieces: alone between pieces that hold no other white space or control character, it is one match and one token.
SEPARATORS = ("\n", " \0 ")

# Bytes that can start a character that is no white space: ASCII, two-byte characters from U+00C0, and three- or
# four-byte ones but for E1-E3, which also hold Unicode's spaces.
_OPENS = np.zeros(256, dtype=bool)
_OPENS[0x21:0x7F] = True
_OPENS[0xC3:0xE1] = True
_OPENS[0xE4:0xF5] = True
_ASCII = np.zeros(256, dtype=bool)
_ASCII[0x21:0x7F] = True
_PAIR = np.zeros(256, dtype=bool)
_PAIR[0xC3:0xE0] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SIGN = _ASCII & ~_LETTER
# White space, control characters, and bytes that can start a character of them.
_APART = np.zeros(256, dtype=bool)
_APART[:0x21] = True
_APART[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def cuts(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sorted positions of piece starts, with every row's start, and the length of ``raw`` at the end."""
    n = len(raw)
    if n < 3:
        mark = np.zeros(n + 1, dtype=bool)
        mark[rows] = mark[n] = True
        return np.flatnonzero(mark)
    white = (raw == 0x20) | (raw == 0x0A)
    white[0] = white[-1] = False
    at = np.flatnonzero(white)
    before = _ASCII[raw[at - 1]]
    far = at >= 2
    before[far] |= (raw[at[far] - 1] >= 0x80) & (raw[at[far] - 1] < 0xC0) & _PAIR[raw[at[far] - 2]]
    at = at[before & _OPENS[raw[at + 1]]]
    feeds = at[raw[at] == 0x0A]
    mark = np.zeros(n + 1, dtype=bool)
    mark[at] = True
    mark[feeds + 1] = True
    mark[1:n] |= _LETTER[raw[:-1]] & _SIGN[raw[1:]]
    mark[rows] = True
    mark[n] = True
    return np.flatnonzero(mark)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The file's tokenizer; strings of special tokens in a text are ordinary text. Loaded once in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Pieces:
    """Ids by piece, for one worker and vocabulary."""

    def __init__(self, path: str, kept: int = KEPT_PIECES) -> None:
        self.tokenizer, self.kept = tokenizer(path), kept
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))
        # The separator whose token is one, and that token.
        alone = [(s, self._plain([s])[0]) for s in SEPARATORS]
        self.separator, self.mark = next((s, int(ids[0])) for s, ids in alone if len(ids) == 1)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by piece, of pieces that a separator keeps apart."""
        n = len(new)
        groups = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, n, JOINED), n), pa.int32()), new)
        found = [np.array(ids, np.uint32) for ids in self._plain(pc.binary_join(groups, self.separator).to_pylist())]
        sizes = []
        for ids, own in zip(found, groups.value_lengths().to_pylist(), strict=True):
            at = np.flatnonzero(ids == self.mark)
            if len(at) != own - 1:
                raise ValueError("a piece holds the separator's token")
            sizes.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
        ids = np.concatenate(found)
        return ids[ids != self.mark], np.concatenate(sizes)

    def encode_new(self, new: pa.Array) -> pa.ListArray:
        """The ids of each piece: most pieces in long texts with a separator between them, those with other white space by themselves."""
        raw, at = blocks.utf8(new)
        apart = np.append(0, np.cumsum(_APART[raw], dtype=np.int32))
        leading = (raw[at[:-1]] == 0x20) & (np.diff(at) > 1) if len(new) else np.zeros(0, bool)
        alone = np.diff(apart[at]) > leading
        lengths = np.zeros(len(new), np.int64)
        parts, order = [], [np.flatnonzero(~alone), np.flatnonzero(alone)]
        if len(order[0]):
            ids, lengths[order[0]] = self._joined(new.take(pa.array(order[0])))
            parts.append(ids)
        if len(order[1]):
            found = self._plain(new.take(pa.array(order[1])).to_pylist())
            lengths[order[1]] = [len(ids) for ids in found]
            parts.append(np.array([i for ids in found for i in ids], np.uint32))
        back = np.empty(len(new), np.int64)
        back[np.concatenate(order)] = np.arange(len(new))
        offsets = np.append(0, np.cumsum(lengths[np.concatenate(order)]))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)).take(pa.array(back))

    def table(self, distinct: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Lists of ids, and which of them is each piece's."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        short = pc.less_equal(pc.binary_length(distinct), KEPT_BYTES).to_numpy(zero_copy_only=False)[missing]
        missing = np.concatenate([missing[short], missing[~short]])
        at[missing] = len(self.known) + np.arange(len(missing))
        new = distinct.take(pa.array(missing))
        lists = pa.concat_arrays([self.ids, self.encode_new(new)])
        room = min(self.kept - len(self.known), int(short.sum()))
        if room:
            self.known = pa.concat_arrays([self.known, new.slice(0, room)])
            self.ids = pa.concat_arrays([lists.slice(0, len(self.known))])
        return lists, at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, and where each row's begin (and the last end); a null is empty."""
        raw, rows = blocks.utf8(texts)
        at = cuts(raw, rows)
        coded = blocks.binaries(raw, at, pa.string()).dictionary_encode()
        lists, which = self.table(coded.dictionary)
        out = lists.take(pa.array(which[coded.indices.to_numpy()]))
        ends = out.offsets.to_numpy()
        return out.values.to_numpy(), ends[np.searchsorted(at, rows)].astype(np.int64)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the rows, their ids with ``end`` after each row, and the row offsets into the ids."""
    coder = pieces(path)
    for batch in batches:
        for part in blocks.slices(batch, "text"):
            ids, rows = coder.encode(part.column("text"))
            n = part.num_rows
            out = np.full(len(ids) + n, end, np.uint32)
            keep = np.ones(len(out), dtype=bool)
            keep[rows[1:] + np.arange(n)] = False
            out[keep] = ids
            yield part, out, rows + np.arange(n + 1)
