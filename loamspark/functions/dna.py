"""K-mers and their hashes as columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = ("ACGT" * 7)[:26]


def projected(text: Column) -> Column:
    """Letters a-z of any text read as bases, for sequences where there are none."""
    return F.translate(F.upper(F.regexp_replace(F.lower(text), "[^a-z]", "")), _LETTERS, _BASES)


def revcomp(seq: Column) -> Column:
    """Reverse complement, of IUPAC codes too."""
    return F.reverse(F.translate(F.upper(seq), "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def valid(kmer: Column, bases: str = "ACGT") -> Column:
    """Only the given bases; with none given, anything but N."""
    return F.translate(kmer, bases, "") == "" if bases else ~F.contains(kmer, F.lit("N"))


def hash_hex(kmer: Column, seed: int = 42) -> Column:
    """The first 8 bytes of md5(seed, k-mer) as a little-endian number, in 16 hexadecimal digits that sort like it."""
    h = F.md5(F.concat(F.lit(seed.to_bytes(8, "little")), F.encode(kmer, "utf-8")))
    # Plain uses of h: generated code computes a repeated expression once, and a lambda would leave generated code.
    return F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])


_SHIFTS = [by for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for by in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_block(state: list[np.ndarray], words: list) -> list[np.ndarray]:
    """MD5's step over a block of 16 words, each an array or a number that all share, for many texts at once."""
    a, b, c, d = (x.copy() for x in state)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 32:
            x, y, z, g = (d, b, c, i) if i < 16 else (c, d, b, (5 * i + 1) % 16)
            np.bitwise_xor(z, x, out=f)
            f &= y
            f ^= x
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[g], np.ndarray):
            f += words[g]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + words[g]) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=turned)
        f >>= np.uint32(32 - _SHIFTS[i])
        turned |= f
        turned += b
        # The oldest word's array takes the next new one.
        a, b, c, d, turned = d, turned, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


#: The ASCII of four bases by their code of 8 bits, as a little-endian number.
_FOUR = np.array([int.from_bytes(bytes(b"ACGT"[code >> by & 3] for by in (6, 4, 2, 0)), "little") for code in range(256)], np.uint32)


def md5_numbers(codes: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """What ``hash_hex`` writes, as unsigned numbers, of many k-mers at once, given by their codes of two bits a base; k at most 31.

    MD5 by its definition, each step on all k-mers: a call for each costs some ten times as much.
    """
    words: list = [int.from_bytes(seed.to_bytes(8, "little")[at : at + 4], "little") for at in (0, 4)]
    for at in range(0, k, 4):
        left = 2 * (k - at) - 8
        word = _FOUR[(codes >> left if left >= 0 else codes << -left) & 255]
        words.append(word if left >= 0 else word & np.uint32((1 << 8 * (k - at)) - 1) | np.uint32(0x80 << 8 * (k - at)))
    words += [0x80] * (k % 4 == 0)
    words += [0] * (14 - len(words)) + [8 * (8 + k), 0]
    low, high, *_ = _md5_block([np.full(len(codes), x, np.uint32) for x in _START], words)
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def hex_digits(numbers: np.ndarray) -> np.ndarray:
    """The 16 hexadecimal digits of each unsigned number in ASCII, one after the other."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    pairs = (digits[np.arange(256) >> 4].astype(np.uint16) | digits[np.arange(256) & 15].astype(np.uint16) << 8).astype("<u2")
    return pairs[numbers.astype(">u8").view(np.uint8)].view(np.uint8)


_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def canonical_codes(raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k-mers of A, C, G and T in an upper-case text in ASCII, k at most 31, and the codes of the smaller of both strands, which sort like the k-mers."""
    base = _CODES[raw]
    wrong = np.concatenate([[0], np.cumsum(base > 3, dtype=np.int32)])
    at = np.flatnonzero(wrong[k:] == wrong[:-k])
    # Codes of 1, 2, 4.. bases by doubling; those of k are put together from them. Of the other strand, the first base is the last.
    one = (base & 3).astype(np.int64)
    other, size, done, code, back = 3 - one, 1, 0, np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    while True:
        if k & size:
            n = len(raw) - done - size + 1
            code = (code[:n] << 2 * size) | one[done : done + n]
            back = back[:n] | (other[done : done + n] << 2 * done)
            done += size
        if done == k:
            return at, np.minimum(code, back)[at]
        n = len(one) - size
        one, other, size = (one[:n] << 2 * size) | one[size:], other[:n] | (other[size:] << 2 * size), 2 * size


def below(scale: float) -> str:
    """Hashes under this belong to a sketch of the scale."""
    if not 0 < scale <= 1:
        raise ValueError("scale must be over 0 and at most 1")
    return format(int((2**64 - 1) * scale), "016x")


def revcomp_text(seq: str) -> str:
    return seq.upper().translate(str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"))[::-1]


def code(kmer: str | Column) -> Column:
    """Two bits for each base, A 0, C 1, G 2 and T 3 in either case, as a signed long; null with any other letter."""
    text = F.upper(F.col(kmer) if isinstance(kmer, str) else kmer)
    return F.when(valid(text), F.conv(F.translate(text, "ACGT", "0123"), 4, -10).cast("long"))


def _times(x: str, factor: int) -> str:
    """The lower 64 bits of a product with a constant, from parts of 16 and 32 bits that no long overflows."""
    low, high, word, half = factor & 0xFFFFFFFF, factor >> 32, 0xFFFFFFFF, 0xFFFF

    def below(first: str, second: str, by: int) -> str:
        return f"((({first}) * {by}L) + shiftleft((({second}) * {by}L) & {half}L, 16))"

    parts = [f"(shiftrightunsigned({x}, {at}) & {half}L)" for at in (0, 16, 32, 48)]
    start = below(parts[0], parts[1], low)
    carry = f"shiftrightunsigned({start}, 32) + shiftrightunsigned({parts[1]} * {low}L, 16)"
    top = f"({carry} + ({below(parts[0], parts[1], high)} & {word}L) + ({below(parts[2], parts[3], low)} & {word}L))"
    return f"shiftleft({top} & {word}L, 32) | ({start} & {word}L)"


def _folded(x: str) -> str:
    return f"{x} ^ shiftrightunsigned({x}, 33)"


# The two factors of MurmurHash3's 64-bit finaliser.
FACTORS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Its five steps as SQL of a column's name.
MIX = (_folded, lambda x: _times(x, FACTORS[0]), _folded, lambda x: _times(x, FACTORS[1]), _folded)
