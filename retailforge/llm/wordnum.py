"""Word tokens of Arrow string batches as numpy arrays.

The operators that look at words (decontamination, language ID, near
duplicates, scoring) all start from the same three arrays per block of
texts: byte start, byte end and a 64-bit hash of each word.  Word classes are
sets of ASCII bytes; every byte of a non-ASCII character belongs to the same
side, so the byte view and the code point view cut words at the same places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text forms a block of its own.
BLOCK = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values whose bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z as a-z

#: lower-cased letters, digits and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: everything but space and the control characters 09-0D
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)
_FOLDED_BYTE = _BYTE[_FOLD]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int):
    """Powers of the base and of its inverse, grown as needed."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[k] = p
    return _powers[0][:n], _powers[1][:n]


class Block:
    """Some whole texts: ``data`` bytes, ``bounds`` of the texts, and their words."""

    __slots__ = ("row", "data", "bounds", "starts", "ends", "hashes", "first")

    def __init__(self, row: int, data: np.ndarray, bounds: np.ndarray, word: np.ndarray, fold: bool):
        self.row, self.data, self.bounds = row, data, bounds
        n = len(data)
        mask = word[data] if n else np.zeros(0, bool)
        edge = np.empty(n + 1, bool)
        edge[:-1], edge[-1] = mask, False
        edge[1:] ^= mask  # edge[i]: byte i and byte i - 1 differ
        cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < n)]
        cuts = np.unique(cuts[mask[cuts] & mask[cuts - 1]]) if n else cuts
        at = np.flatnonzero(edge)
        if len(cuts):  # two texts that touch with word bytes on both sides
            at = np.sort(np.concatenate([at, cuts, cuts]))
        self.starts, self.ends = at[0::2], at[1::2]
        p, q = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED_BYTE if fold else _BYTE)[data] * p[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * q[self.starts])
        self.first = np.searchsorted(self.starts, bounds)  # words first[i]:first[i + 1] are those of text i

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; NULL is the empty string."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def blocks(col: pa.Array, word: np.ndarray = ALNUM, fold: bool = True, size: int = BLOCK):
    """Cut a string column into :class:`Block` s of about ``size`` bytes of whole texts."""
    data, bounds = as_bytes(col)
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        b = min(b, n)
        yield Block(a, data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], word, fold)
        a = b


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (across text borders too; callers mask those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += words[j:j + n]
    return mix(out)
