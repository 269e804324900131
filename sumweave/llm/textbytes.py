"""Texts of an Arrow batch as one byte array, with vectorised words, lines and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 19
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_powers = {_ODD: np.ones(1, np.uint64), _INV: np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    p = _powers.setdefault(base, np.ones(1, np.uint64))
    if len(p) < n:
        p = np.full(max(n, 2 * len(p)), base, np.uint64)
        p[0] = 1
        p = np.cumprod(p)
        if len(p) <= 4 * CHUNK:
            _powers[base] = p
    return p[:n]


class Texts:
    """Some texts: buf[offs[i]:offs[i + 1]] is text i. Word hashes fold A-Z to a-z if fold is set."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, fold: bool = False, spaces: np.ndarray = SPACES):
        self.buf, self.offs, self.fold, self.spaces = buf, offs, fold, spaces
        self.n = len(offs) - 1

    def take(self, rows: np.ndarray) -> Texts:
        sizes = np.diff(self.offs)[rows]
        offs = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(offs[-1]) + np.repeat(self.offs[:-1][rows] - offs[:-1], sizes)
        return Texts(self.buf[at], offs, self.fold, self.spaces)

    def __getitem__(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()

    @cached_property
    def prefix(self) -> np.ndarray:
        """prefix[i]: the polynomial hash of the i first bytes."""
        h = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((_FOLD if self.fold else _BYTE)[self.buf] * powers(_ODD, len(self.buf)), out=h[1:])
        return h

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they are."""
        h = (self.prefix[ends] - self.prefix[starts]) * powers(_INV, len(self.buf) + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64))

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(self.buf) + 1, bool)
        inside[:-1] = ~self.spaces[self.buf]
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.offs] = True
        before = np.concatenate([[False], inside[:-1]])
        return np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))

    @property
    def starts(self) -> np.ndarray:
        return self._words[0]

    @property
    def ends(self) -> np.ndarray:
        return self._words[1]

    @cached_property
    def first(self) -> np.ndarray:
        """Words first[i] .. first[i + 1] - 1 are those of text i."""
        return np.searchsorted(self.starts, self.offs)

    @cached_property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.first))

    @cached_property
    def words(self) -> np.ndarray:
        """The hash of each word."""
        return self.hashes(self.starts, self.ends)

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on, also across texts; the last k - 1 words have none."""
        n = max(0, len(self.words) - k + 1)
        h = self.words[:n].copy()
        for j in range(1, k):
            h = h * _ODD + self.words[j : j + n]
        return mix(h)

    def whole(self, k: int) -> np.ndarray:
        """Of the grams of k words, those within one text."""
        n = max(0, len(self.words) - k + 1)
        return self.doc[:n] == self.doc[len(self.words) - n :] if n else np.zeros(0, bool)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty."""
    a = batch.column(batch.schema.get_field_index(name))
    if a.null_count:
        a = a.fill_null("")
    _, at, data = a.buffers()
    wide = np.int64 if pa.types.is_large_string(a.type) else np.int32
    offs = np.frombuffer(at, wide)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(batch: pa.RecordBatch, name: str = "text", fold: bool = False, spaces: np.ndarray = SPACES) -> Iterator[tuple[int, int, Texts]]:
    """(lo, hi, the texts of rows lo .. hi - 1), about CHUNK bytes at a time."""
    buf, offs = column(batch, name)
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK, "right")) - 1)
        yield lo, hi, Texts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], fold, spaces)
        lo = hi
