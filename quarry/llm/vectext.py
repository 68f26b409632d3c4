"""Vectorised text primitives: words of whole Arrow batches as numpy arrays.

A word is a maximal run of bytes outside the ASCII white space
``\\x20 \\x09-\\x0D``; UTF-8 continuation bytes are never white space, so byte
runs and code-point runs agree.  The hash of a word adds up a mixed value of
each byte at its place in the word, from prefix sums; a polynomial of the bytes
modulo 2**64 would give one hash to words of a known form, whatever its base.
Word windows have Rabin-Karp polynomials of these modulo 2**61 - 1.  Batches are walked in slices of bounded bytes, so memory does not depend on
how long a text or a batch is (one text is the least slice).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 18
SLICE_ROWS = 1 << 13
#: Seeds of the independent word hashes.
_SEEDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_PRIME = (1 << 61) - 1
#: Bases of the window polynomials, one for each kind of word hash.
_BASES = (0x1A2B3C4D5E6F7081 % _PRIME, 0x0F1E2D3C4B5A6978 % _PRIME)

def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element-wise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                p = np.full(size, base, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1 up to a multiple of it; the same steps give the same number."""
    return (x & U64(_PRIME)) + (x >> U64(61))


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo 2**61 - 1, in halves of 31 bits."""
    au, al, bu, bl = a >> U64(31), a & U64(0x7FFFFFFF), U64(b >> 31), U64(b & 0x7FFFFFFF)
    mid = al * bu + au * bl
    return _reduced(au * bu * U64(2) + (mid >> U64(30)) + ((mid & U64(0x3FFFFFFF)) << U64(31)) + al * bl)


def rolled(units: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hash of the k units from each unit on: their polynomial modulo 2**61 - 1, mixed.

    Hashes of 1, 2, 4, ... units are joined, so k steps take log k passes.
    """
    n, size, out, have = len(units), 1, None, 0
    if n < k:
        return np.zeros(0, U64)
    part, base = _reduced(units), _BASES[which]  # of ``size`` units, and the base to that power
    while True:
        if k & size:
            out = part if out is None else _reduced(_times(out[: n - have - size + 1], base) + part[have:])
            have += size
        if have == k:
            return mix(out[: n - k + 1])
        part = _reduced(_times(part[:-size], base) + part[size:])
        base = base * base % _PRIME
        size *= 2


def _values(byte: np.ndarray, place: np.ndarray, which: int) -> np.ndarray:
    """A mixed value of each byte at its place in a word."""
    return mix((byte.astype(U64) + U64(1) + (place.astype(U64) << U64(9))) * U64(_SEEDS[which]))


_NEAR = 64  # places whose values are looked up
_near_values = [_values(np.arange(_NEAR << 8) & 255, np.arange(_NEAR << 8) >> 8, i) for i in range(2)]


def release() -> None:
    """Give freed memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches that gives its memory back when a task ends: workers live on."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def text_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    elif pa.types.is_string(col.type):
        kind = np.int32
    else:
        return text_column(col.cast(pa.string()))
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """Row ranges (a, b) of at most ``rows`` rows and ``limit`` bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), a + rows, n)
        yield a, b
        a = b


class Words:
    """Words of rows a..b of a batch: byte spans, 64-bit hashes, row starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, a: int, b: int, lower: bool = False):
        lo, hi = int(offsets[a]), int(offsets[b])
        raw = data[lo:hi]
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        self.raw = raw
        n = hi - lo
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        cuts = offsets[a : b + 1] - lo
        # a word ends where its document ends, even if the next begins with a letter
        start_mask = inside[1:-1] & ~inside[:-2]
        end_mask = inside[1:-1] & ~inside[2:]
        inner = cuts[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        if len(inner):
            start_mask[inner] = inside[1:-1][inner]
            end_mask[inner - 1] = inside[1:-1][inner - 1]
        self.start = np.flatnonzero(start_mask)
        self.end = np.flatnonzero(end_mask) + 1
        self.rows = np.searchsorted(self.start, cuts)  # word index at which each row begins
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, which: int = 0) -> np.ndarray:
        """64-bit hashes of the words, of one of two independent kinds."""
        if which not in self._hashes:
            n = len(self.raw)
            at = np.arange(n, dtype=np.int32)
            begin = np.zeros(n, np.int32)
            begin[self.start] = self.start
            place = at - np.maximum.accumulate(begin)  # in the word, or beyond its end
            far = np.flatnonzero(place >= _NEAR)
            near = np.minimum(place, _NEAR - 1) << 8
            near |= self.raw
            value = _near_values[which][near]
            if len(far):
                value[far] = _values(self.raw[far], place[far], which)
            prefix = np.zeros(n + 1, U64)
            np.cumsum(value, out=prefix[1:])
            self._hashes[which] = mix(prefix[self.end] - prefix[self.start] + (self.end - self.start).astype(U64))
        return self._hashes[which]

    @property
    def hash(self) -> np.ndarray:
        return self.hashes()

    def names(self) -> pa.Array:
        """The words themselves, as a binary array."""
        size = self.end - self.start
        total = np.cumsum(size)
        at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.start - (total - size), size)
        offsets = pa.py_buffer(np.r_[0, total].astype(np.int32).tobytes())
        return pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(self.raw[at].tobytes())])

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and where all k lie in one row."""
        out = rolled(self.hashes(which), k, which)
        last = np.repeat(self.rows[1:], np.diff(self.rows))  # end of the row of each word
        return out, (np.arange(len(out)) + k) <= last[: len(out)]
