"""Vectorised byte, word and fingerprint kernels shared by the text operators.

Everything works on one flat ``uint8`` buffer that holds many texts one after
another plus an ``int64`` offset array, which is exactly how Arrow stores a
string column, so no per-row Python objects are made on the hot path.

Fingerprints are polynomials modulo 2**64 over a random 64-bit alphabet with an
odd base.  An odd base has an inverse modulo 2**64, so the fingerprint of any
range is ``(P[e] - P[s]) * base**-s`` from one prefix array ``P``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are worked on in chunks of about this many bytes, which bounds the
#: scratch arrays of a worker (about twenty arrays of eight bytes a position).
CHUNK_BYTES = 1 << 20
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_tables: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def alphabet(seed: int = 0) -> np.ndarray:
    """256 fixed random 64-bit symbols, one for each byte; others for each seed."""
    if ("alphabet", seed) not in _tables:
        _tables["alphabet", seed] = mix((np.arange(1, 257, dtype=U64) + U64(256 * seed)) * U64(0xD6E8FEB86659FD93))
    return _tables["alphabet", seed]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16) * 5 // 4, base % 2**64, dtype=U64)
        steps[0] = 1
        have = _tables[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


class Prefix:
    """Prefix fingerprints of a symbol array; ``of(s, e)`` is that of [s, e)."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        n = len(symbols)
        self.back = powers(inverse(base), n + 1)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(symbols * powers(base, n), out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.sums[e] - self.sums[s]) * self.back[s]

    def grams(self, k: int) -> np.ndarray:
        """Fingerprints of all k-grams."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:-k]) * self.back[:n] if n > 0 else np.zeros(0, U64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges [i, j) of texts of about ``most`` bytes; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    if "lower" not in _tables:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        _tables["lower"] = table
    return _tables["lower"][buf]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each text,
    the index of its first word (one more entry than texts)."""
    if "word" not in _tables:
        table = np.ones(256, bool)
        table[list(_SEPARATORS)] = False
        _tables["word"] = table
    return runs(_tables["word"], buf, offsets)


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, for runs of ASCII letters and bytes of other alphabets."""
    if "letter" not in _tables:
        table = np.arange(256) >= 128
        table[65:91] = table[97:123] = True
        _tables["letter"] = table
    return runs(_tables["letter"], buf, offsets)


def runs(member: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that ``member`` holds, within each text."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = member[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, base: int = BASES[0], seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each word."""
    p = Prefix(alphabet(seed)[buf], base)
    return mix(p.of(s, e) + (e - s).astype(U64) * U64(0xA0761D6478BD642F))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w by doubling: log2(w) vector passes."""
    span, out = 1, a
    while span < w:
        step = min(span, w - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


class Extents:
    """The windows of each text, grouped by their minimiser.

    A window is ``width`` consecutive symbols of one text.  Its minimiser is the
    k-gram in it with the least upper half of its fingerprint (the leftmost of equal ones), which
    depends on nothing but the window, so equal windows have equal minimisers at
    equal places.  Consecutive windows with one minimiser make an extent.

    first, last: starts of the extent's first and last window; anchor: the place
    of its minimiser; gram: fingerprint of the minimiser; body: fingerprint of
    all symbols of the extent, together with the minimiser's place in it.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, width: int, k: int):
        n = len(symbols)
        self.width = width
        self.prefix = Prefix(symbols, BASES[0])
        zero = np.zeros(0, np.int64)
        self.first = self.last = self.anchor = self.text = zero
        self.gram = self.body = np.zeros(0, U64)
        if n < width:
            return
        grams = mix(self.prefix.grams(k))
        # the same bits decide whatever the length, so that equal windows agree in every chunk
        low = (U64(1) << U64(32)) - U64(1)
        least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=U64), width - k + 1)
        lengths = np.diff(bounds)
        ends = np.repeat(bounds[1:], lengths)[: n - width + 1]
        starts = np.flatnonzero(np.arange(width, n + 1) <= ends)
        if not len(starts):
            return
        at = (least[starts] & low).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(starts)) - 1
        self.first, self.last, self.anchor = starts[heads], starts[tails], at[heads]
        self.text = np.searchsorted(bounds, self.first, "right") - 1
        self.gram = grams[self.anchor]
        self.body = window_key(self.prefix, self.first, self.last + width, self.anchor)


def window_key(prefix: Prefix, s: np.ndarray, e: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Fingerprint of [s, e) and of where its minimiser stands in it."""
    return mix(mix(prefix.of(s, e)) + (anchor - s).astype(U64) * U64(0xE7037ED1A0B428DB) + (e - s).astype(U64) * U64(0x8EBC6AF09C88C6E3))


def spans_mask(n: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """True where any of the ranges [s, e) covers a position of n."""
    return np.cumsum(np.bincount(s, minlength=n + 1)[:n] - np.bincount(e, minlength=n + 1)[:n]) > 0
