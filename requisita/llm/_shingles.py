"""Word shingles of whole texts as sorted distinct 64-bit fingerprints."""

from __future__ import annotations

import numpy as np

from ._seq import BASES, U64, Prefix, lower_ascii, mix, word_hashes, words


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and where each text's begin.
    A text of fewer words than ``size`` has all its words as one shingle."""
    n = len(offsets) - 1
    low = lower_ascii(buf)
    s, e, first = words(low, offsets)
    count = np.diff(first)
    prefix = Prefix(word_hashes(low, s, e), BASES[1])
    whole = np.flatnonzero((count > 0) & (count < size))
    grams = np.maximum(count - size + 1, 0)
    text = np.repeat(np.arange(n), grams)
    start = np.repeat(first[:-1], grams) + np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams)
    text = np.concatenate([text, whole])
    begin = np.concatenate([start, first[whole]])
    end = np.concatenate([start + size, first[whole + 1]])
    value = mix(prefix.of(begin, end) + (end - begin).astype(U64))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(n + 1))


def one_permutation(values: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash: a row of ``bins`` minima for each non-empty set.
    Empty bins take the value of a bin that a universal hash of (bin, attempt)
    names, tried again until it is not empty (optimal densification)."""
    bits = U64(64 - int(bins).bit_length() + 1)
    n = len(first) - 1
    size = np.diff(first)
    text = np.repeat(np.arange(n), size)
    at = (values >> bits).astype(np.int64)
    head = np.ones(len(values), bool)
    head[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1])
    sketch = np.zeros((n, bins), U64)
    full = np.zeros((n, bins), bool)
    sketch[text[head], at[head]] = values[head]
    full[text[head], at[head]] = True
    row, hole = np.nonzero(~full & (size > 0)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        donor = (mix(hole.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(attempt)) >> U64(8)).astype(np.int64) % bins
        found = full[row, donor]
        sketch[row[found], hole[found]] = sketch[row[found], donor[found]]
        row, hole = row[~found], hole[~found]
    return sketch


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` bins; bands never share keys."""
    n, bins = sketch.shape
    bands = bins // rows
    out = np.zeros((n, bands), U64)
    for r in range(rows):
        out = mix(out * U64(0xD1342543DE82EF95) + sketch[:, r : bands * rows : rows])
    return mix(out + np.arange(1, bands + 1, dtype=U64) * U64(0x2545F4914F6CDD1D))
