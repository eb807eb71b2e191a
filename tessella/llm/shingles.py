"""Word shingles as 64-bit fingerprints, computed over whole Arrow columns of text.

Words are runs of anything but space and the controls tab to carriage return,
after lower-casing A-Z. A word's fingerprint is a polynomial over its bytes and a
shingle's mixes those of its words. A text with fewer words than a shingle has its
whole sequence as one; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_GROUP = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if n <= _GROUP:
        if not _powers:
            _powers.extend(_raised(_GROUP))
        return _powers[0][:n], _powers[1][:n]
    return tuple(_raised(n))


def _raised(n: int) -> list[np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    out = []
    for base in (_BASE, inverse):
        a = np.full(n, base, dtype=np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    return out


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, document) of each word of the documents that begin at these places of the bytes."""
    n = len(data)
    up, down = _power(n)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(bounds, starts, side="right") - 1


def _long_words(data: np.ndarray) -> np.ndarray:
    """The words of one long document, read in pieces that end at a space."""
    found, lo, n = [], 0, len(data)
    while lo < n:
        hi, near = min(n, lo + _GROUP), lo
        while hi < n and not (spaces := np.flatnonzero(_SPACE[data[near:hi]])).size:
            near, hi = hi, min(n, hi + _GROUP)  # a word longer than a piece
        if hi < n:
            hi = near + int(spaces[-1]) + 1
        found.append(_words(data[lo:hi], np.zeros(1, dtype=np.int64))[0])
        lo = hi
    return np.concatenate(found)


def _group(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of the documents that begin at these places of the bytes."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(bounds) == 1 and len(data) > _GROUP:
        words = _long_words(data)
        own = np.zeros(len(words), dtype=np.int64)
    else:
        words, own = _words(data, bounds)
    m = len(words) - k + 1
    whole = np.zeros(0, dtype=bool)
    h, at = np.empty(0, np.uint64), np.empty(0, np.int64)
    if m > 0:
        whole = own[:m] == own[k - 1 :]
        h = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            h += words[j : j + m] * _ORDER[j]
        h, at = mixed(h[whole]), own[:m][whole]
    counts = np.bincount(own, minlength=len(bounds))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(own, short)
        extra = [mixed(np.array([sum(int(words[f + j]) * int(_ORDER[j]) for j in range(c)) + int(_ORDER[32 + c]) & (2**64 - 1)], dtype=np.uint64))[0] for f, c in zip(first.tolist(), counts[short].tolist(), strict=True)]
        h, at = np.concatenate([h, np.array(extra, dtype=np.uint64)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return at, h


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its distinct shingles in ascending order."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * n
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _GROUP, side="right")) - 1)
        at, h = _group(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1][:-1] - offsets[lo] if hi > lo else offsets[lo:hi], k)
        if len(at):
            cuts = np.flatnonzero(np.diff(at)) + 1
            for i, own in zip(at[np.concatenate([[0], cuts])].tolist(), np.split(h, cuts), strict=True):
                out[lo + i] = np.unique(own)
        lo = hi
    return out
