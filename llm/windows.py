"""Anchored windows: which fixed-length windows of a token sequence may repeat, and where.

A document is a sequence of 64-bit token values. Every window of ``size`` tokens holds
``size - k + 1`` k-grams; the rightmost k-gram of least hash is its *anchor*. The anchor depends
on the window's content alone, so equal windows have equal anchors, and only windows whose anchor
occurs more than once need a look. A *context* is the stretch of text covered by consecutive
windows that share one anchor occurrence.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Tokens of a text that are hashed at once; longer texts go in overlapping segments.
SEGMENT = 1 << 20
_POSITION = np.uint64((1 << 24) - 1)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 4096), base, np.uint64)
        factors[0] = 1
        _powers[base] = have = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(tokens: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``spans`` takes the hash of any stretch."""
    out = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * _power(_BASE, len(tokens)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end), independent of where they lie."""
    raw = (sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every ``width`` consecutive ones."""
    n = len(keys)
    if width < 64:
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            keys = np.minimum(keys[:len(keys) - step], keys[step:])
            reach += step
        return keys
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def _grams(sums: np.ndarray, k: int) -> np.ndarray:
    return mix((sums[k:] - sums[:-k]) * _power(_INVERSE, len(sums) - k))


def _keys(grams: np.ndarray) -> np.ndarray:
    """Keys that order k-grams by hash, the rightmost first among equals; the position is in the low bits."""
    return (grams & ~_POSITION) | (_POSITION - np.arange(len(grams)).astype(np.uint64))


def contexts(tokens: np.ndarray, size: int, k: int):
    """(anchor hash, context hash, first window, last window) of every anchor occurrence, as arrays."""
    parts = [_contexts(tokens[i:i + SEGMENT + size - 1], size, k, i)
             for i in range(0, max(1, len(tokens) - size + 1), SEGMENT)]
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


#: Tokens of short texts that are hashed in one go.
TOGETHER = 1 << 17


def contexts_of(texts: list[np.ndarray], size: int, k: int):
    """(text number, anchor hash, context hash, first window, last window) of all texts, as arrays in order."""
    parts, some, total = [], [], 0
    for i, tokens in enumerate(texts):
        if some and total + len(tokens) > TOGETHER:
            parts.append(_together(texts, some, size, k))
            some, total = [], 0
        if len(tokens) > TOGETHER:
            found = contexts(tokens, size, k)
            parts.append((np.full(len(found[0]), i), *found))
        elif len(tokens) >= size:
            some.append(i)
            total += len(tokens)
    if some:
        parts.append(_together(texts, some, size, k))
    if not parts:
        return (np.zeros(0, np.int64), *_contexts(np.zeros(0, np.uint64), size, k, 0))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def _together(texts: list[np.ndarray], some: list[int], size: int, k: int):
    """Contexts of several texts from one joined array; windows across two texts are left out."""
    lengths = np.array([len(texts[i]) for i in some])
    starts = np.cumsum(lengths) - lengths
    tokens = np.concatenate([texts[i] for i in some])
    n = len(tokens) - size + 1
    sums = prefix(tokens)
    grams = _grams(sums, k)
    anchor = (_POSITION - (_least(_keys(grams), size - k + 1) & _POSITION)).astype(np.int64)
    inside = np.ones(n + size - 1, bool)
    for end in (starts + lengths).tolist():
        inside[end - size + 1:end] = False
    inside = inside[:n]
    begins = inside.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    begins[starts] = True  # an anchor of one text may be that of the last window before it
    first = np.flatnonzero(begins)
    stops = np.append(first[1:], n)
    text = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(stops, (starts + lengths - size + 1)[text]) - 1
    return (np.array(some)[text], grams[anchor[first]], spans(sums, first, last + size),
            first - starts[text], last - starts[text])


def _contexts(tokens: np.ndarray, size: int, k: int, offset: int):
    n = len(tokens) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = prefix(tokens)
    grams = _grams(sums, k)
    keys = _keys(grams)
    anchor = (_POSITION - (_least(keys, size - k + 1) & _POSITION)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], n) - 1
    return grams[anchor[first]], spans(sums, first, last + size), first + offset, last + offset


def anchor_of(window: np.ndarray, k: int) -> int:
    """Position of the anchor in one window."""
    return int(_keys(_grams(prefix(window), k)).argmin())
