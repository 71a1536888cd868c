"""Words of whole texts as 64-bit hashes, cut and hashed for many texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well mixed bijection of 64-bit values."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(table: np.ndarray, step: int, n: int) -> np.ndarray:
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(step, len(table), 1 << 64))])
    return table


_pow = _inv = np.ones(1, np.uint64)


def _cut(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in data; no word crosses a position in breaks."""
    global _pow, _inv
    _pow, _inv = _grow(_pow, _BASE, len(data) + 1), _grow(_inv, _INVERSE, len(data) + 1)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[breaks] = inside[breaks]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[breaks[breaks > 0] - 1] = inside[breaks[breaks > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _pow[: len(data)], out=sums[1:])
    with np.errstate(over="ignore"):
        hashes = mix((sums[ends] - sums[starts]) * _inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return starts, ends, hashes


def _long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One text of any length, in pieces that end at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not (gaps := np.flatnonzero(SPACE[data[at:end]])).size:
            end = min(len(data), end + PIECE)
        if end < len(data):
            end = at + int(gaps[-1]) + 1
        s, e, h = _cut(data[at:end], np.zeros(1, np.int64))
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def words(texts: pa.Array, spans: bool = False):
    """For each text its words' hashes, or (starts, ends, hashes) in bytes if spans.

    Words are runs of bytes other than space and \\t to \\r, A-Z lower-cased. A null text
    has none. Texts are worked off in pieces of about 256 kB, so memory does not grow with
    the batch, and a longer text is cut at white space.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    none = np.zeros(0, np.uint64)
    i = 0
    while i < n:
        if offs[i + 1] - offs[i] > PIECE:
            s, e, h = _long(data[offs[i] : offs[i + 1]])
            yield (s, e, h) if spans else h
            i += 1
            continue
        k = i + 1
        while k < n and offs[k + 1] - offs[i] <= PIECE:
            k += 1
        base = int(offs[i])
        rel = offs[i : k + 1] - base
        piece = data[base : base + int(rel[-1])]
        if not len(piece):
            for _ in range(i, k):
                yield (none, none, none) if spans else none
        else:
            s, e, h = _cut(piece, rel[:-1][rel[:-1] < len(piece)])
            cuts = np.searchsorted(s, rel)
            for d in range(k - i):
                a, b = cuts[d], cuts[d + 1]
                yield (s[a:b] - rel[d], e[a:b] - rel[d], h[a:b]) if spans else h[a:b]
        i = k


def shingles(hashes: np.ndarray, size: int, whole: bool = True) -> np.ndarray:
    """Hashes of the runs of `size` words; with fewer words the whole sequence as one (if whole)."""
    n = len(hashes)
    if n == 0 or (n < size and not whole):
        return np.zeros(0, np.uint64)
    width = min(size, n)
    out = np.full(n - width + 1, 0x51_7CC1B7 + width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix(out * np.uint64(_BASE) + hashes[k : n - width + 1 + k])
    return out
