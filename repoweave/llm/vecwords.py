"""Vectorised word splitting and hashing over whole Arrow batches.

A batch of texts is one flat byte buffer; words are found and hashed with a
few numpy passes over that buffer, never one Python step per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Texts are gone through so many bytes at a time: the arrays over a chunk take some forty times that.
CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are maximal runs of bytes outside the ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are maximal runs of digits, a-z and bytes beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.ones(max(n, CHUNK_BYTES + 1), np.uint64)
        size = 1
        while size < len(out):
            step = np.uint64(pow(base, size, 1 << 64))
            out[size : 2 * size] = out[: len(out[size : 2 * size])] * step
            size *= 2
        _powers[name] = have = out
    return have


def chunks(texts: pa.Array, most: int = CHUNK_BYTES, fold: np.ndarray = LOWER):
    """(first row, last row + 1, bytes folded (A-Z lower-cased), offsets) of about `most` bytes; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, fold[data[offsets[at] : offsets[to]]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Starts, ends and documents of the words of kind in the buffer."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power("up", _BASE, len(data))[: len(data)], out=total[1:])
    at = _power("down", _INVERSE, len(data))[starts]
    return mix((total[ends] - total[starts]) * at + (ends - starts).astype(np.uint64))


_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def joined(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, by its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out + words[k : n + k] * _FACTORS[k % 64])
    return out


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, by its first word, with a few passes whatever the width."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power("up", _BASE, len(words))[: len(words)], out=total[1:])
    return mix((total[width:] - total[:-width]) * _power("down", _INVERSE, len(words))[:n] + np.uint64(width))


def shingle_sets(hashed: np.ndarray, owner: np.ndarray, n_docs: int, width: int):
    """The sorted distinct shingles of each document, flat, and their bounds.

    A document of fewer words than `width`, but not none, has one shingle, its
    whole sequence.
    """
    bounds = np.searchsorted(owner, np.arange(n_docs + 1))
    runs = joined(hashed, width)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(runs[a : b - width + 1]))
        else:
            sets.append(joined(hashed[a:b], b - a) if b > a else runs[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else runs[:0]), np.concatenate(([0], np.cumsum(sizes)))
