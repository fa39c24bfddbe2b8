"""Word shingles of texts as 64-bit hashes, computed on whole byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20_240_607)
#: A random 64-bit value for each byte; A-Z share those of a-z.
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
SHINGLE = 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, A-Z lower-cased: a sum of byte values by place."""
    b = np.frombuffer(raw, np.uint8)
    word = _IS_WORD[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = stops - starts
    flat = b[word]
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(flat)) - np.repeat(first, length)
    return _mix(np.add.reduceat(_BYTE[flat] * _powers(int(length.max()))[place], first) + length.astype(np.uint64) * _Q)


def shingle_set(raw: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's `width`-word shingles; of the whole sequence if it is shorter; none without words."""
    w = word_hashes(raw or b"")
    if not len(w):
        return w
    n = min(width, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = h * _P + w[k : k + len(h)]
    return np.unique(_mix(h + np.uint64(n * int(_Q) % 2**64)))


#: Multipliers and offsets of the MinHash functions x -> a*x + b mod 2**32.
HASHES = 512
_A = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima over a non-empty set; sets of any size are read in slices that fit a cache."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (x[at : at + 256, None] * _A + _B).min(0), out=out)
    # the minima are close to 0: scatter them so that their low bits can be compared alone
    return (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of `rows` minima."""
    m = minima.reshape(-1, rows).astype(np.uint64)
    h = np.arange(len(m), dtype=np.uint64) * _Q
    for k in range(rows):
        h = _mix(h * _P + m[:, k] + np.uint64(1))
    return h.view(np.int64)


def runs(batches: Iterator, keys: list[str]) -> Iterator[list[dict]]:
    """Rows of sorted Arrow batches, gathered by equal keys over batch ends."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held
