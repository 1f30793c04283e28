"""Word-shingle kernel: 64-bit shingle sets and grouped minhash values in numpy.

Words are runs of anything but the six ASCII spaces (``bytes.split`` splits on
exactly those), lower-cased over A-Z only.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5

_U = np.uint64
#: One odd multiplier per word position of a shingle, by splitmix64 from a fixed start.
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def constants(n: int, start: int) -> np.ndarray:
    """n odd pseudo-random 64-bit constants, the same on every machine."""
    with np.errstate(over="ignore"):
        seq = (np.arange(1, n + 1, dtype=np.uint64) + _U(start)) * _U(0x9E3779B97F4A7C15)
        return _splitmix(seq) | _U(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POSITION = constants(WIDTH, 11)
_LENGTH = constants(WIDTH + 1, 77)


#: A word's hash is a polynomial of its bytes' random values, modulo 2**64, taken from prefix sums.
_BYTE = constants(256, 3001)
_BASE = constants(1, 4001)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = _U(pow(int(_BASE[0]), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE[0]), ("down", inverse)):
                _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base)]), dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each word of the bytes, in order."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ~_SPACE[data], [0]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
        return _splitmix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text; below five words
    the whole sequence is one shingle; null, empty or blank text: empty."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.empty(0, np.uint64)
    n = len(w)
    if not n:
        return w
    with np.errstate(over="ignore"):
        if n < WIDTH:
            return _splitmix((w * _POSITION[:n]).sum(dtype=np.uint64, keepdims=True) + _LENGTH[n])
        h = w[: n - WIDTH + 1] * _POSITION[0]
        for k in range(1, WIDTH):
            h += w[k : n - WIDTH + 1 + k] * _POSITION[k]
        return np.unique(_splitmix(h))


def minhashes(sets: list[np.ndarray], multipliers: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """(len(sets), len(multipliers)) minima of seeded hashes over each nonempty set."""
    out = np.zeros((len(sets), len(multipliers)), np.uint64)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(sets):
            j, size = i, 0
            while j < len(sets) and (j == i or size + len(sets[j]) <= chunk):
                size += len(sets[j])
                j += 1
            flat, starts = np.concatenate(sets[i:j]), np.cumsum([0, *map(len, sets[i : j - 1])])
            for k, m in enumerate(multipliers):
                out[i:j, k] = np.minimum.reduceat((flat ^ (m >> _U(7))) * m, starts)
            i = j
    return out


def fold(values: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit key for each row of a (rows, k) matrix."""
    with np.errstate(over="ignore"):
        return _splitmix((values * constants(values.shape[1], salt)).sum(axis=1, dtype=np.uint64)).view(np.int64)


def salted(values: np.ndarray, salt: int) -> np.ndarray:
    """The values as 64-bit keys that differ from those under another salt."""
    with np.errstate(over="ignore"):
        return _splitmix(values ^ _splitmix(np.array([salt], np.int64).view(np.uint64))).view(np.int64)
