"""Word shingles as 64-bit hashes, vectorised over a document."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of many texts at once: 64-bit hash, first and end byte of each, and where each text's words end."""

    def __init__(self, texts: list[str], lower: bool = True):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        if lower:
            data = _LOWER[data]
        space = _SPACE[data]
        self.data = data
        self.start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        up, down = _power(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)])
        self.hash = mixed((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.stop = np.searchsorted(self.start, np.cumsum(size + 1) + 1)  # number of words up to the end of each text
        self.text = np.repeat(np.arange(len(raw)), np.diff(self.stop, prepend=0))

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.stop[i - 1] if i else 0 : self.stop[i]]

    def __iter__(self):
        return (self.of(i) for i in range(len(self.stop)))


def portions(texts, size: int = 2_000_000):
    """Lists of consecutive texts of about ``size`` characters in all, with the number of the first."""
    part, first, n = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t)
        n += len(t)
        if n >= size:
            yield first, part
            part, first, n = [], i + 1, 0
    if part:
        yield first, part


def shingles(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the windows of n words in order; of all words together if they are fewer; empty for none."""
    k = min(n, len(hashes))
    if not k:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * _MIX[i] + hashes[i : len(hashes) - k + 1 + i])
    return out
