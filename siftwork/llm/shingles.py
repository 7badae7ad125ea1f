"""Sets of hashed word shingles, computed for many texts at a time."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, np.uint64)
_BYTE = _BYTE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse, extended as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 20)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _STEP)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BACK)]))


_powers = Powers()


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts' bytes end to end, begins and ends of the words in them, bounds of each text's words).

    Words are runs without white space.
    """
    flat = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[flat]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    return flat, starts, ends, np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))


def hashes_of_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each slice of bytes, A-Z lower-cased."""
    _powers.reach(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * _powers.up[: len(flat)], out=sums[1:])
    words = (sums[ends] - sums[starts]) * _powers.down[starts]
    return mix(words + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (runs without white space, A-Z lower-cased), and how many each text has."""
    flat, starts, ends, bounds = word_spans(texts)
    return hashes_of_spans(flat, starts, ends), np.diff(bounds)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each has.

    A text of fewer words than a shingle has one, its whole sequence; a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += hashes[k : k + n] * factors[k]
    rolled = mix(rolled)
    per_text = np.maximum(counts - words + 1, (counts > 0).astype(np.int64))
    parts = []
    for a, c in zip(starts.tolist(), counts.tolist(), strict=True):
        if c >= words:
            own = rolled[a : a + c - words + 1]
            own.sort()
            parts.append(own)
        elif c:
            own = (hashes[a : a + c] * factors[:c]).sum(keepdims=True, dtype=np.uint64)
            parts.append(mix(own ^ mix(np.full(1, c, np.uint64))))
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    text_of = np.repeat(np.arange(len(texts)), per_text)
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (text_of[1:] != text_of[:-1])
    return flat[fresh], np.bincount(text_of[fresh], minlength=len(texts)).astype(np.int64)


def set_digests(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16 bytes for each set, equal for equal sets."""
    sums = []
    for salt in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x52A9E3D7F1C60B35)):
        running = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat ^ salt), out=running[1:])
        ends = np.cumsum(counts)
        sums.append(running[ends] - running[ends - counts])
    return np.stack(sums, 1)
