"""64-bit hashes of words and word n-grams of many texts at once, over byte arrays.

Words are the runs of bytes other than space and U+0009 to U+000D. Two words or n-grams count as the same if
their 64-bit hashes are; among 10 million different ones a chance clash has a probability of about 3 in a
million.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A fixed odd value for each byte and the base of the powers, from a generator with a fixed seed.
_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_BASE = np.uint64(0x5851F42D4C957F2D)
_power = np.cumprod(np.full(64, _BASE))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        _power = np.cumprod(np.full(1 << int(n - 1).bit_length(), _BASE))
    return _power


def word_hashes(texts: Sequence[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, and where each text's words begin (one more at the end)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    text_begin = np.cumsum(sizes + 1) - sizes - 1
    counts = np.searchsorted(begin, np.append(text_begin, len(raw)))
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    length = end - begin
    letters = raw[inside]
    first = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(first, length)
    parts = _VALUE[letters] * powers(int(length.max()))[place]
    return mix(np.add.reduceat(parts, first) + length.astype(np.uint64)), counts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each of the first len(words) - n + 1 words."""
    out = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out


def in_groups(texts: Sequence[str], size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about so many characters together."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
