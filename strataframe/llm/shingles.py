"""Sets of word shingles as sorted 64-bit hashes, for many texts at a time.

Words are runs of bytes other than space and 9 to 13; A-Z count as a-z. A word's hash sums a random number for each byte
times a power for its place; a shingle's hash mixes the hashes of its words in order. Two different shingles share a hash
with probability 2^-64, which is the only way in which sets of hashes differ from sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEED = np.random.default_rng(20240117)
BYTE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
PLACE = _SEED.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GAP = np.zeros(256, dtype=bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
STEP = int(PLACE[0])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    inside = ~GAP[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    size = ends - starts
    keep = data[inside]
    heads = np.cumsum(size) - size
    place = np.arange(len(keep)) - np.repeat(heads, size)
    powers = PLACE
    if size.max() > len(powers):
        more = np.multiply.accumulate(np.full(size.max() - len(powers), STEP, np.uint64)) * np.uint64(3)
        powers = np.concatenate((powers, more))
    return mix(np.add.reduceat(BYTE[keep] * powers[place], heads) + size.astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `words` words; of all its words if they are fewer.

    A null text and one without words have none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    sizes = np.array([len(r) + 1 for r in raw])
    hashes, starts = word_hashes(data)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    factors = [np.uint64(STEP * (2 * j + 3) & (1 << 64) - 1) for j in range(words)]
    run = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j, f in enumerate(factors):
        run += mix(hashes[j : j + len(run)] * f)
    run = mix(run + np.uint64(words))
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= words:
            yield np.unique(run[a : b - words + 1])
        elif b > a:
            short = sum((mix(hashes[a + j : a + j + 1] * factors[j]) for j in range(b - a)), np.zeros(1, np.uint64))
            yield mix(short + np.uint64(b - a))
        else:
            yield run[:0]
