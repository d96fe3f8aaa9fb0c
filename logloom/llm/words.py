"""Words of whole texts as 64-bit hashes, an Arrow batch at a time, without a Python object per word.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case. A word's hash is a
polynomial over a fixed random value per byte, from one cumulative sum over the batch's own buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_OCTETS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_OF_LOWER = _OCTETS[LOWER]
#: Bytes of text that are hashed at once; a longer text is hashed alone.
AT_ONCE = 1 << 20
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose result bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if len(_powers["up"]) < n:
        n = max(n, AT_ONCE + 1)
        for k, b in (("up", _B), ("down", _B_INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def slices(batch: pa.RecordBatch, column: int, at_once: int = AT_ONCE):
    """(slice of the batch, bytes of its texts, offsets) of about ``at_once`` bytes each. Null is empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    octets = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + at_once, "right")) - 1)
        j = min(j, len(texts))
        yield batch.slice(i, j - i), octets[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text (and the end) the index of its first word."""
    n = len(octets)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[octets]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_OF_LOWER[octets] * up[:n], out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int):
    """For each text the hashes of its ``size``-word shingles, in order; a shorter text is one shingle."""
    factors = np.cumprod(np.full(size, 0xD6E8FEB86659FD93, np.uint64))
    n = len(hashes) - size + 1
    every = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        every += hashes[k : k + n] * factors[k]
    every = mix(every)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= size:
            yield every[a : b - size + 1]
        elif b > a:
            short = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], np.uint64))
        else:
            yield hashes[:0]
