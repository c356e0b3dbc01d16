"""Words and shingles of many texts as numpy arrays of 64-bit hashes.

Hashes are position-independent sums of byte codes times powers of an odd base (mod 2^64),
mixed at the end. They come from fixed seeds, so every task names a word alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BLOCK = 1 << 20  # bytes tokenised at a time
_rng = np.random.Generator(np.random.PCG64(20240607))
CODES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | U(1)
BASES = [U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)]
INVERSES = [U(pow(int(b), -1, 1 << 64)) for b in BASES]

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


class Kept(dict):
    """What a process has computed: task functions travel with this module, but without that."""

    def __reduce__(self):
        return dict, ()


_powers: dict[tuple[int, bool], np.ndarray] = Kept()


def powers(n: int, lane: int = 0, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, kept per worker."""
    known = _powers.get((lane, inverse))
    if known is None or len(known) < n:
        size = max(BLOCK + 64, n)
        base = (INVERSES if inverse else BASES)[lane]
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= BLOCK + 64:
            _powers[lane, inverse] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(codes: np.ndarray, lane: int = 0) -> np.ndarray:
    """Sums from which any substring's hash follows; one longer than ``codes``."""
    out = np.empty(len(codes) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(codes * powers(len(codes), lane), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Mixed hashes of the stretches [start, end)."""
    return mix((sums[end] - sums[start]) * powers(len(sums), lane, True)[start])


def tokens(data: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words in bytes; memory per piece is bounded."""
    starts, ends, hashes, at, n = [], [], [], 0, len(data)
    while at < n:
        cut = min(n, at + BLOCK)
        while cut < n and not IS_SPACE[data[cut]]:  # a word is never cut
            step = IS_SPACE[data[cut:cut + BLOCK]]
            cut += int(step.argmax()) if step.any() else len(step)
        piece = data[at:cut]
        word = ~IS_SPACE[piece]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
        s, e = edge[::2], edge[1::2]
        sums = prefix_sums(CODES[lane][piece], lane)
        hashes.append(spans(sums, s, e, lane))
        starts.append(s + at)
        ends.append(e + at)
        at = cut
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``size`` bytes, or one longer text."""
    first, total = 0, 0
    for k, t in enumerate(texts):
        if k > first and total + len(t) > size:
            yield first, k
            first, total = k, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes], lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, hashes of its words) for each text."""
    for first, last in blocks(texts):
        data = np.frombuffer(b" ".join(texts[first:last]) + b" ", dtype=np.uint8)
        if lower:
            data = TO_LOWER[data]
        starts, _, hashes = tokens(data)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[first:last]])
        bound = np.searchsorted(starts, begin)
        for k in range(last - first):
            yield first + k, hashes[bound[k]:bound[k + 1]]


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for j in range(size):
        total = (total + hashes[j:n - size + 1 + j]) * BASES[1]
    return mix(total + U(size))


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null is empty."""
    import pyarrow as pa

    return [x.as_buffer().to_pybytes() if x.is_valid else b""
            for x in column.cast(pa.large_binary())]
