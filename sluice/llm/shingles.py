"""Word shingles of whole texts as 64-bit hashes, by numpy over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

#: Bytes that end a word: space and 0x09-0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, n at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers[0], _powers[1]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off is not None and off.size else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off


def _chunks(off: np.ndarray, most: int):
    """Ranges of texts of about ``most`` bytes; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


#: Texts of a column that are copied at a time.
ROWS = 500


def shingle_sets(column, k: int, most: int = 1 << 17):
    """Yields, for each text, the sorted distinct hashes of its ``k``-word shingles. A text of fewer words has its
    whole sequence as its one shingle; one without words (or null) has none. A-Z count as a-z."""
    for i in range(0, len(column), ROWS):
        yield from _sets_of(column.slice(i, ROWS), k, most)


def _sets_of(column, k: int, most: int):
    data, off = buffers(column)
    for i, j in _chunks(off, most):
        a, b = int(off[i]), int(off[j])
        raw = data[a:b]
        starts_at = off[i : j + 1] - a
        n = b - a
        if n == 0:
            for _ in range(i, j):
                yield np.zeros(0, np.uint64)
            continue
        word = ~_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[starts_at] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = word[:-1]
        first = np.flatnonzero(word & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = word[1:]
        last = np.flatnonzero(word & (~after | edge[1:])) + 1
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[raw] * power[:n], out=total[1:])
        w = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64) * _COEF[63])
        count = np.searchsorted(first, starts_at)
        if len(w) >= k:
            s = w[: len(w) - k + 1] * _COEF[0]
            for q in range(1, k):
                s = s + w[q : len(w) - k + 1 + q] * _COEF[q]
            s = mix(s)
        for d in range(j - i):
            p, q = int(count[d]), int(count[d + 1])
            if q - p >= k:
                yield np.unique(s[p : q - k + 1])
            elif q > p:
                yield mix((w[p:q] * _COEF[: q - p]).sum(keepdims=True, dtype=np.uint64) + np.uint64(q - p))
            else:
                yield np.zeros(0, np.uint64)
