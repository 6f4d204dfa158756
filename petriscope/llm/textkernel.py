"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of many documents at once, as they lie in
an Arrow string column: words are found with a byte table and hashed eight bytes
at a time.  A window of words is hashed by a sum of its words' hashes times odd
coefficients of their places.  Another seed gives another hash of words and
places, so two seeds are two hashes.  No Python loop runs over words or
characters, but for words over ``LONG`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step works on; a longer document is one step.
STEP_BYTES = 1 << 20
#: Longer words are hashed one by one.
LONG = 64

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Space and the control characters from tab to carriage return end a word.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-case of A-Z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ np.uint64(seed * 0xD6E8FEB86659FD93 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64), 7)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`run_hash` reads hashes of runs."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers_to(len(values))[0], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the runs [start, end); equal runs have equal hashes."""
    inverse = _powers_to(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64), seed)


_LANES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes [start, end) of each word, eight at a time."""
    length = end - start
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(length.astype(np.uint64), 2 * seed + 101)
    todo, at = np.flatnonzero(length <= LONG), 0
    while len(todo):
        left = length[todo] - at
        h[todo] = mix(h[todo] ^ (lanes[start[todo] + at] & _LANES[np.minimum(left, 8)]), seed)
        at += 8
        todo = todo[left > 8]
    for k in np.flatnonzero(length > LONG):
        h[k] = int.from_bytes(blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def _place(k: int, seed: int) -> np.uint64:
    return mix(np.array([k], np.uint64), 2 * seed + 102)[0] | np.uint64(1)


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``width`` consecutive words, whatever documents they are of."""
    n = max(len(words) - width + 1, 0)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += words[k : k + n] * _place(k, seed)
    return mix(total, seed)


def sequence_hashes(words: np.ndarray, start: np.ndarray, count: np.ndarray, seed: int = 0) -> np.ndarray:
    """:func:`window_hashes` of runs of ``count`` words each."""
    total = count.astype(np.uint64)
    for k in range(int(count.max(initial=0))):
        some = np.flatnonzero(count > k)
        total[some] += words[start[some] + k] * _place(k, seed)
    return mix(total, seed)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, in log2(width) steps."""
    have = 1
    out = values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def steps(column: pa.Array | pa.ChunkedArray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about ``limit`` bytes.

    A null text has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of the documents in one step.

    start, end: byte positions of each word; doc: its document's place in the
    step; first: for each document, its first word (one entry more at the end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        gap = SEPARATOR[data]
        begins = ~gap
        if len(data):
            begins[1:] &= gap[:-1] | False
            edge = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[edge] = ~gap[edge]
            ends = ~gap
            ends[:-1] &= gap[1:]
            last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            ends[last] = ~gap[last]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, data: np.ndarray, seed: int = 0) -> np.ndarray:
        return word_hashes(data, self.start, self.end, seed)

    def windows(self, width: int) -> np.ndarray:
        """First words of all windows of ``width`` words inside one document."""
        if len(self.start) < width:
            return np.zeros(0, np.int64)
        i = np.arange(len(self.start) - width + 1)
        return i[self.doc[: len(i)] == self.doc[width - 1 :]]


def squeeze(texts: pa.Array) -> pa.Array:
    """Each text's UTF-8 bytes, compressed one by one; null stays null."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
    return pa.array([None if t is None else pack(t) for t in texts.cast(pa.large_binary()).to_pylist()], pa.binary())


def squeezed_steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """:func:`steps` of what :func:`squeeze` gave."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    row, held, size = 0, [], 0
    n = len(column)
    for k, z in enumerate(column):
        held.append(unpack(z.as_buffer()) if z.is_valid else b"")
        size += len(held[-1])
        if size >= limit or k == n - 1:
            yield row, k + 1, np.frombuffer(b"".join(held), np.uint8), np.r_[0, np.cumsum([len(x) for x in held])].astype(np.int64)
            row, held, size = k + 1, [], 0
