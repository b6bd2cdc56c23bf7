"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 buffer of an Arrow string column, so that a task
never loops over characters or words in Python. A *word* is a maximal run of
ASCII letters, digits, underscores and non-ASCII characters of the lower-cased
text; words never cross documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xFF51AFD7ED558CCD)
BYTE_HASH = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x5851F42D4C957F2D
IS_WORD = np.zeros(256, bool)
IS_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    IS_WORD[_c] = True


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two 64-bit hashes."""
    t = a * M1
    t += b
    t ^= t >> U64(31)
    t *= M2
    return t


def scramble(h: np.ndarray) -> np.ndarray:
    t = h ^ (h >> U64(33))
    t *= M3
    t ^= t >> U64(29)
    return t


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: base^(done+i) = base^done * base^i
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


_POW: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POW[:] = [_powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)]
    return _POW[0], _POW[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int):
    """Row ranges of about ``limit`` bytes each (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """The words of some documents: byte spans in ``data``, hashes, and each document's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # words[first[i]:first[i+1]] are those of document i
    prefix: np.ndarray  # prefix polynomial sums, for hashes of other spans

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inv = _tables(len(self.data) + 1)
        return scramble((self.prefix[end] - self.prefix[start]) * inv[start] + (end - start).astype(np.uint64))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def words_of(column: pa.Array, ascii_only: bool = False) -> Words:
    """Words of a (chunk of a) string column; ``ascii_only`` lower-cases ASCII letters alone, which keeps all byte places."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if ascii_only:
        data, offsets = utf8(column)
        data = ASCII_LOWER[data]
    else:
        data, offsets = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(data)
    inside = IS_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inv = _tables(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * power[:n], out=prefix[1:])
    hashes = scramble((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, hashes, np.searchsorted(start, offsets), prefix)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word, and whether they lie in one document.

    A document of fewer words has one shingle, of all its words, at its first word."""
    n = len(words.hash)
    out = np.zeros(n, np.uint64)
    ok = np.zeros(n, bool)
    if n == 0:
        return out, ok
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(n)
    ok = left >= size
    m = n - size + 1
    if m > 0:
        acc = words.hash[:m] * M1
        for k in range(1, size):
            acc += words.hash[k : k + m]
            acc *= M1
        out[:m] = scramble(acc)
    counts = np.diff(words.first)
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        acc = U64(0)
        with np.errstate(over="ignore"):
            for h in words.hash[words.first[d] : words.first[d + 1]]:
                acc = (acc + h) * M1
        out[words.first[d]] = scramble(np.array([acc ^ U64(counts[d])], np.uint64))[0]
        ok[words.first[d]] = True
    return out, ok
