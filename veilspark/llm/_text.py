"""Words and window hashes of many texts at once, on UTF-8 bytes in numpy.

A chunk is a run of whole documents. Words never cross documents. The hash of a word is a polynomial over
random 64-bit byte codes, taken from one running sum per chunk, so the cost is a few passes over the bytes
whatever the number of words. Window hashes are built the same way over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 60_000

_rng = np.random.default_rng(20240117)
_CODES = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
#: A second family, for checks of what the first finds equal.
_CHECK_CODES = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)
_CHECK_BASE = 0xA0761D6478BD642F


def _lowered(codes: np.ndarray) -> np.ndarray:
    out = codes.copy()
    out[65:91] = codes[97:123]
    return out


_LOWER_CODES, _LOWER_CHECK_CODES = _lowered(_CODES), _lowered(_CHECK_CODES)

#: Word separators: white space bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Word separators once A-Z are lower-cased: every ASCII byte that is no letter and no digit.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class _Powers:
    """base**i and its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            made = []
            for b in (self.base, self.inverse):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                made.append(np.multiply.accumulate(a))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _CHECK_BYTES = _Powers(_BASE), _Powers(_WORD_BASE), _Powers(_CHECK_BASE)


@dataclass
class Chunk:
    """Whole documents: their bytes and where each begins; first and last are row numbers of the batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int
    last: int


@dataclass
class Words:
    """start and end are byte positions in the chunk; doc counts from the chunk's first row."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    per_doc: np.ndarray  # index of each document's first word, and the number of words at the end


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Null texts count as empty. A single text above the limit is a chunk of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + CHUNK_ROWS, len(column))
        yield Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, j)
        i = j


def words(chunk: Chunk, separators: np.ndarray, lower: bool) -> Words:
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    inside = ~separators[data]
    after = np.zeros(n + 1, bool)  # is the byte before a word byte of the same document
    after[1:] = inside
    after[offsets[:-1]] = False
    start = np.flatnonzero(inside & ~after[:n])
    before = np.zeros(n + 1, bool)  # is the byte after one
    before[:n] = inside
    before[offsets] = False
    end = np.flatnonzero(inside & ~before[1:]) + 1
    hashes = _word_hashes(data, start, end, _LOWER_CODES if lower else _CODES, _BYTES)
    per_doc = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(per_doc))
    return Words(start, end, doc, hashes, per_doc)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray, powers: _Powers) -> np.ndarray:
    n = len(data)
    up, down = powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def checked(chunk: Chunk, w: Words, lower: bool) -> Words:
    """The same words with hashes of the second family: what agrees in both families is equal but for 2**-128 a pair."""
    hashes = _word_hashes(chunk.data, w.start, w.end, _LOWER_CHECK_CODES if lower else _CHECK_CODES, _CHECK_BYTES)
    return Words(w.start, w.end, w.doc, hashes, w.per_doc)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the size words from each position, and whether they all lie in one document."""
    n = len(w.hash)
    m = n - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = _WORDS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * up[:n], out=sums[1:])
    hashes = mix((sums[size:] - sums[:m]) * down[:m] + U64(size))
    return hashes, w.doc[size - 1 :] == w.doc[:m]


def span_hash(w: Words, first: int, last: int) -> int:
    """What windows() gives for words first to last - 1."""
    up, down = _WORDS.get(last - first + 1)
    with np.errstate(over="ignore"):
        total = np.sum(w.hash[first:last] * up[: last - first], dtype=np.uint64)
    return int(mix(np.array([total + U64(last - first)], np.uint64))[0])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return (np.minimum(out[: len(out) - rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out


def release() -> None:
    """Give freed memory back to the system, as the Python worker lives on beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        _trim(0)
    except (OSError, AttributeError):
        pass


def _trim(pad: int) -> None:
    import ctypes

    ctypes.CDLL(None).malloc_trim(pad)


def by_doc(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Order by document, then value; documents number below 65,536."""
    order = np.argsort(values)
    return order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
