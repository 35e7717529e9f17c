"""Words and word n-grams of whole texts as 64-bit hashes, vectorised over Arrow buffers.

The helpers work on the UTF-8 bytes of a column in blocks of about a megabyte, so memory is the
text itself, eight bytes a word, and a constant. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES = {"up": _powers(_BASE, _BLOCK + 1), "down": _powers(_INVERSE, _BLOCK + 1)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES["up"]) < n:
        _TABLES["up"], _TABLES["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _TABLES["up"], _TABLES["down"]


class Alphabet:
    """Which bytes separate words; ASCII capitals count as small letters."""

    def __init__(self, separators: bytes):
        codes = np.arange(256, dtype=np.uint64)
        self.table = mix(codes, 17) | np.uint64(1)
        self.table[65:91] = self.table[97:123]
        self.separator = np.zeros(256, dtype=bool)
        self.separator[list(separators)] = True
        self.table[self.separator] = 0


#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
SPACED = Alphabet(b" \t\n\v\f\r")
#: Words are runs of ASCII letters and digits and of any other characters beyond ASCII.
ALNUM = Alphabet(bytes(c for c in range(128) if not chr(c).isalnum()))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), ends - ends[0]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Iterator[tuple[int, int]]:
    """Spans of about a block that end between words."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + _BLOCK, n)
        while end < n:
            gaps = np.flatnonzero(alphabet.separator[data[at:end]])
            row = offsets[np.searchsorted(offsets, end, side="right") - 1]
            last = max(at + int(gaps[-1]) + 1 if len(gaps) else at, int(row))
            if last > at:
                end = last
                break
            end = min(end + _BLOCK, n)
        yield at, end
        at = end


def word_hashes(
    texts: pa.Array, alphabet: Alphabet = SPACED
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every word in order, the number of words of each row, and the byte at which
    each word begins."""
    data, offsets = buffers(texts)
    hashes, begins = [], []
    for at, end in _cuts(data, offsets, alphabet):
        block = data[at:end]
        word = ~alphabet.separator[block]
        start = word.copy()
        start[1:] &= ~word[:-1]
        first, last = np.searchsorted(offsets, [at, end])
        rows = offsets[first:last] - at
        start[rows] |= word[rows]
        starts = np.flatnonzero(start)
        if len(starts):
            up, down = _power_tables(len(block) + 1)
            value = alphabet.table[block] * up[: len(block)]
            hashes.append(mix(np.add.reduceat(value, starts) * down[starts]))
            begins.append(starts + at)
    none = np.zeros(0, dtype=np.int64)
    begin = np.concatenate(begins) if begins else none
    found = np.concatenate(hashes) if hashes else none.astype(np.uint64)
    return found, np.diff(np.searchsorted(begin, offsets)), begin


def shingle_hashes(
    words: np.ndarray, counts: np.ndarray, width: int, whole_if_short: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each row in order and their number per row.

    A row with fewer than ``width`` words gives its whole sequence as one n-gram (or none), a row
    without words none.
    """
    ends = np.cumsum(counts)
    first = ends - counts
    n = np.maximum(counts - width + 1, 0)
    if len(words) >= width:
        size = len(words) - width + 1
        grams = np.full(size, np.uint64(width))
        for k in range(width):
            grams = mix(grams ^ words[k : k + size], k)
        inside = np.repeat(first, n) + _ranges(n)
        grams = grams[inside]
    else:
        grams = np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width)) if whole_if_short else []
    if len(short):
        value = counts[short].astype(np.uint64)
        for k in range(width - 1):
            there = counts[short] > k
            value[there] = mix(value[there] ^ words[first[short[there]] + k], k)
        at = (np.cumsum(n) - n)[short]
        grams = np.insert(grams, at, value)
        n = n.copy()
        n[short] = 1
    return grams, n


def _ranges(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1 and so on in one array."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def distinct_per_row(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in ascending order, and their number per row."""
    if not len(values):
        return values, np.zeros(len(counts), dtype=np.int64)
    values = values.copy()
    ends = np.cumsum(counts)
    for begin, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        values[begin:end].sort()
    row = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.bincount(row[new], minlength=len(counts))


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each row's values, for unsigned integers modulo 2**64."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts hold about so many bytes; a longer text stands alone."""
    sizes = np.diff(buffers(batch.column(column))[1])
    at = 0
    while at < len(sizes):
        within = np.searchsorted(np.cumsum(sizes[at:]), most_bytes, side="right")
        n = max(1, int(within))
        yield batch.slice(at, n)
        at += n
