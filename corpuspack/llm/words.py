"""Vectorised word hashing over Arrow text batches, for operators that run Python inside tasks.

Words are the runs of bytes outside ``0x20`` and ``0x09-0x0D``. Those bytes never occur inside
a multi-byte UTF-8 character, so the words of a text are found on its bytes, and a whole batch is
hashed with a few numpy passes. Batches are cut into chunks of about ``CHUNK_BYTES`` so that the
working arrays stay small; one longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuspack.llm.common import worker_cache

CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _table(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z take the values of a-z."""
    byte = np.arange(256, dtype=np.uint64)
    if lower:
        byte[65:91] += _U(32)
    return mix((byte + _U(1)) * _U(0xD1342543DE82EF95))


_TABLES = {k: _table(k) for k in (False, True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    kept = worker_cache().get("powers")
    if kept is None or len(kept[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        kept = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            kept.append(np.multiply.accumulate(a))
        if size <= CHUNK_BYTES * 16:  # a very long text's are not kept
            worker_cache()["powers"] = kept
    return kept[0][:n], kept[1][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as its bytes and ``n + 1`` byte offsets; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each (a longer row alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and ``n + 1`` offsets into them by row."""
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = True
        np.logical_not(word[:-1], out=before[1:])
        before |= edge[:-1]
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        after[-1] = True
        np.logical_not(word[1:], out=after[:-1])
        after |= edge[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (a polynomial over prefix sums, then mixed)."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[lower][raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in reading order, and ``n + 1`` offsets into them by row."""
    starts, ends, rows = word_spans(raw, offsets)
    return hash_spans(raw, starts, ends, lower), rows


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)


def shingle_sets(words: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of ``width`` words by row, each row's ascending.

    A row with fewer words has its whole sequence as its one shingle; without words, none.
    """
    n_rows = len(rows) - 1
    counts = np.diff(rows)
    total = max(0, len(words) - width + 1)
    rolled = np.full(total, _U(width), dtype=np.uint64)
    for j in range(width):
        rolled += words[j : j + total] * _STEPS[j]
    rolled = mix(rolled)
    out, sizes = [], np.zeros(n_rows, dtype=np.int64)
    for i in range(n_rows):
        if counts[i] >= width:
            own = np.sort(rolled[rows[i] : rows[i + 1] - width + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif counts[i]:
            w = words[rows[i] : rows[i + 1]]
            own = mix(np.array([(w * _STEPS[: len(w)]).sum() + _U(len(w))], dtype=np.uint64))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.append(0, np.cumsum(sizes))
