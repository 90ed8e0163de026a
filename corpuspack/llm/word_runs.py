"""Operator 13: periodic runs of words by online dyadic square catching.

A square is a stretch of words followed by itself. ``SquareCatcher`` reads words as they are appended and
keeps a catcher for every completed block of ``2**k`` words: it watches for the block to return at a
distance from ``2 * 2**k`` up to ``4 * 2**k`` words (from one word for single words). Every square of
period ``q`` holds a block of the level with ``2 * 2**k <= q < 4 * 2**k`` in its first half (blocks of one
word for a period of one), so no square escapes. Where a block returns, suffix comparisons reach out to
both sides, in steps that are powers of two; those that reach the last word stay open and go on with the
next words. Squares of one period that touch are one stretch of equal words at that distance, which is a
run as soon as it is as long as the period. Of the periods of one run only the smallest is kept.

Blocks are compared by 64-bit names, each made of the names of its two halves, so equal blocks have equal
names and the structure of a text cannot make different ones meet; the words' own numbers are exact.
Each appended word costs work and memory of the order of the logarithm of the words read, however
repetitive the text is. Appending word by word or all at once gives the same runs (tested).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.words import mix

#: The shortest run (words); a run is never shorter than two periods either.
LEAST_WORDS = 12
#: Words that share a catcher, for documents shorter than that; a longer one has a catcher of its own.
CHUNK_WORDS = 1 << 16
#: Bytes of a comparison matrix at most, unless one block's row alone is longer.
MATRIX_BYTES = 1 << 22
#: Names above this level are not kept for suffix comparisons, which then take steps of this level.
STEP_LEVEL = 12
_U = np.uint64
_LEFT, _RIGHT = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


class SquareCatcher:
    """Runs of a growing sequence of word numbers.

    ``longest`` bounds the length of a run where the caller knows one (documents parted by words of their
    own); it only saves work.
    """

    def __init__(self, longest: int | None = None, least: int = LEAST_WORDS):
        self.n = 0
        self.longest, self.least = longest, least
        self._names: list[np.ndarray] = [np.zeros(0, np.uint64)]
        none = np.zeros(0, np.int64)
        self._open = (none, none)  # period and start of the stretches that reach the last word
        self._closed: list[np.ndarray] = []

    def _grow(self, words: np.ndarray) -> None:
        self.n += len(words)
        top = self.n if self.longest is None else min(self.n, self.longest)
        fresh = mix(words.astype(np.uint64) + _U(1)) | _U(1)
        self._names[0] = np.concatenate([self._names[0], fresh])
        k = 1
        while 4 << k <= top:
            half, below = 1 << (k - 1), self._names[k - 1]
            if k == len(self._names):
                self._names.append(np.zeros(0, np.uint64))
            done = len(self._names[k])
            left, right = below[done : len(below) - half], below[done + half :]
            self._names[k] = np.concatenate([self._names[k], mix(left * _LEFT + right * _RIGHT + _U(k)) | _U(1)])
            k += 1

    def _reach(self, at: np.ndarray, period: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it) equal those ``period`` words later."""
        start = at
        at = at.copy()
        top = min(len(self._names) - 1, STEP_LEVEL)
        for k in range(top, -1, -1):
            names, step = self._names[k], 1 << k
            live = np.arange(len(at))
            while len(live):
                low = at[live] if forward else at[live] - step
                high = low + period[live]
                inside = (high < len(names)) if forward else (low >= 0)
                low, high, live = low[inside], high[inside], live[inside]
                same = names[low] == names[high]
                live = live[same]
                at[live] += step if forward else -step
                if k < top:
                    break
        return np.abs(at - start)

    def _returns(self, k: int, old: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of level ``k`` that return with the words after the first ``old``: the first block of each
        chain of neighbours that return at one distance, as start and distance."""
        names, block = self._names[k], 1 << k
        first, width = (1, 3) if k == 0 else (2 * block, 2 * block)
        j = max(0, (old - 5 * block + block) // block)  # blocks whose last comparison ended before are through
        found_j, found_d = [], []
        view = np.lib.stride_tricks.sliding_window_view(names, width)[first::block] if len(names) >= first + width else names[:0].reshape(0, 1)
        rows = max(1, MATRIX_BYTES // width)
        while j < len(view):
            part = view[j : j + rows]
            heads = names[j * block : (j + len(part) - 1) * block + 1 : block]
            a, d = np.nonzero(part == heads[:, None])
            found_j.append(a + j)
            found_d.append(d + first)
            j += len(part)
        while j * block + first < len(names):  # the last few blocks, whose distances are not all there yet
            d = np.flatnonzero(names[j * block + first : j * block + first + width] == names[j * block])
            found_j.append(np.full(len(d), j))
            found_d.append(d + first)
            j += 1
        if not found_j:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        j, d = np.concatenate(found_j).astype(np.int64), np.concatenate(found_d).astype(np.int64)
        due = j * block + d + block > old
        j, d = j[due], d[due]
        order = np.lexsort((j, d))
        j, d = j[order], d[order]
        heads = np.ones(len(j), dtype=bool)
        heads[1:] = (d[1:] != d[:-1]) | (j[1:] != j[:-1] + 1)
        return j[heads] * block, d[heads]

    def append(self, words: np.ndarray) -> None:
        old = self.n
        self._grow(np.asarray(words))
        if self.n == old:
            return
        periods, starts = [self._open[0]], [self._open[1]]
        ends = [old - self._open[0] + self._reach(old - self._open[0], self._open[0], True)]
        for k in range(len(self._names)):
            at, period = self._returns(k, old)
            if len(at):
                periods.append(period)
                starts.append(at - self._reach(at, period, False))
                ends.append(at + self._reach(at, period, True))
        period, start, end = np.concatenate(periods), np.concatenate(starts), np.concatenate(ends)
        _, one = np.unique(period * (self.n + 1) + start, return_index=True)  # a stretch is known by period and start
        period, start, end = period[one], start[one], end[one]
        still = end + period == self.n
        self._open = (period[still], start[still])
        self._closed.append(self._runs(period[~still], start[~still], end[~still]))

    def _runs(self, period: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The runs among stretches, as rows ``start, length, smallest period``."""
        length = end - start + period
        good = (end - start >= period) & (length >= self.least)
        period, start, length = period[good], start[good], length[good]
        order = np.lexsort((period, length, start))
        rows = np.stack([start, length, period], axis=1)[order]
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        return rows[first]

    def runs(self) -> np.ndarray:
        """All runs of the words so far, by start, then period: rows ``start, length, period``."""
        period, start = self._open
        rows = np.concatenate([*self._closed, self._runs(period, start, self.n - period), np.zeros((0, 3), np.int64)])
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 (no other byte of a text counts as a space)."""
    return (text or "").encode().split()


def with_planted_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's edit: one document in ten becomes periodic from some word on (never one without an id)."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def runs_of_documents(documents: list[list[bytes]], least: int = LEAST_WORDS) -> list[np.ndarray]:
    """The runs of each list of words, through one catcher with a border of its own behind each document."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(d) + 1 for d in documents], dtype=np.int64)
    starts = np.append(0, np.cumsum(sizes))
    stream = np.empty(starts[-1], dtype=np.int64)
    for i, words in enumerate(documents):
        stream[starts[i] : starts[i + 1] - 1] = [numbers.setdefault(w, len(numbers)) for w in words]
    stream[starts[1:] - 1] = len(numbers) + np.arange(len(documents))
    catcher = SquareCatcher(longest=int(sizes.max()), least=least)
    catcher.append(stream)
    rows = catcher.runs()
    cuts = np.searchsorted(rows[:, 0], starts)
    return [rows[a:b] - [s, 0, 0] for a, b, s in zip(cuts[:-1], cuts[1:], starts[:-1])]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains behind its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


COLUMNS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def _report(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist()).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()
    if not len(runs):
        return doc_id, 0, None, None, None, None, digest, kept
    s, n, p = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
    return doc_id, len(runs), s, n, p, 1000 * n // p, digest, kept


def periodic_runs(docs: DataFrame, planted: bool = False, least: int = LEAST_WORDS) -> DataFrame:
    """The runs of each document, a row for each row of ``docs``: the columns of ``COLUMNS``.

    ``start, length, period`` are those of the longest run (ties: the first one, then the smallest period),
    null without a run. ``planted`` applies ``with_planted_period`` first. Null and empty texts have no words:
    no run, and the digests of the empty string. Whole texts of any length are read, a long one in a catcher
    of its own. A null ``doc_id`` stays null; repeated rows give their rows again; other columns are ignored; an
    empty table gives no rows. No row is moved: documents are read where they are.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.int64()] * 6, pa.string(), pa.string())
        names = [c.split()[0] for c in COLUMNS.split(", ")]

        def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            rows = [_report(i, w, r) for i, w, r in zip(ids, texts, runs_of_documents(texts, least))]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

        ids: list = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                words = words_of(batch.column(1)[i].as_py())
                if planted:
                    words = with_planted_period(words, doc_id)
                if texts and held + len(words) > CHUNK_WORDS:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words) + 1
        if texts:
            yield flush(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, COLUMNS)
