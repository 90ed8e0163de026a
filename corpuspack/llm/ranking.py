"""Operator 7: a quality classifier from Bradley-Terry pairwise ranking.

A text is a vector of statistics. A preference pair is a text labelled good and one labelled bad; the
model learns weights such that ``sigmoid(w . (good - bad))`` is the probability that the good one wins, by
the logistic loss on feature differences. A document's merit is ``w . features``; the threshold is the
quantile of the training merits at the share of bad texts, and the score is the logistic function of
the distance from it.

Fitting uses at most ``MAX_ROWS`` labelled rows (by a hash of ``doc_id``) and ``PAIRS`` pairs of them. All
texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm import words as W
from corpuspack.llm.toxicity import held_out, training_rows

MAX_ROWS = 30_000
PAIRS = 60_000
FOLDS, HELD_OUT = 3, 1

FEATURES = (
    "log_words", "log_lines", "mean_word", "spread_word", "symbols", "marks", "capitals", "digits", "others",
    "adjacent_repeats", "repeated_words", "repeated_windows", "repeated_lines", "symbol_endings", "bars", "short_lines", "sentence_ends",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.float64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOLS, _MARKS, _DIGITS = _class("#*$%&|<>@^~_=+{}[]\\/"), _class("!?"), _class("0123456789")
_CAPITALS, _ENDS, _FIRST = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(".!?"), np.ones(256)
_FIRST[0x80:0xC0] = 0  # bytes that do not begin a character
_ASCII = np.zeros(256)
_ASCII[:128] = 1


def vectors(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each text; all zero for a text without words."""
    n = len(offsets) - 1
    starts, ends, rows = W.word_spans(raw, offsets)
    counts = np.diff(rows)
    out = np.zeros((n, len(FEATURES)))
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    row = np.repeat(np.arange(n), counts)
    sums = lambda table: np.diff(np.append(0, np.cumsum(table[raw]))[offsets])
    hashes = W.hash_spans(raw, starts, ends, True)
    length = ends - starts
    per_word = lambda values: np.bincount(row, values, n)
    safe = np.maximum(counts, 1)
    mean = per_word(length) / safe
    spread = np.sqrt(np.maximum(0, per_word(length.astype(float) ** 2) / safe - mean**2))
    chars = np.maximum(1, sums(_FIRST))
    newline = np.flatnonzero(raw == 10)
    lines = np.diff(np.searchsorted(newline, offsets)) + 1
    adjacent = np.zeros(len(hashes))
    adjacent[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    # Lines: spans between line ends and text borders.
    edges = np.unique(np.concatenate([offsets, newline + 1]))
    line_rows = np.searchsorted(offsets, edges[:-1], side="right") - 1
    keep = np.diff(edges) > 1
    line_start, line_end, line_rows = edges[:-1][keep], edges[1:][keep], line_rows[keep]
    line_end = line_end - (raw[np.maximum(line_end - 1, 0)] == 10)
    line_hash = W.hash_spans(raw, line_start, line_end, False)
    repeated = np.zeros((n, 3))
    windows = W.mix(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)) if len(hashes) > 2 else hashes[:0]
    cut = np.searchsorted(line_rows, np.arange(n + 1))
    for i in filled:
        a, b = rows[i], rows[i + 1]
        repeated[i, 0] = 1 - len(np.unique(hashes[a:b])) / (b - a)
        if b - a > 3:
            repeated[i, 1] = 1 - len(np.unique(windows[a : b - 2])) / (b - a - 2)
        if cut[i + 1] - cut[i] > 1:
            repeated[i, 2] = 1 - len(np.unique(line_hash[cut[i] : cut[i + 1]])) / (cut[i + 1] - cut[i])
    last = raw[ends - 1]
    share = lambda values: values / safe
    out[:, :] = np.stack([
        np.log1p(counts), np.log1p(lines), np.log1p(mean), np.log1p(spread),
        sums(_SYMBOLS) / chars, sums(_MARKS) / chars, sums(_CAPITALS) / chars, sums(_DIGITS) / chars, 1 - sums(_ASCII) / np.maximum(1, np.diff(offsets)),
        share(per_word(adjacent)), repeated[:, 0], repeated[:, 1], repeated[:, 2],
        share(per_word(_SYMBOLS[last])), share(per_word((length == 1) & (raw[starts] == ord("|")))),
        lines / safe, share(per_word(_ENDS[last])),
    ], axis=1)
    out[counts == 0] = 0
    return out


@dataclass(frozen=True)
class Ranking:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def merit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.merit(x) - self.threshold, -35, 35)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 500, seed: int = 7) -> Ranking:
    """Learn merits from pairs of a good and a bad row of ``x``. Without rows of both kinds the score is
    the same for all: the smoothed share of good rows."""
    d = len(FEATURES)
    good = np.asarray(good, dtype=bool)
    centre, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)) if len(x) else (np.zeros(d), np.ones(d))
    if not good.any() or good.all():
        share = (good.sum() + 1) / (len(good) + 2)
        return Ranking(centre, scale, np.zeros(d), float(-np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    z = np.clip((x - centre) / scale, -8, 8)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    difference = z[rng.choice(winners, pairs)] - z[rng.choice(losers, pairs)]
    w = v = np.zeros(d)
    t, rate = 1.0, 1.0 / (0.25 * float(np.linalg.eigvalsh(difference.T @ difference / pairs)[-1]) + ridge)
    for _ in range(steps):
        lost = 1 / (1 + np.exp(np.clip(difference @ v, -35, 35)))  # probability that the bad one wins
        w2 = v + rate * (difference.T @ lost / pairs - ridge * v)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = w2 + (t - 1) / t2 * (w2 - w), w2, t2
    merits = np.sort(z @ w)
    n_bad = int((~good).sum())
    return Ranking(centre, scale, w, float((merits[n_bad - 1] + merits[min(n_bad, len(merits) - 1)]) / 2))


def train(rows: DataFrame) -> Ranking:
    """Fit to a written, bounded table ``text, label`` (1: good)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = W.text_buffers(batch.column(0))
            for a, b in W.chunks(offsets):
                x = vectors(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(a, b - a)], names=["x", "label"])

    found = rows.select("text", "label").mapInArrow(measure, "x array<double>, label int").toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(found.column("label").to_pylist()) == 1)


def scores(docs: DataFrame, model: Ranking) -> DataFrame:
    """``docs`` with ``score double`` from 0 to 1; a text without words (null, empty) has the zero vector's."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        raw, offsets = W.text_buffers(texts)
        out = [model.score(vectors(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in W.chunks(offsets)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", score(F.col("text").cast("string")))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` with ``held_out boolean``, ``score double`` and ``predicted int`` (1: good).

    Labels of held-out rows are not learned from; a label other than 0 or 1, or without a ``doc_id``,
    counts as none, and repeated labels count as often as they come. Without labels of both kinds
    every text has the same score. Repeated rows of ``docs`` have equal scores; columns named like a
    result are replaced; an empty table gives an empty one.
    """
    model = train(training_rows(docs, labels, "quality", FOLDS, HELD_OUT, max_rows))
    scored = scores(docs, model).withColumn("held_out", held_out(FOLDS, HELD_OUT))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
