"""Operator 9: token counts by section, from one encoding of each whole document.

The sections of a document are spans of its characters (fields of a record, or its lines). The
whole text is encoded once, each token has a span of bytes, and the sorted spans of tokens and
sections are joined inside the row's task. A token that crosses a boundary is allocated by an
explicit rule:

- ``first``: to the section that holds its first byte;
- ``last``: to the section that holds its last byte;
- ``most``: to the section that holds most of its bytes, the earlier one at a tie (default);
- ``split``: to each section by its share of the bytes.

A token outside every section counts for none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.llm import bpe

RULES = ("first", "last", "most", "split")


def line_spans(raw: np.ndarray) -> np.ndarray:
    """The lines of a text as byte spans that leave no gap: a line's end belongs to it.

    An empty text has one empty line.
    """
    ends = np.append(np.flatnonzero(raw == 10) + 1, len(raw))
    return np.stack([np.append(0, ends[:-1]), ends], axis=1)


def field_sections(names: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """Fields joined by ``separator`` as one text, and the sections that they fill in it (null: empty)."""
    values = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    text, sections, at = F.concat_ws(separator, *values), [], F.lit(0)
    for name, value in zip(names, values):
        end = at + F.length(value)
        sections.append(F.struct(F.lit(name).alias("section"), at.alias("start"), end.alias("end")))
        at = end + len(separator)
    return text, F.array(*sections)


def attribute(starts: np.ndarray, ends: np.ndarray, token_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section (ascending, disjoint byte spans), and how many of its tokens cross a boundary.

    ``token_ends``: the ends of consecutive tokens that begin at byte 0.
    """
    n = len(starts)
    counts, crossing = np.zeros(n), np.zeros(n, dtype=np.int64)
    token_starts = np.append(0, token_ends[:-1]) if len(token_ends) else token_ends
    if not n or not len(token_ends):
        return counts, crossing
    low = np.searchsorted(ends, token_starts, side="right")  # the first section that ends behind the token's start
    high = np.searchsorted(starts, token_ends, side="left") - 1  # the last one that begins before the token's end
    inside = (low == high) & (token_starts >= starts[np.minimum(low, n - 1)]) & (token_ends <= ends[np.minimum(low, n - 1)])
    np.add.at(counts, low[inside], 1.0)
    for t in np.flatnonzero(~inside & (low <= high)):
        span = np.arange(low[t], high[t] + 1)
        share = np.minimum(ends[span], token_ends[t]) - np.maximum(starts[span], token_starts[t])
        held = share > 0  # empty sections hold nothing
        if not held.any():
            continue
        span, share = span[held], share[held]
        if rule == "split":
            counts[span] += share / (token_ends[t] - token_starts[t])
            crossing[span] += 1
            continue
        if rule == "first":
            to = span[0] if starts[span[0]] <= token_starts[t] else -1
        elif rule == "last":
            to = span[-1] if ends[span[-1]] >= token_ends[t] else -1
        else:
            to = span[np.argmax(share)]
        if to >= 0:
            counts[to] += 1
            crossing[to] += 1
    return counts, crossing


def token_counts(
    docs: DataFrame, text: Column, sections: Column | None = None, rule: str = "most", tokenizer_path: str | None = None
) -> DataFrame:
    """A row for each section: ``doc_id, section, start, end, n_tokens double, n_crossing long``.

    ``sections`` is ``array<struct<section:string, start:int, end:int>>`` in characters, ascending
    and disjoint; null or an empty array gives no row. Without ``sections`` they are the lines of the
    text, named by their numbers (see ``line_spans``), and a null text gives no row. ``start`` and
    ``end`` are characters. A null text has no tokens. A null ``doc_id`` stays null, repeated rows
    give their rows again, other columns of ``docs`` are ignored. ``n_crossing`` counts the section's
    tokens that reach over a boundary.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    definition = bpe.broadcast_definition(docs.sparkSession, tokenizer_path or bpe.default_path())
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
    lines = sections is None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(definition.value)
        for batch in batches:
            out: list[list] = [[], [], []]
            numbers: list[list[np.ndarray]] = [[], [], [], []]
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                body = batch.column(1)[i].as_py()
                spans = None if lines else batch.column(2)[i].as_py()
                if (body is None) if lines else not spans:
                    continue
                body = body or ""
                raw = np.frombuffer(body.encode(), dtype=np.uint8)
                firsts = None if body.isascii() else np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                if lines:
                    at = line_spans(raw)
                    chars = at if firsts is None else np.searchsorted(firsts, at)
                    out[1] += map(str, range(len(at)))
                else:
                    chars = np.array([(s["start"], s["end"]) for s in spans], dtype=np.int64)
                    at = chars if firsts is None else firsts[chars]
                    out[1] += [s["section"] for s in spans]
                ends = np.cumsum(encoder.lengths[encoder.encode(body, added=True)])
                out[0] += [doc_id] * len(at)
                for kept, values in zip(numbers, (chars[:, 0], chars[:, 1], *attribute(at[:, 0], at[:, 1], ends, rule))):
                    kept.append(values)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())]
            for kept, kind in zip(numbers, (np.int64, np.int64, np.float64, np.int64)):
                columns.append(pa.array(np.concatenate([np.zeros(0, kind), *kept]).astype(kind)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = [] if lines else [sections.alias("sections")]
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *chosen)
    return frame.mapInArrow(count, "doc_id long, section string, start long, end long, n_tokens double, n_crossing long")
