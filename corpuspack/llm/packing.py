"""Operator 5: vector best-fit packing of tokenized documents into sequences.

1. ``pieces`` tokenizes each whole text once and cuts it into pieces of at most ``seq_len`` tokens;
   the narrow rows (no ids unless asked for) are written to the shared folder.
2. ``pack`` deals the pieces out to buckets of a bounded number of pieces. A bucket packs its
   pieces in order of falling length. Every open sequence has three residual capacities (tokens,
   documents, attention cost = sum of squared lengths); of the sequences where the piece fits
   under all three, the one with the smallest weighted residual norm, or the largest weighted
   dot product of demand and residual, takes it. Otherwise a new sequence opens.

Buckets are independent tasks, so the work grows with the pieces and no task's memory does. More
buckets cost at most one less filled sequence each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspack.llm import bpe
from corpuspack.session import materialize

EOS = 0


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weights of (tokens, documents, attention) in the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    rule: str = "norm"  # or "dot"


def cut_lengths(n: int, seq_len: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole pieces last, a shorter one first."""
    first = n % seq_len
    return ([first] if first else []) + [seq_len] * (n // seq_len)


def pieces(docs: DataFrame, seq_len: int = 2048, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: ``doc_id, piece, start, length, ids_crc32[, ids]``.

    A document is its ids and then ``EOS``. A null or empty text is the ``EOS`` alone; a null
    ``doc_id`` stays null; repeated rows are documents of their own. Other columns of ``docs``
    are ignored. ``ids`` are added with ``with_ids``.
    """
    definition = bpe.broadcast_definition(docs.sparkSession, tokenizer_path or bpe.default_path())

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(definition.value)
        for batch in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.encode(text.as_py(), added=True), np.uint32(EOS)).astype("<u4")
                at = 0
                for k, n in enumerate(cut_lengths(len(ids), seq_len)):
                    own = ids[at : at + n]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        kept.append(own.astype(np.int32))
                    at += n
            out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = T._parse_datatype_string(schema).fieldNames()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenize, schema)


def check_fits(length: int, limits: Limits) -> None:
    """An error if a piece of ``length`` tokens does not fit an empty sequence under all three capacities."""
    if length > limits.tokens or limits.documents < 1 or length**2 > limits.attention:
        raise ValueError("a piece is longer than a sequence" if length > limits.tokens else "a piece exceeds a capacity of an empty sequence")


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of each piece (in order of falling length), and how many sequences.

    Ties go to the sequence opened first. A piece longer than ``limits.tokens`` is an error.
    """
    n = len(lengths)
    if n:
        check_fits(int(lengths.max()), limits)
    cap = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.float64)
    weights = np.array(limits.weights)
    order = np.argsort(-lengths, kind="stable")
    rest = np.zeros((max(16, n // 2), 3))  # residuals as shares of the capacities
    opened = first = 0
    chosen, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    filled = np.zeros(len(rest), dtype=np.int64)
    smallest = lengths.min() / cap[0] if n else 0
    slack = 1e-12
    live = np.zeros(0, dtype=np.int64)  # sequences that can still take the smallest piece
    since = 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2]) / cap
        if since == 512:  # full sequences leave the search now and then
            own = rest[live]
            live = live[(own[:, 0] >= smallest - slack) & (own[:, 1] >= 1 / cap[1] - slack)]
            since = 0
        since += 1
        left = rest[live] - need
        fits = (left >= -slack).all(axis=1)
        at = -1
        if fits.any():
            if limits.rule == "dot":
                score = -((rest[live] * need) @ weights)
            else:
                score = (left * left) @ weights
            at = live[np.argmin(np.where(fits, score, np.inf))]
        else:
            if opened == len(rest):
                rest = np.concatenate([rest, np.zeros_like(rest)])
                filled = np.concatenate([filled, np.zeros_like(filled)])
            at, opened = opened, opened + 1
            rest[at] = 1.0
            live = np.append(live, at)
        rest[at] -= need
        chosen[i], offset[i] = at, filled[at]
        filled[at] += lengths[i]
    return chosen, offset, opened


def pack(pieces_table: DataFrame, limits: Limits = Limits(), bucket_pieces: int = 40_000) -> DataFrame:
    """``pieces_table`` (a written table) with ``sequence_id long, offset long`` added.

    Every piece is in one sequence; a sequence's pieces fill it gapless from 0 and keep to all of
    ``limits``. A piece as long as a sequence has one to itself; one that an empty sequence cannot take is an error. Repeated rows are pieces of their
    own. An empty table gives an empty table. ``bucket_pieces`` bounds the mean size of a bucket.
    """
    n = pieces_table.count()
    buckets = max(1, -(-n // bucket_pieces))
    numbered = pieces_table.withColumn("_row", F.monotonically_increasing_id())
    alone = numbered.filter(F.col("length") == limits.tokens)
    shared = numbered.filter(F.col("length") < limits.tokens)
    longest = numbered.agg(F.max("length")).first()[0]
    if longest is not None:
        check_fits(longest, limits)
    columns = pieces_table.columns

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row"], ascending=[False, True], kind="stable", ignore_index=True)
        sequence, offset, _ = best_fit(frame["length"].to_numpy(), limits)
        frame["sequence_id"] = frame["_bucket"].astype("int64") * (1 << 32) + sequence
        frame["offset"] = offset
        return frame[[*columns, "sequence_id", "offset"]]

    schema = T.StructType([*pieces_table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    bucket = F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int")
    packed = shared.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(fill, schema)
    whole = alone.select(*columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, limits: Limits = Limits(), tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``; see ``pieces`` and ``pack``."""
    table = materialize(pieces(docs, limits.tokens, tokenizer_path, with_ids), "pack-pieces")
    return pack(table, limits)
