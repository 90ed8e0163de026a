"""F5 by planned range reads: windows are cut straight from the shard files, and no ids are exchanged.

A draw meets the list of its shard's files (a few bytes for each file) and becomes one or more byte ranges. Draws are
then sorted by file and position, so that a task reads a file front to back; ranges that overlap or lie near each
other are read together. Where the block join (``windows.cut_windows``) moves every block of every drawn shard, this
moves a few dozen bytes for each window and reads little more than its ``seq_len + 1`` ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.sources.tokenshards import DTYPE, STORE

#: Neighbouring ranges closer than this are read together, up to so many bytes at a time.
GAP_BYTES = 1 << 16
READ_BYTES = 1 << 23
#: Windows of one output batch.
BATCH = 256

_RANGES = "array<struct<path:string,first:bigint,n:bigint>>"
WINDOW = "sample_id BIGINT, source STRING, shard_idx INT, start BIGINT, x ARRAY<INT>, y ARRAY<INT>"


def plan_reads(draws: DataFrame, files: DataFrame, seq_len: int) -> DataFrame:
    """``sample_id, source, shard_idx, start, ranges``: where the ``seq_len + 1`` ids of each draw lie.

    ``files``: ``source, shard_idx, pos, n_tokens, path`` (see ``tokenshards.files_table``). A range's ``first`` is
    the first id inside its file. A draw behind its shard's end has fewer ids, like a slice."""
    of_shard = files.groupBy("source", "shard_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "n_tokens", "path"))).alias("parts"))
    end = F.col("start") + F.lit(seq_len + 1)
    met = F.filter("parts", lambda p: (p["pos"] < end) & (p["pos"] + p["n_tokens"] > F.col("start")))

    def span(p):
        first = F.greatest(F.col("start") - p["pos"], F.lit(0))
        return F.struct(p["path"].alias("path"), first.alias("first"), (F.least(end - p["pos"], p["n_tokens"]) - first).alias("n"))

    return draws.join(of_shard, ["source", "shard_idx"]).select(
        "sample_id", "source", "shard_idx", F.col("start").cast("bigint").alias("start"), F.transform(met, span).cast(_RANGES).alias("ranges")
    )


def stretches(rows: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Groups ``[a, b)`` of rows ``(path, first, n)``, sorted, that one read serves."""
    a, end = 0, 0
    gap, most = GAP_BYTES // DTYPE.itemsize, READ_BYTES // DTYPE.itemsize
    for i, (path, first, n) in enumerate(rows):
        if i > a and (path != rows[a][0] or first > end + gap or max(end, first + n) - rows[a][1] > most):
            yield a, i
            a = i
        end = first + n if i == a else max(end, first + n)
    if rows:
        yield a, len(rows)


def cut_windows_by_range(draws: DataFrame, files: DataFrame, seq_len: int, n_samples: int | None = None, windows_per_task: int = 8192) -> DataFrame:
    """the columns of ``WINDOW`` for every draw (see ``windows.cut_windows``), from the shard files themselves.

    ``n_samples`` (counted if not given) only sets the number of tasks."""
    L = int(seq_len)
    spark = draws.sparkSession
    n_samples = draws.count() if n_samples is None else n_samples
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-n_samples // 64)), -(-n_samples // windows_per_task), 1)
    head = F.col("ranges")[0]
    placed = plan_reads(draws, files, L).withColumns({"_path": head["path"], "_first": head["first"]})
    ordered = placed.repartitionByRange(tasks, "_path", "_first").sortWithinPartitions("_path", "_first").drop("_path", "_first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}

        def ids_at(path: str, first: int, n: int) -> np.ndarray:
            if path not in opened:
                while len(opened) > 7:
                    opened.pop(next(iter(opened))).close()
                store, name = STORE._at(path)
                opened[path] = store.open_input_file(name)
            raw = np.frombuffer(opened[path].read_at(n * DTYPE.itemsize, first * DTYPE.itemsize), dtype=DTYPE)
            if len(raw) != n:
                raise ValueError(f"{path} is shorter than its entry says")
            return raw

        def flush(rows: list[tuple], cut: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(c) for c in cut], dtype=np.int64)
            flat = np.concatenate([*cut, np.zeros(0, np.int32)]).astype(np.int32)
            starts = np.append(0, np.cumsum(sizes))

            def lists(skip_first: int):
                n = np.minimum(np.maximum(sizes - skip_first, 0), L)
                at = np.concatenate([np.arange(s + skip_first, s + skip_first + k) for s, k in zip(starts[:-1], n)] or [np.zeros(0, np.int64)])
                return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat[at]))

            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())
            columns = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, lists(0), lists(1)], names=["sample_id", "source", "shard_idx", "start", "x", "y"])

        for batch in batches:
            rows = list(zip(*(batch.column(j).to_pylist() for j in range(4))))
            ranges = [[(r["path"], r["first"], r["n"]) for r in own or []] for own in batch.column(4).to_pylist()]
            heads = [own[0] if own else ("", 0, 0) for own in ranges]
            kept_rows: list[tuple] = []
            kept: list[np.ndarray] = []
            for a, b in stretches(heads):
                low, high = heads[a][1], max(f + n for _, f, n in heads[a:b])
                held = ids_at(heads[a][0], low, high - low) if heads[a][0] else np.zeros(0, DTYPE)
                for i in range(a, b):
                    _, first, n = heads[i]
                    own = held[first - low : first - low + n]
                    if len(ranges[i]) > 1:  # goes on in the shard's next file
                        own = np.concatenate([own, *(ids_at(*r) for r in ranges[i][1:])])
                    kept_rows.append(rows[i])
                    kept.append(own.astype(np.int32))
                    if len(kept) == BATCH:
                        yield flush(kept_rows, kept)
                        kept_rows, kept = [], []
            if kept:
                yield flush(kept_rows, kept)

    return ordered.mapInArrow(read, WINDOW)
