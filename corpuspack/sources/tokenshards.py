"""A Python data source for flat ``uint32`` shards: ``spark.read.format("token_shards")``, and writing with it.

A source's folder holds ``<version>/shard_00000.bin``, headerless little-endian ids, and the manifests of its
versions (``versions.py``). A shard written by several tasks is several files, the later ones named by the position
where they begin (``shard_00000_000000065536.bin``), so that the path order is the stream order. A folder without
manifests is taken as another tool's: its ``*.bin`` files in path order are the shards.

Reading plans byte ranges of whole blocks, several small ones or a part of a large one to a task; equality, ``IN`` and
comparisons on ``source`` and ``shard_idx`` prune files before any task starts. Writing commits a version of each
source's folder when all tasks are through and removes the files when one fails for good; sources that were named
but got no rows read as empty afterwards.

Call ``register(session)`` once; the file systems are those of ``pyarrow.fs`` and must reach every executor.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

from corpuspack.sources import versions

SCHEMA = "source STRING, shard_idx INT, pos BIGINT, tokens ARRAY<INT>"
FILES = "source STRING, shard_idx INT, pos BIGINT, n_tokens BIGINT, path STRING"
DTYPE = np.dtype("<u4")
STORE = versions.ArrowStore()


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenShards)


def source_names(dirs: Sequence[str]) -> list[str]:
    """A name for each folder, its last part; folders of one name get their position in front."""
    names = [d.rstrip("/").rsplit("/", 1)[-1] for d in dirs]
    return [n if names.count(n) == 1 else f"{i}:{n}" for i, n in enumerate(names)]


@dataclass(frozen=True)
class File:
    """A shard file: ``n_tokens`` ids of shard ``shard_idx`` from position ``pos`` on."""

    source: str
    shard_idx: int
    pos: int
    n_tokens: int
    path: str


def folder_files(folder: str, source: str) -> list[File] | None:
    """The files of a source's newest version, or of another tool's folder; None if the folder holds neither."""
    folder = folder.rstrip("/")
    found = versions.newest(STORE, folder)
    if found:
        return [File(source, i, pos, n, f"{folder}/{name}") for i, pos, n, name in found[1]["shards"]]
    sizes = STORE.sizes(folder)
    if any(n == "_INCOMPLETE" for n, _ in sizes):
        raise ValueError(f"the export to {folder} did not finish")
    shards = [(n, size) for n, size in sizes if n.endswith(".bin") and not n.startswith(("_", "."))]
    number = lambda n: (int(m[1]) if (m := re.search(r"(\d+)\.bin$", n)) else 1 << 62, n)
    return [File(source, i, 0, size // DTYPE.itemsize, f"{folder}/{n}") for i, (n, size) in enumerate(sorted(shards, key=lambda s: number(s[0])))] or None


def files_of(path: str | None, dirs: Sequence[str] | None = None) -> list[File]:
    """The files of the folders ``dirs`` in their order, or of ``path``: one source's folder, or the parent of several."""
    if dirs is None:
        path = (path or "").rstrip("/")
        own = folder_files(path, path.rsplit("/", 1)[-1])
        if own is not None:
            return own
        dirs = [f"{path}/{n}" for n in STORE.names(path) if not n.startswith(("_", "."))]
    found = [folder_files(d, name) for d, name in zip(dirs, source_names(dirs))]
    if not any(f is not None for f in found):
        raise FileNotFoundError(f"these folders hold no shard files: {', '.join(dirs) or path}")
    return [f for own in found for f in own or []]


def files_table(spark: SparkSession, files: Sequence[File]) -> DataFrame:
    """``FILES`` rows, a few dozen bytes for each shard file."""
    return spark.createDataFrame([(f.source, f.shard_idx, f.pos, f.n_tokens, f.path) for f in files], FILES)


# --------------------------------------------------------------------------- reading


@dataclass
class Ranges(InputPartition):
    """Stretches ``(file, first id, end)`` that one task reads."""

    stretches: list[tuple[File, int, int]]


class ShardReader(DataSourceReader):
    def __init__(self, files: list[File], block_tokens: int, split_tokens: int):
        self.files, self.block = files, block_tokens
        self.split = max(block_tokens, split_tokens // block_tokens * block_tokens)

    def pushFilters(self, filters):
        tests = {
            EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
            LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
        }
        for f in filters:
            column = getattr(f, "attribute", None)
            if type(f) in tests and column in (("source",), ("shard_idx",)) and f.value is not None:
                self.files = [x for x in self.files if tests[type(f)](getattr(x, column[0]), f.value)]
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        out, held, size = [], [], 0
        for f in self.files:
            for start in range(0, f.n_tokens, self.split):
                end = min(start + self.split, f.n_tokens)
                if held and size + end - start > self.split:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((f, start, end))
                size += end - start
        return out + ([Ranges(held)] if held else [])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        chunk = self.block * max(1, (1 << 20) // self.block)  # ids in memory at a time
        for f, first, last in partition.stretches:
            store, name = STORE._at(f.path)
            with store.open_input_file(name) as source:
                for start in range(first, last, chunk):
                    end = min(start + chunk, last)
                    ids = np.frombuffer(source.read_at((end - start) * DTYPE.itemsize, start * DTYPE.itemsize), dtype=DTYPE)
                    if len(ids) != end - start:
                        raise ValueError(f"{f.path} is shorter than its entry says")
                    starts = np.arange(start, end, self.block, dtype=np.int64)
                    offsets = np.append(starts - start, end - start).astype(np.int32)
                    k = len(starts)
                    columns = [pa.array([f.source] * k), pa.array([f.shard_idx] * k, pa.int32()), pa.array(starts + f.pos), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["source", "shard_idx", "pos", "tokens"])


# --------------------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has finished: ``(source, shard, position, ids, name)``."""

    files: list[tuple[str, int, int, int, str]]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sources: list[str] | None, overwrite: bool):
        self.path, self.sources, self.overwrite = path.rstrip("/"), sources, overwrite
        self.version = f"v{uuid.uuid4().hex[:12]}"

    def _named(self, source) -> str:
        if source is None or not re.fullmatch(r"[^/\x00]+", source) or source.startswith(("_", ".")):
            raise ValueError(f"{source!r} cannot name a source's folder")
        if self.sources is not None and source not in self.sources:
            raise ValueError(f"rows of {source!r}, which is not among the sources written")
        return source

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[str, int, int, int, str]] = []
        at, sink, move, count = None, None, None, 0

        def close():
            if sink is not None:
                sink.close()
                move()
                done.append((at[0], at[1], at[2], count, at[3]))

        for batch in iterator:
            source, shard, pos = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            tokens = batch.column(3)
            for i in range(batch.num_rows):
                ids = tokens[i].values.to_numpy(zero_copy_only=False)
                if at is None or (source[i], shard[i]) != at[:2] or pos[i] != at[2] + count:
                    close()
                    tail = f"_{pos[i]:012d}" if pos[i] else ""
                    name = f"{self.version}/shard_{shard[i]:05d}{tail}.bin"
                    at, count = (self._named(source[i]), shard[i], pos[i], name), 0
                    store, final = STORE._at(f"{self.path}/{source[i]}/{name}")
                    folder, _, short = final.rpartition("/")
                    temp = f"{folder}/_{uuid.uuid4().hex}.{short}"
                    store.create_dir(folder, recursive=True)
                    sink = store.open_output_stream(temp, compression=None)
                    move = lambda store=store, temp=temp, final=final: store.move(temp, final)
                sink.write(ids.astype(DTYPE).tobytes())
                count += len(ids)
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files: dict[str, list] = {s: [] for s in self.sources or []}
        for m in messages:
            for source, shard, pos, n, name in m.files if m else []:
                files.setdefault(source, []).append([shard, pos, n, name])
        last = {source: versions.newest(STORE, f"{self.path}/{source}") for source in files}
        if self.overwrite and self.sources is None:  # the stores of other sources under the path become empty
            for name in STORE.names(self.path):
                found = None if name in files or name.startswith(("_", ".")) else versions.newest(STORE, f"{self.path}/{name}")
                if found and "shards" in found[1]:
                    files[name], last[name] = [], found
        new = {s: sorted(own + (last[s][1]["shards"] if last[s] and not self.overwrite else [])) for s, own in files.items()}
        for source, shards in new.items():  # nothing is committed unless all can be
            whole(source, shards)
        for source, shards in sorted(new.items()):
            versions.commit(STORE, f"{self.path}/{source}", last[source][0] if last[source] else 0, {"shards": shards})
        for source in new:
            versions.sweep(STORE, f"{self.path}/{source}", _data_folders)

    def abort(self, messages: list[Written | None]) -> None:
        for source in STORE.names(self.path):
            found = versions.newest(STORE, f"{self.path}/{source}")
            if not (found and self.version in _data_folders(found[1])):  # a source may have been committed before the failure
                STORE.drop(f"{self.path}/{source}/{self.version}")


def _data_folders(content: dict) -> set[str]:
    return {s[3].split("/")[0] for s in content.get("shards", [])}


def whole(source: str, shards: Iterable[Sequence]) -> None:
    """Shards must be numbered from 0 and each be whole from position 0; otherwise nothing is committed."""
    shard, end = -1, 0
    for i, pos, n, _ in shards:
        if i != shard:
            if i != shard + 1:
                raise ValueError(f"shard {shard + 1} of {source} is missing")
            shard, end = i, 0
        if pos != end:
            raise ValueError(f"shard {i} of {source} has ids at {pos} where those at {end} are due")
        end += n


class TokenShards(DataSource):
    """Options: ``dirs`` (a JSON list of folders, in order) instead of a path; ``blockTokens`` and ``splitTokens`` for
    reading; ``sources`` (a JSON list) for writing: the sources that the write replaces, even if it has no rows of
    them. ``overwrite`` without it replaces every source under the path, ``append`` adds shards."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        dirs = self.options.get("dirs")
        block = int(self.options.get("blockTokens", 65536))
        return ShardReader(files_of(self.options.get("path"), json.loads(dirs) if dirs else None), block, int(self.options.get("splitTokens", 16 << 20)))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        sources = self.options.get("sources")
        return ShardWriter(self.options["path"], json.loads(sources) if sources else None, overwrite)


def write_shards(segments: DataFrame, path: str, sources: Sequence[str] | None = None, whole_shards: bool = True) -> None:
    """Packed segments as shard files under ``path/<source>``, committed when all are written.

    With ``whole_shards`` rows are shuffled by shard and each shard is one file, as other tools' loaders expect.
    Without, the rows stay where they are (segments come grouped by stream position) and a shard is as many
    files as tasks hold parts of it: no ids are exchanged a second time. ``sources``: those that are replaced,
    by default all under ``path``.
    """
    register(segments.sparkSession)
    rows = segments.select("source", "shard_idx", "pos", F.col("tokens").cast("array<int>").alias("tokens"))
    if whole_shards:
        rows = rows.repartition("source", "shard_idx")
    writer = rows.sortWithinPartitions("source", "shard_idx", "pos").write.format("token_shards").mode("overwrite")
    if sources is not None:
        writer = writer.option("sources", json.dumps(list(sources)))
    writer.save(path.rstrip("/"))


def read_shards(spark: SparkSession, dirs: Sequence[str], block_tokens: int = 65536) -> DataFrame:
    """Blocks of ids of the folders ``dirs``."""
    register(spark)
    return spark.read.format("token_shards").option("dirs", json.dumps(list(dirs))).option("blockTokens", block_tokens).load()
