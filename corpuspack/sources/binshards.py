"""Flat ``uint32`` shard files: export from packed segments, and a job that reads them back.

Layout: ``<out>/<source>/shard_00000.bin`` …, a headerless little-endian ``uint32`` stream, one folder
for each source, as other tools' loaders expect it. An export writes beside the old shards; only when all of its
files exist does it mark the folder ``_INCOMPLETE``, exchange old for new by name, and commit a manifest table;
the reader takes only what the manifest lists and refuses a folder that is incomplete. A folder without a
manifest (written by another tool) is listed instead, its shards numbered by the number in their names.
Where readers must never meet the exchange, ``tokenshards`` keeps versions instead.

Lengths come from the manifest or from file sizes, never from the ids. Reading splits every file into
byte ranges of whole blocks, so a 100 M-token shard is read by many tasks and no row holds more than
``block_tokens`` ids. Folders are addressed by URI (``pyarrow.fs``) and must reach every executor.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspack.session import hadoop_path
from corpuspack.sources.tokenshards import source_names

BIN_SCHEMA = "source STRING, shard_idx INT, pos BIGINT, tokens ARRAY<INT>"
FILES_SCHEMA = "shard_idx INT, n_tokens BIGINT, path STRING"
DTYPE = np.dtype("<u4")


def _store(uri: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def is_exported(spark: SparkSession, out_dir: str, source: str) -> bool:
    """Whether the source's folder holds a committed export."""
    fs, p = hadoop_path(spark, f"{out_dir.rstrip('/')}/{source}/_manifest/_SUCCESS")
    return bool(fs.exists(p))


def export_bin(segments: DataFrame, out_dir: str, sources: Sequence[str] | None = None) -> DataFrame:
    """Write each shard of ``segments`` as ``out_dir/source/shard_%05d.bin`` and commit the folders.

    Returns ``source, shard_idx, n_tokens, path`` of what was written. ``sources`` (default: those in
    ``segments``) names the folders that are replaced; other sources' folders stay. One task writes a
    whole shard (rows shuffled by ``(source, shard_idx)``, sorted by ``pos``), to a name of its own first
    and renamed when complete, so a retried task rewrites it.
    """
    spark = segments.sparkSession
    out_dir = out_dir.rstrip("/")
    if sources is None:  # one row per source
        sources = sorted(r["source"] for r in segments.select("source").distinct().collect())
    store, top = _store(out_dir)
    fresh = f"_new-{uuid.uuid4().hex[:12]}"
    for source in sources:
        store.create_dir(f"{top}/{source}/{fresh}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(out_dir)
        current, sink, temp, count = None, None, "", 0
        done: list[tuple] = []

        def close():
            if sink is not None:
                sink.close()
                name = f"{current[0]}/shard_{current[1]:05d}.bin"
                store.move(temp, f"{top}/{current[0]}/{fresh}/shard_{current[1]:05d}.bin")
                done.append((*current, count, f"{out_dir}/{name}"))

        for batch in batches:
            shard = batch.column(1).to_numpy()
            names = batch.column(0).to_pylist()
            change = [i for i in range(batch.num_rows) if i == 0 or shard[i] != shard[i - 1] or names[i] != names[i - 1]]
            for a, b in zip(change, [*change[1:], batch.num_rows]):
                key = (names[a], int(shard[a]))
                if key != current:
                    close()
                    current, count = key, 0
                    temp = f"{top}/{key[0]}/{fresh}/_shard_{key[1]:05d}.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temp, compression=None)
                ids = batch.column(2).slice(a, b - a).flatten().to_numpy()
                sink.write(ids.astype(DTYPE).tobytes())
                count += len(ids)
        close()
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in done], k) for j, k in enumerate(kinds)], names=["source", "shard_idx", "n_tokens", "path"])

    ordered = (
        segments.filter(F.col("source").isin(list(sources)))
        .select("source", "shard_idx", "tokens", "pos")
        .repartition("source", "shard_idx")
        .sortWithinPartitions("source", "shard_idx", "pos")
        .select("source", "shard_idx", "tokens")
    )
    from corpuspack.session import materialize

    from pyarrow import fs

    try:
        written = materialize(ordered.mapInArrow(write, f"source STRING, {FILES_SCHEMA}"), "bin-written")
    except Exception:  # the old shards are still in place
        for source in sources:
            store.delete_dir(f"{top}/{source}/{fresh}")
        raise
    for source in sources:
        folder = f"{top}/{source}"
        with store.open_output_stream(f"{folder}/_INCOMPLETE"):
            pass
        for old in store.get_file_info(fs.FileSelector(folder)):
            if old.type == fs.FileType.Directory and old.base_name != fresh:
                store.delete_dir(old.path)
            elif old.type == fs.FileType.File and old.base_name != "_INCOMPLETE":
                store.delete_file(old.path)
        for new in store.get_file_info(fs.FileSelector(f"{folder}/{fresh}")):
            if not new.base_name.startswith("_"):
                store.move(new.path, f"{folder}/{new.base_name}")
        store.delete_dir(f"{folder}/{fresh}")
        own = written.filter(F.col("source") == source).drop("source")
        own.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/{source}/_manifest")
        store.delete_file(f"{folder}/_INCOMPLETE")
    return written


def bin_files(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """``source, shard_idx, n_tokens, path`` of the shards in ``dirs``, without reading any ids."""
    frames = []
    for d, name in zip(dirs, source_names(dirs)):
        d = d.rstrip("/")
        fs, folder = hadoop_path(spark, d)
        at = lambda child: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, child)  # noqa: E731, B023
        if fs.exists(at("_INCOMPLETE")):
            raise ValueError(f"the export to {d} did not finish")
        if fs.exists(at("_manifest/_SUCCESS")):
            files = spark.read.schema(FILES_SCHEMA).parquet(f"{d}/_manifest")
        elif fs.exists(folder) and fs.globStatus(at("*.bin")):
            listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(d).select("path", "length")
            number = F.regexp_extract("path", r"(\d+)\.bin$", 1).try_cast("bigint")
            # One row per file of a folder.
            order = Window.orderBy(number.asc_nulls_last(), "path")
            files = listed.select((F.row_number().over(order) - 1).alias("shard_idx"), F.expr(f"length div {DTYPE.itemsize}").alias("n_tokens"), "path")
        else:
            continue
        frames.append(files.select(F.lit(name).alias("source"), "shard_idx", "n_tokens", "path"))
    if not frames:
        raise FileNotFoundError(f"these folders hold no shard files: {', '.join(dirs)}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_blocks(files: DataFrame, block_tokens: int = 65536, split_tokens: int = 16 << 20) -> DataFrame:
    """``source, shard_idx, pos, tokens`` blocks of the shards in ``files`` (see ``bin_files``)."""
    block = int(block_tokens)
    split = max(block, int(split_tokens) // block * block)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, shard, path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    raw = f.read_at((stop - start) * DTYPE.itemsize, start * DTYPE.itemsize)
                ids = np.frombuffer(raw, dtype=DTYPE)
                if len(ids) != stop - start:
                    raise ValueError(f"{path} is shorter than its entry says")
                starts = np.arange(start, stop, block, dtype=np.int64)
                offsets = np.append(starts - start, stop - start).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                k = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array([source] * k), pa.array([shard] * k, pa.int32()), pa.array(starts), tokens], names=["source", "shard_idx", "pos", "tokens"])

    ranges = files.filter("n_tokens > 0").select(
        "source", "shard_idx", "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(split).cast("bigint"))).alias("start"), "n_tokens"
    )
    ranges = ranges.select("source", "shard_idx", "path", "start", F.least(F.col("start") + split, F.col("n_tokens")).alias("stop"))
    cores = files.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(8 * cores, "path", "start").mapInArrow(read, BIN_SCHEMA)


def read_bin(spark: SparkSession, dirs: Sequence[str], block_tokens: int = 65536) -> DataFrame:
    """The blocks of all shards in ``dirs``."""
    return read_blocks(bin_files(spark, dirs), block_tokens)
