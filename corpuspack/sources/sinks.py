"""Sinks: packed shards as Parquet (A8), chat JSONL (A9), the prepared-source test (A10).

Packed Parquet is versioned (``versions.py``): each write goes to ``path/version=<id>/source=…/shard_idx=…`` and
becomes visible by a manifest that names, for each source, the version that holds it, the fingerprint of what it
was made from, and whether it has rows at all. A failed write changes nothing that can be read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.sources import versions

PACKED_SCHEMA = "source STRING, shard_idx INT, pos BIGINT, doc_seq BIGINT, n_tokens BIGINT, tokens ARRAY<INT>"


def source_folder(path: str, source: str) -> str:
    """The folder of one source under ``path`` (a partition folder, as Spark names it)."""
    name = re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", source)
    return f"{path.rstrip('/')}/source={name}"


def prepared(spark: SparkSession, path: str) -> dict[str, dict]:
    """What the newest version under ``path`` holds: source -> ``version, rows, fingerprint``."""
    found = versions.newest(versions.HadoopStore(spark), path.rstrip("/"))
    return found[1]["sources"] if found else {}


def input_fingerprint(spark: SparkSession, files: Sequence[str], parameters: Mapping) -> str:
    """A digest of a source's input listing (path, length, time of change of each file) and of the parameters.

    The listing is Spark's own; no file is opened, and its digest is a sum of hashes, whatever the number of files."""
    listing = (0, 0)
    if files:
        rows = spark.read.format("binaryFile").load(list(files)).select("path", "length", F.col("modificationTime").cast("double"))
        listing = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    text = json.dumps([list(map(str, listing)), sorted(parameters.items())], ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def is_prepared(spark: SparkSession, path: str, source: str, fingerprint: str | None = None) -> bool:
    """A10: a source counts as prepared when the newest version names it, even if it had no rows, and, where a
    ``fingerprint`` is given, was made from the same input with the same parameters."""
    entry = prepared(spark, path).get(source)
    return entry is not None and (fingerprint is None or entry["fingerprint"] == fingerprint)


def write_packed(
    segments: DataFrame, path: str, shuffle: bool = True, sources: Sequence[str] | None = None, fingerprints: Mapping[str, str] | None = None
) -> None:
    """Write packed segments and commit them as the new version of their sources.

    With ``shuffle`` rows are shuffled by ``(source, shard_idx)`` so each shard is written by
    one task (at most ``shard_tokens`` ids, whatever the data size). Without it (segments
    already clustered by stream position, as ``PackResult.write`` gives them) only a local
    sort runs. ``sources`` are the sources written, those without rows included, which read as empty afterwards; by
    default those that have rows. Other sources stay as they are.
    """
    spark, path = segments.sparkSession, path.rstrip("/")
    seg = segments.select("source", "shard_idx", "pos", "doc_seq", "n_tokens", "tokens")
    if sources is not None:
        seg = seg.filter(F.col("source").isin(list(sources)))
    if shuffle:
        seg = seg.repartition("source", "shard_idx")
    store = versions.HadoopStore(spark)
    before = versions.newest(store, path)
    version = uuid.uuid4().hex[:12]
    target = f"{path}/version={version}"
    seg.sortWithinPartitions("source", "shard_idx", "pos").write.partitionBy("source", "shard_idx").parquet(target)
    held = set(store.names(target))
    if sources is None:  # one folder per source
        named = spark.read.schema(PACKED_SCHEMA).parquet(target).select("source").distinct() if any(n.startswith("source=") for n in held) else None
        sources = [r["source"] for r in named.collect()] if named is not None else []
    content = dict(before[1]["sources"]) if before else {}
    for s in sources:
        content[s] = {"version": version, "rows": source_folder(target, s).rsplit("/", 1)[1] in held, "fingerprint": (fingerprints or {}).get(s)}
    versions.commit(store, path, before[0] if before else 0, {"sources": content})
    versions.sweep(store, path, lambda c: {f"version={e['version']}" for e in c["sources"].values()})


def prepare_source(spark: SparkSession, segments: DataFrame, path: str, source: str, force: bool = False, fingerprint: str | None = None) -> bool:
    """Write one source's shards unless already prepared (from the same input, if a ``fingerprint`` is given);
    returns whether it wrote."""
    if not force and is_prepared(spark, path, source, fingerprint):
        return False
    write_packed(segments, path, sources=[source], fingerprints={source: fingerprint} if fingerprint else None)
    return True


def read_packed(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """The newest version of the packed segments; only the folders of ``sources`` (default: all) are listed."""
    path = path.rstrip("/")
    entries = prepared(spark, path)
    if not entries:
        raise FileNotFoundError(f"{path} holds no committed shards")
    by_version: dict[str, list[str]] = {}
    for s, e in sorted(entries.items()):
        if e["rows"] and (sources is None or s in sources):
            by_version.setdefault(e["version"], []).append(source_folder(f"{path}/version={e['version']}", s))
    out = None
    for version, folders in by_version.items():
        part = spark.read.schema(PACKED_SCHEMA).option("basePath", f"{path}/version={version}").parquet(*folders)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], PACKED_SCHEMA) if out is None else out.select(*[f.split()[0] for f in PACKED_SCHEMA.split(", ")])


def write_chat_jsonl(chats: DataFrame, path: str) -> None:
    """One ``{"messages": [...]}`` object per line, UTF-8 unescaped, path overwritten."""
    chats.select("messages").write.mode("overwrite").option("ignoreNullFields", "false").json(path)
