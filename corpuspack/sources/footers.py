"""The prefix of a Parquet source that a token budget needs, found from the files' footers (A2, D3).

A stream stops reading at the document that fills the budget. Here the footers give, without reading any text, the
rows and the bytes of text of every row group. Those bytes say where the budget should end; the documents up to
there are counted once, group by group, and a few more groups only if that was not enough. In the group that crosses
the budget the documents are counted one by one, so the prefix ends ``batch_docs`` documents behind the crossing.

Whole files of the prefix are then read by Spark's own scan; of the last file only the row groups that are needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspack.functions.tokens import Tokenizer
from corpuspack.sources.registry import SourceSpec, text_scan
from corpuspack.sources.versions import ArrowStore

GROUPS = "file_no INT, path STRING, row_group INT, first_row BIGINT, n_rows BIGINT, text_bytes BIGINT"
SCAN = "text STRING, _file STRING, _part INT, _row BIGINT"
#: Schemes that tasks can open for themselves.
SCHEMES = ("file", "hdfs", "s3", "s3fs", "gs", "gcs")
#: Groups are counted until their estimate passes the budget by this share.
MARGIN = 0.02


def readable(files: Sequence[str]) -> bool:
    """Whether tasks can open these paths (plain ones, or of a known scheme)."""
    return all((m := re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", f)) is None or m[1] in SCHEMES for f in files)


def _open(path: str):
    store, at = ArrowStore()._at(re.sub("^file:/+", "file:///", path))
    return store.open_input_file(at)


def row_groups(spark: SparkSession, files: Sequence[str], column: str) -> DataFrame:
    """``GROUPS`` rows of ``files`` (in their order), read from the footers in tasks; ``text_bytes`` before compression."""
    names = [c.split()[0] for c in GROUPS.split(", ")]
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(path) as source:
                    meta, first = pq.ParquetFile(source).metadata, 0
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        own = [group.column(c) for c in range(group.num_columns)]
                        size = sum(c.total_uncompressed_size for c in own if c.path_in_schema == column)
                        rows.append((number, path, g, first, group.num_rows, size))
                        first += group.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    as_scanned = [re.sub("^file:/+", "file:/", f) for f in files]  # the form of a scan's file paths
    listed = spark.createDataFrame(list(enumerate(as_scanned)), "file_no INT, path STRING")
    return listed.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)), "file_no").mapInArrow(read, GROUPS)


def group_scan(spark: SparkSession, groups: Sequence, column: str) -> DataFrame:
    """The texts of some row groups as ``text_scan`` gives them, one group to a task."""
    names = [c.split()[0] for c in SCAN.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path, g, row in zip(*(batch.column(j).to_pylist() for j in range(3))):
                with _open(path) as source:
                    for part in pq.ParquetFile(source).iter_batches(batch_size=1000, row_groups=[g], columns=[column]):
                        n = part.num_rows
                        places = pa.array(range(row, row + n), pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), pa.array([path] * n), pa.array([0] * n, pa.int32()), places], names=names)
                        row += n

    wanted = spark.createDataFrame([(g["path"], g["row_group"], g["first_row"], i) for i, g in enumerate(groups)], "path STRING, row_group INT, first_row BIGINT, n INT")
    return wanted.repartitionByRange(len(groups), "n").drop("n").mapInArrow(read, SCAN)


@dataclass(frozen=True)
class Prefix:
    """The needed part of a source: row groups in stream order, and the rows needed of the last one (None: all)."""

    groups: list
    last_row: int | None
    counted: list  # the row groups whose documents were counted

    def scan(self, spark: SparkSession, spec: SourceSpec, all_groups: Sequence) -> DataFrame:
        """A ``text_scan`` of the prefix."""
        last = self.groups[-1]["path"]
        whole = [*dict.fromkeys(g["path"] for g in self.groups if g["path"] != last)]
        tail = [g for g in self.groups if g["path"] == last]
        if self.last_row is None and len(tail) == sum(g["path"] == last for g in all_groups):
            return text_scan(spark, spec, [*whole, last])
        part = group_scan(spark, tail, spec.text_field)
        if self.last_row is not None:
            part = part.filter(F.col("_row") <= self.last_row)
        return text_scan(spark, spec, whole).unionByName(part) if whole else part


def count_groups(spark: SparkSession, spec: SourceSpec, groups: Sequence, all_groups: Sequence, tokenizer: Tokenizer) -> dict[tuple[str, int], tuple[int, int]]:
    """Tokens and non-empty documents of each of the neighbouring row groups ``groups``."""
    numbered = {}
    for g in groups:
        numbered.setdefault(g["path"], []).append(g)
    sizes = {}
    for g in all_groups:
        sizes[g["path"]] = sizes.get(g["path"], 0) + 1
    whole = [p for p, own in numbered.items() if len(own) == sizes[p]]
    parts = [g for p, own in numbered.items() if len(own) != sizes[p] for g in own]
    scans = ([text_scan(spark, spec, whole)] if whole else []) + ([group_scan(spark, parts, spec.text_field)] if parts else [])
    scan = scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1])
    docs = scan.filter(F.col("text") != "").select("_file", "_row", tokenizer.count("text").alias("n"))
    starts = spark.createDataFrame([(p, [g["first_row"] for g in own], own[0]["row_group"]) for p, own in numbered.items()], "_file STRING, starts ARRAY<BIGINT>, first INT")
    # the files' starts are metadata-sized; a row's group is the last start at or before it
    at = F.expr("first + size(filter(starts, s -> s <= _row)) - 1")
    found = docs.join(starts, "_file").groupBy("_file", at.alias("g")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    return {(r["_file"], r["g"]): (r["tokens"], r["docs"]) for r in found.collect()}  # a row for each group counted


def last_row_needed(spark: SparkSession, spec: SourceSpec, group, missing: int, batch_docs: int, tokenizer: Tokenizer) -> tuple[int, int | None]:
    """In the row group that crosses the budget: the documents behind the crossing, and the row of the
    ``batch_docs``-th of them (None if there are fewer)."""
    docs = group_scan(spark, [group], spec.text_field).filter(F.col("text") != "").select("_row", tokenizer.count("text").alias("n"))
    so_far = docs.select("_row", F.sum("n").over(Window.orderBy("_row")).alias("upto"))  # one row group
    behind = so_far.filter(F.col("upto") >= missing).select("_row").orderBy("_row").limit(batch_docs + 1).collect()
    return len(behind) - 1, behind[-1]["_row"] if len(behind) > batch_docs else None


def budget_prefix(
    spark: SparkSession, spec: SourceSpec, files: Sequence[str], target: int, shard_tokens: int, batch_docs: int, tokenizer: Tokenizer
) -> tuple[Prefix, list]:
    """The prefix of ``files`` that decides the cut of a budget of ``target`` tokens, and all row groups.

    The stream stops at a document-batch end at or behind the rounded budget, at most ``batch_docs`` documents
    behind the document that crosses it."""
    if not files:
        raise FileNotFoundError(f"{spec.name} has no files")
    rounded = -(-int(target) // int(shard_tokens)) * int(shard_tokens)
    index = sorted(row_groups(spark, files, spec.text_field).collect(), key=lambda g: (g["file_no"], g["row_group"]))  # a row for each row group
    if not index or (index[0]["text_bytes"] == 0 and index[0]["n_rows"]):
        text_scan(spark, spec, list(files[:1]))  # raises if the field is not there
    size = lambda g: max(1, g["text_bytes"] - 3 * g["n_rows"])  # noqa: E731  lengths of 4 bytes stand for one end mark
    counts: dict = {}
    counted_groups: list = []
    ratio, total, done, behind, last = 1.0, 0, 0, None, None
    while done < len(index) and last is None and (behind is None or behind < batch_docs):
        upto, wanted, docs = done, (rounded - total) * (1 + MARGIN), 0
        while upto < len(index) and (upto == done or (wanted > 0 if behind is None else docs < batch_docs - behind)):
            wanted -= size(index[upto]) * ratio
            docs += index[upto]["n_rows"]
            upto += 1
            if not counts and ratio == 1.0 and not tokenizer.native:
                break  # an outside tokenizer's tokens for each byte are learnt from the first group
        counted = count_groups(spark, spec, index[done:upto], index, tokenizer)
        counts.update(counted)
        counted_groups += index[done:upto]
        seen = sum(t for t, _ in counted.values())
        if seen:
            ratio = seen / sum(size(g) for g in index[done:upto])
        for g in index[done:upto]:
            tokens, n = counts.get((g["path"], g["row_group"]), (0, 0))
            done += 1
            if behind is not None:
                behind += n
            elif total + tokens >= rounded:
                behind, last = last_row_needed(spark, spec, g, rounded - total, batch_docs, tokenizer)
            total += tokens
            if last is not None or (behind is not None and behind >= batch_docs):
                break
    return Prefix(index[:done], last, counted_groups), index
