"""S2 and S3 with the carry in the state store, for files that arrive in any order.

A source's stream order is the number of its files, not their arrival. Three parts work together:

* ``file_counts``: each arriving document adds to its file's documents and tokens (stateless; a few bytes per file
  and task leave it).
* ``InOrder``: a stateful processor with one state per source: the next file number, the documents and tokens
  before it, and the files that wait for an earlier one (path and two counts each, never texts). It lets go of the
  contiguous prefix, each file with the rank and offset at which it begins. With ``lateness`` a missing file is given up
  once a file that many numbers ahead has come; what still arrives of it is counted as late and left out.
* ``OrderedAppender``: for the files let go it reads the text, once, places each document and appends the pieces
  under ``segments/batch_id=n``; a source that is full is not read any more. A batch is committed by a versioned
  manifest (``versions.py``) that holds a line for each source. So a batch reads one manifest and its own files:
  the hundredth costs what the first does. A batch that is played again is either overwritten or already
  committed, and changes nothing.

What the budget may still revoke is not handed out: ``segments`` ends each source at its cut, or, while there is none,
at the end of the last whole document batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpuspack.functions.tokens import ByteTokenizer, Tokenizer
from corpuspack.operators import packing
from corpuspack.sources import versions

COUNTS = "source STRING, file_seq BIGINT, path STRING, n_docs BIGINT, n_tokens BIGINT"
RELEASED = (
    "source STRING, file_seq BIGINT, path STRING, n_docs BIGINT, n_tokens BIGINT, first_doc BIGINT, first_token BIGINT, n_held BIGINT, n_late BIGINT"
)
SEGMENTS = "source STRING, shard_idx INT, pos BIGINT, doc_seq BIGINT, n_tokens BIGINT, tokens ARRAY<INT>, rank BIGINT, doc_end BIGINT"
#: Files of more tokens, or of more documents than a bucket, are placed by more than one task.
FILE_TOKENS = 1 << 27
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_number(path: Column) -> Column:
    """A file's place in its source: the number of a ``seq=`` folder, else of a ``part-`` file."""
    of = lambda pattern: F.regexp_extract(path, pattern, 1).try_cast("bigint")
    return F.coalesce(of(r"/seq=(\d+)/"), of(r"/part-(\d+)[^/]*$"))


def read_files(spark: SparkSession, root: str, schema: str, files_per_trigger: int, fmt: str = "parquet") -> DataFrame:
    """The files under ``root`` as a stream in order of arrival, with ``path`` and ``file_seq``."""
    raw = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(root)
    path = F.col("_metadata.file_path")
    return raw.select("*", path.alias("path"), file_number(path).alias("file_seq"))


def file_counts(docs: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``COUNTS`` of a stream of ``source, file_seq, path, text``: partial sums by task. Empty texts count as no
    document, but their file has arrived."""
    tokenizer = tokenizer or ByteTokenizer()
    full = F.coalesce(F.col("text") != "", F.lit(False))
    rows = docs.select("source", "file_seq", "path", F.when(full, tokenizer.count("text")).otherwise(0).cast("bigint").alias("n"))
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            own = pa.Table.from_batches([batch]).group_by(["source", "file_seq", "path"]).aggregate([("n", "sum")])
            held = pa.Table.from_batches([batch]).filter(pa.compute.greater(batch.column(3), 0)).group_by(["source", "file_seq", "path"]).aggregate([("n", "count")])
            for r in own.to_pylist():
                sums.setdefault((r["source"], r["file_seq"], r["path"]), [0, 0])[1] += r["n_sum"]
            for r in held.to_pylist():
                sums[r["source"], r["file_seq"], r["path"]][0] += r["n_count"]
        rows = [(*k, *v) for k, v in sums.items()]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    return rows.mapInArrow(add, COUNTS)


class InOrder(StatefulProcessor):
    """Lets a source's files go in the order of their numbers, with what lies before each."""

    def __init__(self, lateness: int | None = None):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next BIGINT, n_docs BIGINT, n_tokens BIGINT, newest BIGINT, n_held BIGINT, n_late BIGINT")
        self.held = handle.getMapState("held", "file_seq BIGINT", "path STRING, n_docs BIGINT, n_tokens BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        nxt, docs, tokens, newest, n_held, n_late = self.at.get() if self.at.exists() else (0, 0, 0, -1, 0, 0)
        arrived: dict[int, list] = {}
        for frame in rows:
            for seq, path, n, t in zip(frame["file_seq"], frame["path"], frame["n_docs"], frame["n_tokens"]):
                if pd.isna(seq):
                    raise ValueError(f"{path} carries no number")
                own = arrived.setdefault(int(seq), [path, 0, 0])
                if own[0] != path:
                    raise ValueError(f"{path} and {own[0]} carry the same number")
                own[1] += int(n)
                own[2] += int(t)
        out = []
        for seq, (path, n, t) in arrived.items():
            newest = max(newest, seq)
            if seq < nxt:
                n_late += 1
            elif self.held.containsKey((seq,)):
                raise ValueError(f"{path} carries a number that has come before")
            else:
                self.held.updateValue((seq,), (path, n, t))
                n_held += 1
        while n_held:
            if not self.held.containsKey((nxt,)):
                if self.lateness is None or newest - nxt < self.lateness:
                    break
                nxt = min(int(k[0]) for k in self.held.keys())  # given up: the stream-order watermark has passed
            path, n, t = self.held.getValue((nxt,))
            out.append((key[0], nxt, path, n, t, docs, tokens))
            self.held.removeKey((nxt,))
            nxt, docs, tokens, n_held = nxt + 1, docs + n, tokens + t, n_held - 1
        self.at.update((nxt, docs, tokens, newest, n_held, n_late))
        out.append((key[0], None, None, 0, 0, docs, tokens))  # where the source stands
        frame = pd.DataFrame(out, columns=["source", "file_seq", "path", "n_docs", "n_tokens", "first_doc", "first_token"])
        frame["file_seq"] = frame["file_seq"].astype("Int64")
        yield frame.assign(n_held=n_held, n_late=n_late)

    def close(self) -> None:
        pass


@dataclass
class OrderedAppender:
    """``foreachBatch`` target for rows of ``RELEASED``."""

    spark: SparkSession
    out_dir: str
    schema: str  # of the source's files
    shard_tokens: int = packing.DEFAULT_SHARD_TOKENS
    targets: packing.Targets = packing.DEFAULT_TARGET
    batch_docs: int = packing.DEFAULT_BATCH_DOCS
    doc_seq: str = "doc_id"
    fmt: str = "parquet"
    tokenizer: Tokenizer = field(default_factory=ByteTokenizer)

    def __post_init__(self) -> None:
        self.out_dir = self.out_dir.rstrip("/")
        self.store = versions.HadoopStore(self.spark)

    def _target(self, source: str) -> int | None:
        """The budget rounded up to whole shards: a document batch that ends behind it is the last."""
        target = self.targets.get(source) if isinstance(self.targets, Mapping) else self.targets
        return None if target is None else -(-int(target) // self.shard_tokens) * self.shard_tokens

    def _newest(self) -> tuple[int, dict]:
        return versions.newest(self.store, self.out_dir) or (0, {"sources": {}})

    def _needed(self, files: list, sources: Mapping[str, dict]) -> list:
        """The files that can hold a kept token: up to the one that crosses the budget, and ``batch_docs`` documents more."""
        needed, behind = [], {}
        for r in sorted(files, key=lambda r: (r["source"], r["file_seq"])):
            s, target = r["source"], self._target(r["source"])
            if sources.get(s, {}).get("kept") is not None or behind.get(s, 0) >= self.batch_docs or not r["n_docs"]:
                continue
            needed.append(r)
            if target is not None and r["first_token"] >= target:
                behind[s] = behind.get(s, 0) + r["n_docs"]
        return needed

    def _place(self, files: list) -> DataFrame:
        """The documents of ``files`` with their rank and offset in the source's stream."""
        spark = self.spark
        own = spark.createDataFrame([(r["source"], r["path"], r["first_doc"], r["first_token"]) for r in files], "source STRING, path STRING, first_doc BIGINT, first_token BIGINT")
        raw = spark.read.schema(self.schema).format(self.fmt).load([r["path"] for r in files])
        raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col(self.doc_seq).alias("doc_seq"), "text")
        docs = packing.with_token_counts(packing.nonempty(raw), self.tokenizer)
        if max(r["n_docs"] for r in files) <= packing.DEFAULT_BUCKET_DOCS and max(r["n_tokens"] for r in files) <= FILE_TOKENS:
            before = Window.partitionBy("path").orderBy("doc_seq").rowsBetween(Window.unboundedPreceding, -1)
            docs = docs.select("*", F.count(F.lit(1)).over(before).alias("rank"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
        else:  # a file too large for one task
            bucket, levels = packing.auto_buckets(docs)
            docs = packing.exclusive_prefix_sums(docs, ["path"], "doc_seq", packing.offset_weights(), bucket, levels)
        return docs.join(F.broadcast(own), "path").select(
            "source", "doc_seq", "text", "n_tokens", (F.col("rank") + F.col("first_doc")).alias("rank"), (F.col("offset") + F.col("first_token")).alias("offset")
        )

    def _pieces(self, docs: DataFrame) -> DataFrame:
        whole = docs.withColumns({"kept_tokens": F.lit((1 << 63) - 1), "doc_end": F.col("offset") + F.col("n_tokens")})
        if isinstance(self.tokenizer, ByteTokenizer):
            seg = packing.shard_pieces(whole.withColumn("_bytes", F.encode("text", "UTF-8")), self.shard_tokens)
            end = F.least(F.col("start") + F.col("length"), F.col("n_tokens") - 1)
            ids = self.tokenizer.encode_bytes(F.substring("_bytes", (F.col("start") + 1).cast("int"), (end - F.col("start")).cast("int")))
            last = F.col("start") + F.col("length") == F.col("n_tokens")
            tokens = F.when(last, F.array_append(ids, F.lit(self.tokenizer.eos_id))).otherwise(ids)
        else:
            seg = packing.shard_pieces(whole.withColumn("_ids", self.tokenizer.encode_with_eos("text")), self.shard_tokens)
            tokens = F.slice("_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
        return seg.select("source", "shard_idx", "pos", "doc_seq", F.col("length").alias("n_tokens"), tokens.alias("tokens"), "rank", "doc_end")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. Its rows are always evaluated, which is what commits the state store."""
        released = f"{self.out_dir}/released/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(released)
        done, content = self._newest()
        if done > batch_id:
            return  # played again after its commit
        rows = self.spark.read.schema(RELEASED).parquet(released).collect()  # a row for each file let go, and each source
        sources = {s: dict(e) for s, e in content["sources"].items()}
        for r in rows:
            if r["file_seq"] is None:
                sources.setdefault(r["source"], {"kept": None, "complete": 0}).update(
                    n_docs=r["first_doc"], n_tokens=r["first_token"], n_held=r["n_held"], n_late=r["n_late"])
        files = self._needed([r for r in rows if r["file_seq"] is not None], sources)
        if files:
            out = f"{self.out_dir}/segments/batch_id={batch_id}"
            self._pieces(self._place(files)).write.mode("overwrite").parquet(out)
            rounded = F.lit(None).cast("bigint")
            for s in {r["source"] for r in files}:
                if self._target(s) is not None:
                    rounded = F.when(F.col("source") == s, F.lit(self._target(s))).otherwise(rounded)
            ends = self.spark.read.schema(SEGMENTS).parquet(out).filter((F.col("rank") + 1) % self.batch_docs == 0)
            found = ends.groupBy("source").agg(F.min(F.when(F.col("doc_end") >= rounded, F.col("doc_end"))).alias("hit"), F.max("doc_end").alias("complete"))
            for r in found.collect():  # a row for each source
                sources[r["source"]]["complete"] = r["complete"]
                if r["hit"] is not None:
                    sources[r["source"]]["kept"] = r["hit"] - r["hit"] % self.shard_tokens
        self._commit(batch_id, sources)

    def _commit(self, number: int, sources: dict, **more) -> None:
        versions.commit(self.store, self.out_dir, number, {"sources": sources, **more})
        versions.sweep(self.store, self.out_dir, lambda _: ())

    def finish(self) -> None:
        """Close the stream: the documents behind the last whole batch form the short last one.

        A source with files that still wait for an earlier one is an error: its stream has a gap."""
        number, content = self._newest()
        if content.get("final") or not number:
            return
        gaps = sorted(s for s, e in content["sources"].items() if e["n_held"] and e["kept"] is None)
        if gaps:
            raise ValueError(f"files are missing from the streams of {', '.join(gaps)}")
        sources = {}
        for s, e in content["sources"].items():
            total, target = e["n_tokens"], self._target(s)
            last = total - total % self.shard_tokens if target is not None and total >= target else total
            sources[s] = {**e, "kept": last if e["kept"] is None else e["kept"]}
        self._commit(number, sources, final=True, batches=content.get("batches", number))

    def segments(self) -> DataFrame:
        """The committed segments: up to each source's cut, or the end of its last whole document batch."""
        number, content = self._newest()
        ends = [(s, e["complete"] if e["kept"] is None else e["kept"]) for s, e in content["sources"].items()]
        cuts = self.spark.createDataFrame(ends, "source STRING, _kept BIGINT")
        columns = [F.col(c.split()[0]) for c in SEGMENTS.split(", ")]
        if "segments" not in self.store.names(self.out_dir):
            return self.spark.createDataFrame([], SEGMENTS).drop("rank", "doc_end")
        batches = content.get("batches", number)
        df = self.spark.read.schema(f"{SEGMENTS}, batch_id BIGINT").parquet(f"{self.out_dir}/segments").filter(F.col("batch_id") < batches)
        at = F.col("shard_idx").cast("bigint") * self.shard_tokens + F.col("pos")
        n = F.least(F.col("n_tokens"), F.col("_kept") - at)
        kept = df.join(F.broadcast(cuts), "source").filter(at < F.col("_kept")).select(*columns, n.alias("_n"))
        return kept.select("source", "shard_idx", "pos", "doc_seq", F.col("_n").alias("n_tokens"), F.slice("tokens", 1, F.col("_n").cast("int")).alias("tokens"))

    def progress(self) -> DataFrame:
        """Documents and tokens of each source so far, files that wait and files that came too late."""
        rows = [(s, e["n_docs"], e["n_tokens"], e["n_held"], e["n_late"], e["kept"]) for s, e in self._newest()[1]["sources"].items()]
        return self.spark.createDataFrame(rows, "source STRING, n_docs BIGINT, n_tokens BIGINT, n_held BIGINT, n_late BIGINT, kept_tokens BIGINT")


def start_ordered(docs: DataFrame, appender: OrderedAppender, lateness: int | None = None, state_partitions: int = 8, checkpoint: str | None = None) -> StreamingQuery:
    """Start the stream over what is there (``availableNow``). Its checkpoint lies beside the output, so a restart goes on.

    The state store is RocksDB, with few partitions, as there is one key for each source."""
    spark = appender.spark
    counts = file_counts(docs, appender.tokenizer).groupBy("source")
    released = counts.transformWithStateInPandas(InOrder(lateness), RELEASED, "Append", "None")
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(state_partitions)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:  # a stream keeps the settings that it starts with
        for k, v in settings.items():
            spark.conf.set(k, v)
        writer = released.writeStream.foreachBatch(appender).queryName(f"ordered-{uuid.uuid4().hex[:8]}")
        return writer.option("checkpointLocation", checkpoint or f"{appender.out_dir}/_checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pack_files_in_order(
    spark: SparkSession, root: str, out_dir: str, schema: str, shard_tokens: int, targets: packing.Targets, batch_docs: int,
    files_per_trigger: int = 4, lateness: int | None = None, source: Column | None = None, doc_seq: str = "doc_id",
) -> OrderedAppender:
    """Run the stream to the end of what is there and close it."""
    appender = OrderedAppender(spark, out_dir, schema, shard_tokens, targets, batch_docs, doc_seq)
    raw = read_files(spark, root, schema, files_per_trigger)
    docs = raw.select((source if source is not None else F.regexp_extract("path", r"/source=([^/]+)/", 1)).alias("source"), "file_seq", "path", "text")
    start_ordered(docs, appender, lateness).awaitTermination()
    appender.finish()
    return appender
