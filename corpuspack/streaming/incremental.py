"""Structured Streaming forms of corpus preparation.

S1  ``token_stream``: files arrive, empty documents are dropped, tokens counted (stateless).
S2  ``start_totals``: running documents and tokens per source (``complete`` output mode).
S3  ``ShardAppender``: a ``foreachBatch`` sink that packs arriving documents into shards with
    offsets carried across micro-batches, under the same budget rule as the batch job.

S3 rules. Documents must arrive in ``doc_seq`` order (files in order, each micro-batch
sorted by it). Only positions that can never be revoked are written: while the budget is
not reached, everything up to the end of the last *complete* document batch (D1) — those
ends are all below the rounded target, and the eventual cut is at or above it. The
unfinished batch waits in a staging table; ``finish`` closes it as the short last batch.
Every output of batch ``n`` (segments, staging, manifest) lives under ``batch_id=n`` and is
overwritten on replay, so re-running a batch id changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuspack.functions.tokens import ByteTokenizer, Tokenizer
from corpuspack.operators import packing
from corpuspack.session import hadoop_path, scratch_dir

STATE_SCHEMA = (
    "source STRING, n_docs BIGINT, n_tokens BIGINT, committed BIGINT, reached BOOLEAN, kept BIGINT"
)
STAGED_SCHEMA = "source STRING, doc_seq BIGINT, text STRING, n_tokens BIGINT, rank BIGINT, offset BIGINT"


def read_doc_stream(
    spark: SparkSession, path: str, schema: str, max_files_per_trigger: int = 1, fmt: str = "parquet"
) -> DataFrame:
    """A file stream in path order, ``max_files_per_trigger`` files per micro-batch.

    ``path`` is a folder, or a single file (given to the file source as a one-name glob,
    since a plain file path is taken as the base folder).
    """
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger)
    fs, p = hadoop_path(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        folder, _, name = path.rpartition("/")
        path = f"{folder}/{{{name}}}"
    return reader.load(path)


def token_stream(docs: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``(source, doc_seq, text)`` stream → non-empty documents with ``n_tokens``."""
    return packing.with_token_counts(packing.nonempty(docs), tokenizer)


def totals(counts: DataFrame, targets: packing.Targets = None) -> DataFrame:
    """Documents and tokens per source so far, against the source's target (if any)."""
    agg = counts.groupBy("source").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_docs"), F.sum("n_tokens").cast("bigint").alias("n_tokens")
    )
    return agg.withColumn("target", packing.target_column(targets)).withColumn(
        "target_reached", F.coalesce(F.col("n_tokens") >= F.col("target"), F.lit(False))
    )


def start_totals(
    counts: DataFrame, name: str, checkpoint: str | None = None, targets: packing.Targets = None
) -> StreamingQuery:
    """Run S2 into an in-memory table ``name`` (per-source rows; bounded by the sources)."""
    checkpoint = checkpoint or f"{scratch_dir(counts.sparkSession)}/stream-{name}"
    return (
        totals(counts, targets).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


@dataclass
class ShardAppender:
    """S3: ``foreachBatch`` target packing a document stream into shards incrementally."""

    out_dir: str
    shard_tokens: int = packing.DEFAULT_SHARD_TOKENS
    targets: packing.Targets = packing.DEFAULT_TARGET
    batch_docs: int = packing.DEFAULT_BATCH_DOCS
    bucket_docs: int | None = None  # None: sized per micro-batch from its doc_seq span
    tokenizer: Tokenizer = field(default_factory=ByteTokenizer)

    # ------------------------------------------------------------------ paths and state

    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.out_dir.rstrip('/')}/{kind}/batch_id={batch_id}"

    def _done_batches(self, kind: str = "manifest") -> list[int]:
        """Batch ids whose output is complete (``_SUCCESS``), via the Hadoop file system API."""
        spark = SparkSession.getActiveSession()
        jvm = spark.sparkContext._jvm
        fs, root = hadoop_path(spark, f"{self.out_dir.rstrip('/')}/{kind}")
        if not fs.exists(root):
            return []
        ids = []
        for st in fs.listStatus(root):
            name = st.getPath().getName()
            if name.startswith("batch_id=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                ids.append(int(name.split("=", 1)[1]))
        return sorted(ids)

    def _state(self, spark: SparkSession, before: int) -> tuple[DataFrame, DataFrame, int | None]:
        prior = [b for b in self._done_batches() if b < before]
        if not prior:
            return (F.broadcast(spark.createDataFrame([], STATE_SCHEMA)), spark.createDataFrame([], STAGED_SCHEMA), None)
        last = prior[-1]
        state = spark.read.schema(STATE_SCHEMA).parquet(self._path("manifest", last))
        staged = spark.read.schema(STAGED_SCHEMA).parquet(self._path("staging", last))
        return state, staged, last

    # ------------------------------------------------------------------ one micro-batch

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._step(batch, batch_id, final=False)

    def finish(self, spark: SparkSession) -> None:
        """Close the stream: the staged documents form the short last batch."""
        done = self._done_batches()
        next_id = (done[-1] + 1) if done else 0
        if done:
            _, staged, _ = self._state(spark, next_id)
            if staged.limit(1).count() == 0:
                return  # every received document is committed: no short batch to close
        empty = spark.createDataFrame([], "source STRING, doc_seq BIGINT, text STRING")
        self._step(empty, next_id, final=True)

    def _step(self, batch: DataFrame, batch_id: int, final: bool) -> None:
        spark = batch.sparkSession
        S, B = int(self.shard_tokens), int(self.batch_docs)
        state, staged, _ = self._state(spark, batch_id)
        docs = packing.with_token_counts(packing.nonempty(batch.select("source", "doc_seq", "text")), self.tokenizer)
        bucket, levels = packing.auto_buckets(docs, width=self.bucket_docs)
        local = packing.exclusive_prefix_sums(docs, ["source"], "doc_seq", packing.offset_weights(), bucket, levels)
        fresh = (
            local.join(state.select("source", F.col("n_docs").alias("_r0"), F.col("n_tokens").alias("_o0"),
                                    F.col("reached").alias("_done")), "source", "left")
            .filter(~F.coalesce(F.col("_done"), F.lit(False)))
            .select("source", "doc_seq", "text", "n_tokens",
                    (F.col("rank") + F.coalesce("_r0", F.lit(0))).alias("rank"),
                    (F.col("offset") + F.coalesce("_o0", F.lit(0))).alias("offset"))
        )
        live = staged.unionByName(fresh)
        # used three times below; a failed batch is replayed by the stream, so a cache suffices
        live = live.persist()

        # Per source: received totals, first reaching batch end, last complete batch end.
        t_round = F.expr(f"((target + {S - 1}) div {S}) * {S}")
        ends = live.select(
            "source", "rank", "n_tokens", (F.col("offset") + F.col("n_tokens")).alias("end"),
            packing.target_column(self.targets).alias("target"),
        ).withColumn("t_round", t_round)
        batch_end = ((F.col("rank") + 1) % F.lit(B)) == 0
        per = ends.groupBy("source").agg(
            F.max("end").alias("total"),
            F.max("t_round").alias("t_round"),
            F.min(F.when(batch_end & (F.col("end") >= F.col("t_round")), F.col("end"))).alias("hit"),
            F.max(F.when(batch_end, F.col("end"))).alias("last_end"),
        )
        prev = state.select("source", F.col("committed").alias("_c0"), F.col("n_docs").alias("_d0"),
                            F.col("n_tokens").alias("_t0"), F.col("reached").alias("_r"), F.col("kept").alias("_k"))
        counts = fresh.groupBy("source").agg(F.count(F.lit(1)).alias("_dn"), F.sum("n_tokens").alias("_tn"))
        merged = prev.join(per, "source", "full").join(counts, "source", "left")
        total = F.coalesce("total", "_t0", F.lit(0))
        final_hit = F.when(F.lit(final) & (total >= F.col("t_round")), total)
        hit = F.coalesce(F.col("hit"), final_hit)
        reached_now = hit.isNotNull() & ~F.coalesce(F.col("_r"), F.lit(False))
        kept_now = hit - hit % F.lit(S)
        safe = F.when(F.lit(final), total).otherwise(F.greatest(F.coalesce("last_end", "_c0", F.lit(0)),
                                                                F.coalesce("_c0", F.lit(0))))
        new_state = merged.select(
            "source",
            (F.coalesce("_d0", F.lit(0)) + F.coalesce("_dn", F.lit(0))).cast("bigint").alias("n_docs"),
            (F.coalesce("_t0", F.lit(0)) + F.coalesce("_tn", F.lit(0))).cast("bigint").alias("n_tokens"),
            F.when(F.coalesce(F.col("_r"), F.lit(False)), F.col("_c0"))
            .when(reached_now, kept_now).otherwise(safe).cast("bigint").alias("committed"),
            (F.coalesce(F.col("_r"), F.lit(False)) | reached_now).alias("reached"),
            F.when(F.coalesce(F.col("_r"), F.lit(False)), F.col("_k"))
            .when(reached_now, kept_now).cast("bigint").alias("kept"),
        )
        # One row per source: local up to a bound and then broadcast (else a source's rows would
        # all go to one task), a written table beyond it.
        new_state, small = packing.small_table(new_state, f"stream-state-{batch_id}")
        given = F.broadcast if small else lambda df: df

        # Write the pieces between the old and the new committed position.
        bounds = new_state.select("source", F.col("committed").alias("kept_tokens"))
        writable = live.join(given(bounds), "source")
        if isinstance(self.tokenizer, ByteTokenizer):
            # as in the batch split: cut the UTF-8 bytes per piece, encode only the piece
            seg = packing.shard_pieces(writable.withColumn("_bytes", F.encode("text", "UTF-8")), S)
            body_end = F.least(F.col("start") + F.col("length"), F.col("n_tokens") - 1)
            ids = self.tokenizer.encode_bytes(
                F.substring("_bytes", (F.col("start") + 1).cast("int"), (body_end - F.col("start")).cast("int")))
            tokens = F.when(F.col("start") + F.col("length") == F.col("n_tokens"),
                            F.array_append(ids, F.lit(self.tokenizer.eos_id))).otherwise(ids)
        else:
            seg = packing.shard_pieces(writable.withColumn("_ids", self.tokenizer.encode_with_eos("text")), S)
            tokens = F.slice("_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
        seg.select(
            "source", "shard_idx", "pos", "doc_seq", F.col("length").alias("n_tokens"), tokens.alias("tokens"),
        ).write.mode("overwrite").parquet(self._path("segments", batch_id))

        # Stage what is not committed yet; then record the state (last: marks the batch done).
        hold = live.join(given(bounds), "source").filter(
            F.col("offset") + F.col("n_tokens") > F.col("kept_tokens")
        ).join(given(new_state.select("source", "reached")), "source").filter(~F.col("reached"))
        hold.select("source", "doc_seq", "text", "n_tokens", "rank", "offset").write.mode("overwrite").parquet(
            self._path("staging", batch_id)
        )
        new_state.coalesce(1).write.mode("overwrite").parquet(self._path("manifest", batch_id))
        live.unpersist()

    # ------------------------------------------------------------------ results

    def segments(self, spark: SparkSession) -> DataFrame:
        """All segments written so far (a piece appears in exactly one batch)."""
        done = set(self._done_batches())
        seg_root = f"{self.out_dir.rstrip('/')}/segments"
        df = spark.read.parquet(seg_root)
        return df.filter(F.col("batch_id").isin(sorted(done))).drop("batch_id")


def run_shard_stream(
    docs_stream: DataFrame, appender: ShardAppender, checkpoint: str | None = None
) -> StreamingQuery:
    """Start S3 with ``trigger(availableNow=True)``; call ``appender.finish`` after it ends."""
    # Beside the output, so that a restart of any process finds the batches that it belongs to.
    checkpoint = checkpoint or f"{appender.out_dir.rstrip('/')}/_checkpoint"
    return (
        docs_stream.writeStream.foreachBatch(appender)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_pack(
    spark: SparkSession,
    docs_stream: DataFrame,
    out_dir: str,
    shard_tokens: int,
    targets: packing.Targets,
    batch_docs: int,
    bucket_docs: int | None = None,
) -> DataFrame:
    """Run S3 to the end of the available input, close it, return the segments.

    All files are read, since any of them may hold a source without a budget or one that has not
    reached its own; documents of sources that have are dropped as they arrive."""
    app = ShardAppender(out_dir, shard_tokens, targets, batch_docs, bucket_docs)
    run_shard_stream(docs_stream, app).awaitTermination()
    app.finish(spark)
    return app.segments(spark)
