"""Streaming: totals per trigger, incremental shards equal the batch job, replays are no-ops."""

import os

import pytest
from pyspark.sql import functions as F

from corpuspack.operators import packing
from corpuspack.plans import queries as Q
from corpuspack.sources.registry import DOCUMENTS_SCHEMA
from corpuspack.streaming.incremental import ShardAppender, read_doc_stream, run_shard_stream, stream_pack

SF = "/root/testdata/sf0.01"


def _split_in_order(spark, out, n_files=6):
    """Spark writes the fixture as several files in doc_id order (file k holds a doc_id range)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumn("_f", F.ntile(n_files).over(__import__("pyspark.sql").sql.Window.orderBy("doc_id")))
    for k in range(1, n_files + 1):
        docs.filter(F.col("_f") == k).drop("_f").coalesce(1).write.parquet(f"{out}/part-{k:03d}")
    return [f"{out}/part-{k:03d}" for k in range(1, n_files + 1)]


def _stream_of(spark, folder):
    raw = read_doc_stream(spark, folder, DOCUMENTS_SCHEMA, max_files_per_trigger=1)
    return raw.select(F.col("lang").alias("source"), F.col("doc_id").alias("doc_seq"), "text")


def test_stream_equals_batch(spark, tmp_out):
    parts = _split_in_order(spark, tmp_out + "/src")
    # one flat folder, file names in doc order, one file per trigger
    flat = tmp_out + "/flat"
    os.makedirs(flat)
    for k, p in enumerate(parts):
        f = [x for x in os.listdir(p) if x.endswith(".parquet")][0]
        os.link(f"{p}/{f}", f"{flat}/{k:03d}.parquet")
    seg = stream_pack(spark, _stream_of(spark, flat), tmp_out + "/out", Q.SHARD_TOKENS, Q.TARGETS, Q.BATCH_DOCS, 64)
    batch = Q.packed(spark, SF).segments()
    cols = ["source", "shard_idx", "pos", "doc_seq", "n_tokens", "tokens"]
    assert seg.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(seg.select(cols)).count() == 0
    # several micro-batches really happened
    assert len(ShardAppender(tmp_out + "/out")._done_batches()) >= 6


def test_replaying_a_batch_changes_nothing(spark, tmp_out):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("lang").alias("source"), F.col("doc_id").alias("doc_seq"), "text")
    app = ShardAppender(tmp_out + "/out", Q.SHARD_TOKENS, Q.TARGETS, Q.BATCH_DOCS, 64)
    first = docs.filter("doc_id < 400")
    second = docs.filter("doc_id >= 400")
    app(first, 0)
    app(second, 1)
    app(second, 1)  # replay of batch 1
    app.finish(spark)
    seg = app.segments(spark)
    batch = Q.packed(spark, SF).segments()
    cols = ["source", "shard_idx", "pos", "doc_seq", "n_tokens", "tokens"]
    assert seg.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(seg.select(cols)).count() == 0


def test_stream_totals_match_fixture_facts(spark):
    rows = Q.stream_totals(spark, SF).collect()
    assert {r.source: r.target_reached for r in rows} == {"de": True, "en": True, "es": False, "fr": True}
    got = {r.source: (r.n_docs, r.n_tokens) for r in rows}
    assert got == {"de": (129, 343_588), "en": (620, 1_472_661), "es": (106, 270_761), "fr": (145, 386_448)}


COLS = ["source", "shard_idx", "pos", "doc_seq", "n_tokens", "tokens"]


def _flat(spark, tmp_out, n_files):
    parts = _split_in_order(spark, tmp_out + "/src", n_files)
    flat = tmp_out + "/flat"
    os.makedirs(flat)
    for k, p in enumerate(parts):
        f = [x for x in os.listdir(p) if x.endswith(".parquet")][0]
        os.link(f"{p}/{f}", f"{flat}/{k:03d}.parquet")
    return flat


def _docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.select(F.col("lang").alias("source"), F.col("doc_id").alias("doc_seq"), "text")


@pytest.mark.parametrize("targets", [
    {"en": 70_000, "de": 70_000, "fr": 70_000, "es": 70_000},  # every budget is reached early
    {"de": 20_000, "en": None, "fr": None, "es": None},  # one budget, the others are kept whole
])
def test_no_source_is_cut_short_by_another(spark, tmp_out, targets):
    seg = stream_pack(spark, _stream_of(spark, _flat(spark, tmp_out, 8)), tmp_out + "/out", 65_536, targets, Q.BATCH_DOCS, 64)
    batch = packing.pack(_docs(spark), shard_tokens=65_536, targets=targets, batch_docs=Q.BATCH_DOCS).segments()
    assert seg.select(COLS).exceptAll(batch.select(COLS)).count() == 0
    assert batch.select(COLS).exceptAll(seg.select(COLS)).count() == 0
    assert len(ShardAppender(tmp_out + "/out")._done_batches()) >= 8


def test_a_source_without_a_target_is_an_error(spark, tmp_out):
    with pytest.raises(Exception, match="no target is given for source"):
        app = ShardAppender(tmp_out + "/out", Q.SHARD_TOKENS, {"en": 1000}, Q.BATCH_DOCS, 64)
        app(_docs(spark), 0)


def test_restart_goes_on_with_its_own_batches(spark, tmp_out):
    flat, out = _flat(spark, tmp_out, 4), tmp_out + "/out"
    later = tmp_out + "/later"
    os.makedirs(later)
    for f in ("002.parquet", "003.parquet"):
        os.rename(f"{flat}/{f}", f"{later}/{f}")
    args = (out, Q.SHARD_TOKENS, Q.TARGETS, Q.BATCH_DOCS, 64)
    run_shard_stream(_stream_of(spark, flat), ShardAppender(*args)).awaitTermination()
    for f in sorted(os.listdir(later)):
        os.rename(f"{later}/{f}", f"{flat}/{f}")
    app = ShardAppender(*args)  # a new process would build it anew
    run_shard_stream(_stream_of(spark, flat), app).awaitTermination()
    app.finish(spark)
    seg, batch = app.segments(spark), Q.packed(spark, SF).segments()
    assert seg.select(COLS).exceptAll(batch.select(COLS)).count() == 0
    assert batch.select(COLS).exceptAll(seg.select(COLS)).count() == 0


def test_sets_of_files_grow_in_number(spark, monkeypatch):
    """A larger table has more files in a set, not larger ones; each trigger still takes one whole set."""
    monkeypatch.setattr(Q, "FILE_BYTES", 100_000)
    folder, files = Q._ordered_files(spark, SF)
    names = sorted((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getmtime)
    assert files > 1 and len(names) == 4 * files
    ids = [[r.doc_id for r in spark.read.parquet(*names[k : k + files]).collect()] for k in range(0, len(names), files)]
    assert all(max(a) < min(b) for a, b in zip(ids, ids[1:])) and sum(map(len, ids)) == 1000
    sizes = [spark.read.parquet(n).agg(F.sum(F.octet_length("text"))).first()[0] or 0 for n in names]
    assert max(sizes) < 4 * 100_000


def test_sets_of_files_without_rows_keep_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "FILE_BYTES", 10)
    rows = [(k, "x" * 30, "en", "s", 30) for k in (0, 1, 2, 3)]
    spark.createDataFrame(rows, DOCUMENTS_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    folder, files = Q._ordered_files(spark, str(tmp_path))
    assert files == 3 and sum(f.endswith(".parquet") for f in os.listdir(folder)) == 4 * files
    assert [tuple(r) for r in Q.stream_totals(spark, str(tmp_path)).select("source", "n_docs", "n_tokens").collect()] == [("en", 4, 124)]
