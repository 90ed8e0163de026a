"""Sources and sinks: registry, stream order, packed Parquet, .bin shards, JSONL chats, A10."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuspack.functions import text as T
from corpuspack.operators import packing
from corpuspack.plans import queries as Q
from corpuspack.sources import binshards, registry, sinks
from corpuspack.sources.registry import fixture_docs

SF = "/root/testdata/sf0.001"


def test_registry_lookup():
    assert registry.lookup("codeparrot").text_field == "content"
    with pytest.raises(ValueError):
        registry.lookup("nope")


def test_read_source_stream_order(spark, tmp_out):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    # three files, written in doc order; the registry's text field for the-stack is `content`
    for k in range(3):
        part = docs.filter(F.col("doc_id") % 3 == k).select(F.col("text").alias("content"), "doc_id")
        part.coalesce(1).write.parquet(f"{tmp_out}/stack/train/f{k}")
    raw = registry.read_source(spark, "the-stack", f"{tmp_out}/stack", split="train/*")
    got = raw.orderBy("doc_seq").collect()
    assert [r.doc_seq for r in got] == list(range(200))
    assert all(r.source == "the-stack" for r in got)
    # file order first, then row order inside each file
    texts = {r.doc_id: r.text for r in docs.collect()}
    expect = [texts[i] for k in range(3) for i in sorted(texts) if i % 3 == k]
    assert [r.text for r in got] == expect


def test_packed_parquet_roundtrip_and_prepared_marker(spark, tmp_out):
    p = Q.packed(spark, SF)
    path = f"{tmp_out}/packed"
    assert not sinks.is_prepared(spark, path, "en")
    for source in ("en", "de", "fr", "es"):  # one path: each source has its own folder and marker
        assert sinks.prepare_source(spark, p.segments(), path, source)
        assert sinks.is_prepared(spark, path, source)
    assert not sinks.prepare_source(spark, p.segments(), path, "en")  # skipped: already prepared
    back = sinks.read_packed(spark, path)
    inv = packing.shard_inventory(back)
    assert inv.exceptAll(p.inventory()).count() == 0 and p.inventory().exceptAll(inv).count() == 0
    assert sinks.read_packed(spark, path, ["en"]).select("source").distinct().count() == 1


def test_bin_export_and_scan(spark, tmp_out):
    p = Q.packed(spark, SF)
    out = f"{tmp_out}/bin"
    written = binshards.export_bin(p.segments(), out).collect()
    assert len(written) == p.inventory().count() and binshards.is_exported(spark, out, "en")
    en0 = np.fromfile(f"{out}/en/shard_00000.bin", dtype="<u4")
    assert len(en0) == Q.SHARD_TOKENS
    blocks = binshards.read_bin(spark, [f"{out}/en", f"{out}/de"], block_tokens=4096)
    inv = blocks.groupBy("source", "shard_idx").agg(F.sum(F.size("tokens")).alias("n_tokens"))
    want = p.inventory().filter(F.col("source").isin("en", "de"))
    assert sorted(map(tuple, inv.collect())) == sorted(map(tuple, want.collect()))
    first = blocks.filter("source = 'en' and shard_idx = 0 and pos = 0").first()
    assert list(first.tokens) == en0[:4096].tolist()
    with pytest.raises(FileNotFoundError, match="no shard files"):
        binshards.read_bin(spark, [f"{tmp_out}/empty"])


def test_a_smaller_export_leaves_no_stale_shards(spark, tmp_out):
    out, docs = f"{tmp_out}/bin", fixture_docs(spark, SF)
    for targets in (None, {"en": 20_000, "de": 20_000, "fr": 20_000, "es": 20_000}):
        p = packing.pack(docs, shard_tokens=8192, targets=targets, batch_docs=10)
        binshards.export_bin(p.segments(), out)
        got = binshards.bin_files(spark, [f"{out}/{s}" for s in ("en", "de", "fr", "es")]).drop("path")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, p.inventory().collect()))
    assert len([f for f in os.listdir(f"{out}/en") if f.endswith(".bin")]) == p.inventory().filter("source = 'en'").count()
    binshards.export_bin(p.segments().filter("source = 'de'"), out)  # other sources' folders stay
    assert binshards.is_exported(spark, out, "en")
    open(f"{out}/fr/_INCOMPLETE", "w").close()
    with pytest.raises(ValueError, match="did not finish"):
        binshards.bin_files(spark, [f"{out}/fr"])


def test_folders_of_another_writer(spark, tmp_out):
    """No manifest: shards are numbered by their names' numbers, folders of one name stay apart."""
    for folder, n in (("a/fr", 3), ("b/fr", 2)):
        os.makedirs(f"{tmp_out}/{folder}")
        for k, number in enumerate((7, 99_999, 100_000)[:n]):
            np.arange(10 + k, dtype="<u4").tofile(f"{tmp_out}/{folder}/shard_{number:05d}.bin")
    files = binshards.bin_files(spark, [f"{tmp_out}/a/fr", f"{tmp_out}/b/fr"])
    got = sorted((r.source, r.shard_idx, r.n_tokens, r.path.rsplit("_", 1)[1]) for r in files.collect())
    assert got == [("0:fr", 0, 10, "00007.bin"), ("0:fr", 1, 11, "99999.bin"), ("0:fr", 2, 12, "100000.bin"), ("1:fr", 0, 10, "00007.bin"), ("1:fr", 1, 11, "99999.bin")]
    blocks = binshards.read_blocks(files, block_tokens=4, split_tokens=8).filter("source = '0:fr' and shard_idx = 2").orderBy("pos")
    assert [x for r in blocks.collect() for x in r.tokens] == list(range(12))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from corpuspack.session import scratch_dir

    conf = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, applicationId="other", master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(spark)


def test_chat_jsonl_roundtrip(spark, tmp_out):
    chats = spark.createDataFrame(
        [([("user", "안녕 \"hi\""), ("assistant", "é\nok")],)], f"messages {T.MESSAGES_TYPE}")
    sinks.write_chat_jsonl(chats, f"{tmp_out}/chat")
    files = [f for f in os.listdir(f"{tmp_out}/chat") if f.endswith(".json")]
    line = "".join(open(f"{tmp_out}/chat/{f}", encoding="utf-8").read() for f in files).strip()
    assert len(line.splitlines()) == 1
    assert "안녕" in line  # non-ASCII left unescaped
    back = registry.read_chat_jsonl(spark, f"{tmp_out}/chat").first()
    assert [(m.role, m.content) for m in back.messages] == [("user", "안녕 \"hi\""), ("assistant", "é\nok")]
