"""End-to-end jobs: prepare a mixture from registered sources, then export windows."""

import numpy as np
from pyspark.sql import functions as F

from corpuspack.operators import packing
from corpuspack.plans import jobs
from corpuspack.sources import sinks


def _write_source(spark, root, lang, field):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("lang") == lang)
    docs.orderBy("doc_id").select(F.col("text").alias(field)).coalesce(1).write.parquet(f"{root}/train")


def test_prepare_then_windows(spark, tmp_out):
    _write_source(spark, f"{tmp_out}/fwe", "en", "text")
    _write_source(spark, f"{tmp_out}/code", "de", "content")
    sources = {"fineweb-edu": f"{tmp_out}/fwe", "the-stack": f"{tmp_out}/code"}
    out, bins = f"{tmp_out}/packed", f"{tmp_out}/bin"
    budgets = {"fineweb-edu": 100_000, "the-stack": 10**9}
    cut = jobs.prepare_corpus(spark, sources, out, budgets, 16_384, 10, split="train", bin_dir=bins)
    got = {r.source: r for r in cut.collect()}
    assert got["fineweb-edu"].reached and got["fineweb-edu"].kept_tokens >= 100_000
    assert not got["the-stack"].reached and got["the-stack"].kept_tokens == got["the-stack"].total_tokens
    assert jobs.prepare_corpus(spark, sources, out, budgets, 16_384, 10, split="train") is None  # already prepared
    seg = sinks.read_packed(spark, out)
    assert seg.agg(F.sum("n_tokens")).first()[0] == sum(r.kept_tokens for r in got.values())
    first = np.fromfile(f"{bins}/fineweb-edu/shard_00000.bin", dtype="<u4")
    assert len(first) == 16_384
    n = jobs.export_windows(spark, out, f"{tmp_out}/win", seq_len=256, ranks=2, grad_accum=2, micro_batch=4,
                            source_order=["fineweb-edu", "the-stack"])
    w = spark.read.parquet(f"{tmp_out}/win")
    assert w.count() == n and n == sum(r.kept_tokens for r in got.values()) // 256
    assert w.filter(F.size("x") != 256).count() == 0
    assert sorted(r.rank for r in w.select("rank").distinct().collect()) == [0, 1]
    # the same draws from the .bin folders (folder order = shard numbering) give the same windows
    n2 = jobs.export_windows(spark, [f"{bins}/fineweb-edu", f"{bins}/the-stack"], f"{tmp_out}/win2", seq_len=256,
                             ranks=2, grad_accum=2, micro_batch=4)
    w2 = spark.read.parquet(f"{tmp_out}/win2")
    cols = ["sample_id", "source", "shard_idx", "start", "x", "y", "rank", "step"]
    assert n2 == n and w.select(cols).exceptAll(w2.select(cols)).count() == 0


def test_early_stop_reads_a_prefix_and_packs_the_same(spark, tmp_out):
    from pyspark.sql import Window

    from corpuspack.functions.tokens import ByteTokenizer
    from corpuspack.sources import registry

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang") == "en")
    docs = docs.withColumn("_f", F.ntile(20).over(Window.orderBy("doc_id")))
    for k in range(1, 21):
        part = docs.filter(F.col("_f") == k).orderBy("doc_id").select("text")
        part.coalesce(1).write.parquet(f"{tmp_out}/fwe/train/g{k:02d}")
    sources = {"fineweb-edu": f"{tmp_out}/fwe"}
    files = registry.source_files(spark, f"{tmp_out}/fwe", "train/*")
    assert len(files) == 20
    prefix = jobs.budget_prefix(spark, "fineweb-edu", files, 300_000, 65_536, 10, ByteTokenizer())
    assert 0 < len(prefix) < 20
    a = jobs.prepare_corpus(spark, sources, f"{tmp_out}/a", 300_000, 65_536, 10, split="train/*", early_stop=True)
    b = jobs.prepare_corpus(spark, sources, f"{tmp_out}/b", 300_000, 65_536, 10, split="train/*", early_stop=False)
    assert a.collect()[0].kept_tokens == b.collect()[0].kept_tokens
    ia = packing.shard_inventory(sinks.read_packed(spark, f"{tmp_out}/a"))
    ib = packing.shard_inventory(sinks.read_packed(spark, f"{tmp_out}/b"))
    assert ia.exceptAll(ib).count() == 0 and ib.exceptAll(ia).count() == 0
    sa = sinks.read_packed(spark, f"{tmp_out}/a").drop("source", "shard_idx")
    sb = sinks.read_packed(spark, f"{tmp_out}/b").drop("source", "shard_idx")
    assert sa.exceptAll(sb).count() == 0 and sb.exceptAll(sa).count() == 0


def test_cli_prepare_and_windows(spark, tmp_out, capsys):
    _write_source(spark, f"{tmp_out}/fwe", "en", "text")
    out, bins = f"{tmp_out}/packed", f"{tmp_out}/bin"
    jobs.main(["prepare", "--source", f"fineweb-edu={tmp_out}/fwe", "--split", "train", "--out", out,
               "--target-tokens", "50000", "--shard-tokens", "8192", "--batch-docs", "10", "--bin-dir", bins])
    assert "fineweb-edu:" in capsys.readouterr().out
    jobs.main(["prepare", "--source", f"fineweb-edu={tmp_out}/fwe", "--split", "train", "--out", out,
               "--target-tokens", "50000", "--shard-tokens", "8192", "--batch-docs", "10"])
    assert "already prepared" in capsys.readouterr().out
    jobs.main(["windows", "--bin-dirs", f"{bins}/fineweb-edu", "--out", f"{tmp_out}/w", "--seq-len", "128",
               "--ranks", "2"])
    assert "windows to" in capsys.readouterr().out
    summary = packing.inventory_summary(packing.shard_inventory(sinks.read_packed(spark, out))).first()
    assert summary.total_tokens >= 50_000 and summary.total_tokens % 8192 == 0
    assert spark.read.parquet(f"{tmp_out}/w").count() == summary.total_tokens // 128


def test_json_corpus_per_source_skip_and_bin_after_a_crash(spark, tmp_out):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.filter("lang = 'en'").select("text").write.json(f"{tmp_out}/fwe/train")
    docs.filter("lang = 'de'").select(F.col("text").alias("content")).write.json(f"{tmp_out}/code/train")
    out, bins = f"{tmp_out}/packed", f"{tmp_out}/bin"
    one, both = {"fineweb-edu": f"{tmp_out}/fwe"}, {"fineweb-edu": f"{tmp_out}/fwe", "the-stack": f"{tmp_out}/code"}
    first = jobs.prepare_corpus(spark, one, out, None, 16_384, 10, split="train", fmt="json")
    assert [r.source for r in first.collect()] == ["fineweb-edu"]
    second = jobs.prepare_corpus(spark, both, out, None, 16_384, 10, split="train", fmt="json")
    assert [r.source for r in second.collect()] == ["the-stack"]  # the new source only
    totals = {r.source: r.n for r in sinks.read_packed(spark, out).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert totals == {r.source: r.kept_tokens for r in [*first.collect(), *second.collect()]}
    # packed, but the job died before the export: the export is made up for
    again = jobs.prepare_corpus(spark, both, out, None, 16_384, 10, split="train", bin_dir=bins, fmt="json")
    assert again is not None and again.count() == 0
    from corpuspack.sources import binshards

    files = binshards.bin_files(spark, [f"{bins}/fineweb-edu", f"{bins}/the-stack"])
    assert {r.source: r.n for r in files.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} == totals
    assert jobs.prepare_corpus(spark, both, out, None, 16_384, 10, split="train", bin_dir=bins, fmt="json") is None


def test_aligned_shards_give_the_same_windows(spark, tmp_out):
    _write_source(spark, f"{tmp_out}/fwe", "en", "text")
    for name, piece in (("plain", None), ("cut", 1024)):
        jobs.prepare_corpus(spark, {"fineweb-edu": f"{tmp_out}/fwe"}, f"{tmp_out}/{name}", None, 16_384, 10, split="train", piece_tokens=piece)
        jobs.export_windows(spark, f"{tmp_out}/{name}", f"{tmp_out}/w-{name}", seq_len=128, piece_tokens=piece)
    a, b = (spark.read.parquet(f"{tmp_out}/w-{n}") for n in ("plain", "cut"))
    assert a.count() == b.count() > 0 and a.exceptAll(b.select(a.columns)).count() == 0


def test_instruction_jobs(spark, tmp_out):
    import json
    import os

    os.makedirs(f"{tmp_out}/rows")
    with open(f"{tmp_out}/rows/r.json", "w") as f:
        f.write("\n".join(json.dumps({"instruction": f"Ask {i}", "context": "c" if i % 2 else None, "output": f"o{i}"}) for i in range(20)))
    from corpuspack.operators import instruct
    from corpuspack.sources import registry

    scanned = registry.read_instruction_rows(spark, f"{tmp_out}/rows", rename={"context": "input"})
    prompts = instruct.seed_prompts(scanned, 15, 0, "id").collect()
    os.makedirs(f"{tmp_out}/answers")
    with open(f"{tmp_out}/answers/a.json", "w") as f:
        f.write("\n".join(json.dumps({"id": p.id, "response": f"re: {p.prompt}"}) for p in prompts[:10]))
    jobs.main(["prompts", "--rows", f"{tmp_out}/rows", "--rename", "context=input", "--responses", f"{tmp_out}/answers",
               "--out", f"{tmp_out}/chats", "--n", "15"])
    chats = registry.read_chat_jsonl(spark, f"{tmp_out}/chats").collect()
    assert sorted(c.messages[1].content for c in chats) == sorted(f"re: {p.prompt}" for p in prompts[:10])
    jobs.main(["tuning", "--jsonl", f"{tmp_out}/chats", "--out", f"{tmp_out}/set"])
    got = spark.read.parquet(f"{tmp_out}/set").orderBy("position").collect()
    assert [r.position for r in got] == list(range(10)) and all(len(r.ids) == r.n_tokens for r in got)
    pair = {"prompt": "q", "chosen": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "good" * 1000}], "rejected": [{"role": "user", "content": None}]}
    os.makedirs(f"{tmp_out}/prefs/train_prefs")
    with open(f"{tmp_out}/prefs/train_prefs/p.json", "w") as f:
        f.write(json.dumps(pair))
    jobs.main(["pairs", "--prefs", f"{tmp_out}/prefs", "--out", f"{tmp_out}/pairs"])
    r = spark.read.parquet(f"{tmp_out}/pairs").first()
    assert len(r.chosen_ids) == 2048 and r.chosen_truncated and r.rejected_text == "<|im_start|>user\n<|im_end|>\n"


def test_take_n_needs_few_rows(spark):
    from corpuspack.operators.windows import take_shuffled, with_positions

    df = spark.range(5000).withColumnRenamed("id", "k")
    whole = {r.k: r.position for r in with_positions(df, 3, "k").collect()}
    for n in (0, 1, 700, 5000):
        got = {r.k: r.position for r in take_shuffled(df, n, 3, "k").collect()}
        assert got == {k: p for k, p in whole.items() if p < n}
    import pytest

    with pytest.raises(ValueError):
        take_shuffled(df, 5001, 3, "k")
