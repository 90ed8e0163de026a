"""Mixture budgets drive one multi-source pack (E1, E2); instruction, chat and pair scans."""

import json

import pytest
from pyspark.sql import functions as F

from corpuspack.functions import text as T
from corpuspack.operators import instruct, mixture, packing
from corpuspack.sources import registry


def test_repeated_lines_get_ids_of_their_own(spark, tmp_out):
    line = json.dumps({"messages": [{"role": "user", "content": "same"}]})
    for name, order in (("a", [line] * 70_000 + ['{"messages": []}']), ("b", ['{"messages": []}'] + [line] * 70_000)):
        with open(f"{tmp_out}/{name}.jsonl", "w") as f:
            f.write("\n".join(order))
    a, b = (registry.read_chat_jsonl(spark, f"{tmp_out}/{n}.jsonl") for n in "ab")
    assert a.count() == a.select("id").distinct().count() == 70_001
    assert a.select("id").exceptAll(b.select("id")).count() == 0  # the same ids in any order of lines
    mix = instruct.tuning_mix(jsonl=a)
    assert mix.agg(F.max("position")).first()[0] == 70_000


def test_a_malformed_line_is_an_error(spark, tmp_out):
    with open(f"{tmp_out}/x.jsonl", "w") as f:
        f.write('{"messages": []}\n{"messages": [}\n')
    with pytest.raises(Exception):
        registry.read_chat_jsonl(spark, f"{tmp_out}/x.jsonl").collect()


def test_json_corpus_and_its_stream_order(spark, tmp_out):
    import os

    os.makedirs(f"{tmp_out}/s/train")
    for k in (1, 0):
        with open(f"{tmp_out}/s/train/f{k}.json", "w") as f:
            f.write("\n".join(json.dumps({"content": f"{k}-{i}", "other": 1} if i != 2 else {"other": 2}) for i in range(5)) + "\n")
    got = registry.read_source(spark, "the-stack", f"{tmp_out}/s", fmt="json").orderBy("doc_seq").collect()
    assert [r.doc_seq for r in got] == list(range(10))
    assert [r.text for r in got] == [None if i == 2 else f"{k}-{i}" for k in (0, 1) for i in range(5)]
    with open(f"{tmp_out}/s/train/f2.json", "w") as f:
        f.write('{"content": \n')
    with pytest.raises(Exception):
        registry.read_source(spark, "the-stack", f"{tmp_out}/s", fmt="json").collect()
    spark.range(3).write.parquet(f"{tmp_out}/p/train")
    with pytest.raises(ValueError, match="no column"):
        registry.read_source(spark, "the-stack", f"{tmp_out}/p").count()


def test_the_budget_filter_lies_below_the_text_shuffle(spark):
    docs = registry.fixture_docs(spark, "/root/testdata/sf0.01")
    plan = packing.pack(docs, shard_tokens=4096, targets=20_000, batch_docs=10).segments()
    text = plan._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in text.split("\n") if "Exchange hashpartitioning(source" in line)
    below = text[text.index(exchange) + len(exchange):]
    assert "last_seq" in below and "kept_tokens" not in below.split("FileScan")[0].replace("last_seq", "")


def test_budgets():
    v = mixture.mixture_budgets("validate")
    assert v == {"fineweb-edu": 8_000_000_000, "fineweb-2-kor": 2_500_000_000, "the-stack": 1_500_000_000}
    assert mixture.mixture_budgets("anything")["fineweb-edu"] == 65_000_000_000


def test_budgets_drive_one_pack_over_the_union(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    parts = [docs.filter(F.col("lang") == lang).select(F.lit(name).alias("source"), F.col("doc_id").alias("doc_seq"), "text")
             for lang, name in [("en", "fineweb-edu"), ("de", "fineweb-2-kor"), ("fr", "the-stack")]]
    mixed = mixture.union_sources(parts)
    # scaled-down budgets: the ratios of the validate scale, 1/50,000th
    budgets = {k: v // 50_000 for k, v in mixture.mixture_budgets("validate").items()}
    p = packing.pack(mixed, shard_tokens=8192, targets=budgets, batch_docs=10)
    cut = {r.source: r for r in p.cut.collect()}
    for src, t in budgets.items():
        if cut[src].reached:
            assert cut[src].kept_tokens >= t and cut[src].kept_tokens % 8192 == 0
        else:
            assert cut[src].kept_tokens == cut[src].total_tokens < -(-t // 8192) * 8192
    w = {r.source: r for r in mixture.mix_weights(p.inventory()).collect()}
    assert abs(sum(r.shard_weight for r in w.values()) - 1) < 1e-12
    with pytest.raises(ValueError):
        mixture.union_sources([])


def test_instruction_scan_renames(spark, tmp_out):
    rows = [{"instruction": "Say", "context": "ctx", "response": "hi", "extra": 1}, {"instruction": "Only"}]
    path = f"{tmp_out}/dolly.jsonl"
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    df = registry.read_instruction_rows(spark, path, rename={"context": "input"})
    assert df.columns == ["id", "instruction", "input", "output", "response"]
    got = sorted(instruct.rows_to_chats(df).collect(), key=lambda r: r.messages[0].content)
    assert [m.content for m in got[0].messages] == ["Only", ""]
    assert [m.content for m in got[1].messages] == ["Say\n\nctx", "hi"]


def test_chat_and_pair_scans(spark, tmp_out):
    chats = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], f"id bigint, messages {T.MESSAGES_TYPE}")
    chats.write.parquet(f"{tmp_out}/ultra/train_sft")
    assert registry.read_chats(spark, f"{tmp_out}/ultra").columns == ["id", "messages"]
    pair = {"pair_id": 1, "prompt": "q", "chosen": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "good"}],
            "rejected": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "bad"}]}
    import os

    os.makedirs(f"{tmp_out}/prefs/train_prefs")
    with open(f"{tmp_out}/prefs/train_prefs/part.json", "w") as f:
        f.write(json.dumps(pair))
    prefs = registry.read_preference_pairs(spark, f"{tmp_out}/prefs")
    out = instruct.preference_pairs(prefs).first()
    assert out.chosen_text.endswith("good<|im_end|>\n") and not out.chosen_truncated


def test_corpora_of_more_text_have_more_files(spark, monkeypatch):
    """The files that queries write as registered corpora grow in number, not in size, and give the same shards."""
    import os

    from corpuspack.plans import queries as Q

    sf, counts = "/root/testdata/sf0.001", {}
    for size in (64 << 20, 10_000):
        monkeypatch.setattr(Q, "FILE_BYTES", size)
        own = Q._corpora(spark, sf)["fineweb-edu"]
        counts[size] = sum(f.endswith(".parquet") for f in os.listdir(f"{own}/train"))
    assert counts[64 << 20] == 4 < counts[10_000]
