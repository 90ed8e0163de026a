"""Training windows: shifted targets, start range, brute-force slices, short shards, layout."""

import pytest
from pyspark.sql import functions as F

from corpuspack.operators import windows
from corpuspack.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_windows_equal_slices_of_the_stream(spark):
    p = Q.packed(spark, SF)
    seg = p.segments()
    # brute force: the flat stream of each shard, built on the driver from a small fixture
    streams = {}
    for r in seg.orderBy("source", "shard_idx", "pos").collect():
        streams.setdefault((r.source, r.shard_idx), []).extend(r.tokens)
    L, B = 64, 100
    draws = windows.draw_windows(spark, p.inventory(), 300, L, 7, Q.SOURCE_ORDER)
    w = windows.cut_windows(draws, windows.to_blocks(seg, B), L, B).collect()
    assert len(w) == 300
    for r in w:
        flat = streams[(r.source, r.shard_idx)]
        assert 0 <= r.start <= len(flat) - L - 2
        assert list(r.x) == flat[r.start:r.start + L]
        assert list(r.y) == flat[r.start + 1:r.start + L + 1]
        assert list(r.x[1:]) == list(r.y[:-1])


def test_short_shards_are_refused(spark):
    shards = spark.createDataFrame([("a", 0, 100), ("a", 1, 10)], "source string, shard_idx int, n_tokens bigint")
    with pytest.raises(ValueError, match="a/1"):
        windows.draw_windows(spark, shards, 5, 10, 0, ["a"])


def test_draws_are_deterministic_and_cover_shards(spark):
    shards = spark.createDataFrame([("a", i, 1000) for i in range(3)] + [("b", 0, 500)],
                                   "source string, shard_idx int, n_tokens bigint")
    d1 = windows.draw_windows(spark, shards, 2000, 10, 3, ["a", "b"])
    d2 = windows.draw_windows(spark, shards, 2000, 10, 3, ["a", "b"])
    assert d1.exceptAll(d2).count() == 0
    per = {(r.source, r.shard_idx): r["count"] for r in d1.groupBy("source", "shard_idx").count().collect()}
    assert len(per) == 4 and min(per.values()) > 400  # uniform over shards, whatever their length


def test_batch_layout_roundtrip(spark):
    df = spark.range(1000).withColumnRenamed("id", "sample_id")
    out = windows.batch_layout(df, micro_batch=8, grad_accum=6, ranks=4)
    back = out.select(
        "sample_id", (((F.col("step") * 4 + F.col("rank")) * 6 + F.col("micro")) * 8 + F.col("slot")).alias("b"))
    assert back.filter("sample_id != b").count() == 0
    assert out.filter("rank < 0 or rank >= 4 or micro >= 6 or slot >= 8").count() == 0


def test_write_windows(spark, tmp_out):
    df = windows.batch_layout(spark.range(200).withColumnRenamed("id", "sample_id"), 2, 2, 4)
    windows.write_windows(df, tmp_out + "/w")
    back = spark.read.parquet(tmp_out + "/w")
    assert back.count() == 200 and back.select("rank").distinct().count() == 4
