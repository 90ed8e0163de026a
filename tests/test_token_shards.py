"""The shard store: versions, commits and aborts, pruned reads, windows by range reads; versioned Parquet."""

import json
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, In, StringStartsWith

from corpuspack.operators import packing, window_reads, windows
from corpuspack.plans import jobs
from corpuspack.sources import sinks, tokenshards, versions
from corpuspack.sources.tokenshards import File, ShardReader

SF = "/root/testdata/sf0.001"
S = 4096


def segments(spark, sources, n, first=0, piece=1000):
    """``n`` ids first, first + 1, … of each source, in pieces."""
    rows = []
    for k, source in enumerate(sources):
        at = 0
        while at < n:
            end = min(at + piece, n, (at // S + 1) * S)
            rows.append((source, at // S, at % S, at, end - at, [(first + 7 * k + i) % 50_000 for i in range(at, end)]))
            at = end
    return spark.createDataFrame(rows, sinks.PACKED_SCHEMA)


def ids_of(df):
    out = {}
    for r in df.orderBy("source", "shard_idx", "pos").collect():
        out.setdefault(r.source, []).extend(r.tokens)
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_round_trip(spark, tmp_out, whole):
    seg = segments(spark, ["a", "b"], 10_000)
    tokenshards.write_shards(seg.repartition(5), tmp_out, whole_shards=whole)
    tokenshards.register(spark)
    back = spark.read.format("token_shards").option("blockTokens", 300).load(tmp_out)
    assert ids_of(back) == ids_of(seg)
    assert back.filter(F.size("tokens") > 300).count() == 0
    files = tokenshards.files_of(tmp_out)
    if whole:
        assert [(f.shard_idx, f.n_tokens, os.path.basename(f.path)) for f in files if f.source == "a"] == [
            (0, S, "shard_00000.bin"), (1, S, "shard_00001.bin"), (2, 10_000 - 2 * S, "shard_00002.bin")]
        assert np.fromfile(files[1].path, dtype="<u4").tolist() == ids_of(seg)["a"][S : 2 * S]
    else:
        assert len(files) > 6 and sum(f.n_tokens for f in files) == 20_000


def failing(seg):
    """The segments, but the task that meets shard 1 of source b fails."""
    return seg.withColumn("pos", F.when((F.col("source") == "b") & (F.col("shard_idx") == 1), F.raise_error(F.lit("lost"))).otherwise(F.col("pos")).cast("bigint"))


def test_a_failed_write_leaves_the_old_shards(spark, tmp_out):
    old = segments(spark, ["a", "b"], 9_000)
    tokenshards.write_shards(old, tmp_out)
    before = sorted(os.listdir(f"{tmp_out}/a")), sorted(os.listdir(f"{tmp_out}/b"))
    with pytest.raises(Exception, match="lost"):
        tokenshards.write_shards(failing(segments(spark, ["a", "b"], 9_000, first=100)), tmp_out)
    assert ids_of(tokenshards.read_shards(spark, [f"{tmp_out}/a", f"{tmp_out}/b"])) == ids_of(old)
    assert (sorted(os.listdir(f"{tmp_out}/a")), sorted(os.listdir(f"{tmp_out}/b"))) == before  # its files are gone
    path = f"{tmp_out}/packed"
    sinks.write_packed(old, path)
    with pytest.raises(Exception, match="lost"):
        sinks.write_packed(failing(segments(spark, ["a", "b"], 9_000, first=100)), path)
    assert ids_of(sinks.read_packed(spark, path)) == ids_of(old)


def test_a_gap_is_not_committed(spark, tmp_out):
    with pytest.raises(Exception, match="is missing|are due"):
        tokenshards.write_shards(segments(spark, ["a"], 9_000).filter("pos <> 1000"), tmp_out)
    with pytest.raises(FileNotFoundError):
        tokenshards.files_of(tmp_out)


def test_an_emptied_source_reads_as_empty(spark, tmp_out):
    both = segments(spark, ["a", "b"], 9_000)
    new = segments(spark, ["a"], 5_000, first=3)
    tokenshards.write_shards(both, tmp_out)
    tokenshards.write_shards(new, tmp_out, sources=["a", "b"])
    assert ids_of(tokenshards.read_shards(spark, [f"{tmp_out}/a", f"{tmp_out}/b"])) == ids_of(new)
    path = f"{tmp_out}/packed"
    sinks.write_packed(both, path)
    sinks.write_packed(new, path, sources=["a", "b"])
    assert ids_of(sinks.read_packed(spark, path)) == ids_of(new)
    assert sinks.is_prepared(spark, path, "b") and sinks.read_packed(spark, path, ["b"]).count() == 0
    sinks.write_packed(both.filter("source = 'b'"), path, sources=["b"])  # a stays
    assert ids_of(sinks.read_packed(spark, path)) == {**ids_of(new), "b": ids_of(both)["b"]}


def test_abort_spares_what_was_committed(spark, tmp_out):
    """One source's commit went through before another's failed: its new files stay, the other's go."""
    tokenshards.write_shards(segments(spark, ["a", "b"], 100), tmp_out)
    writer = tokenshards.ShardWriter(tmp_out, ["a", "b"], True)
    for s in "ab":
        os.makedirs(f"{tmp_out}/{s}/{writer.version}")
        np.arange(7, dtype="<u4").tofile(f"{tmp_out}/{s}/{writer.version}/shard_00000.bin")
    versions.commit(tokenshards.STORE, f"{tmp_out}/a", 1, {"shards": [[0, 0, 7, f"{writer.version}/shard_00000.bin"]]})
    writer.abort([])
    assert {s: len(v) for s, v in ids_of(spark.read.format("token_shards").load(tmp_out)).items()} == {"a": 7, "b": 100}
    assert not os.path.exists(f"{tmp_out}/b/{writer.version}")


def test_overwriting_all_and_appending(spark, tmp_out):
    tokenshards.write_shards(segments(spark, ["a", "b"], 5_000), tmp_out)
    tokenshards.write_shards(segments(spark, ["c"], 100), tmp_out)  # no sources named: the others are emptied
    assert ids_of(spark.read.format("token_shards").load(tmp_out)).keys() == {"c"}
    more = segments(spark, ["c"], 2 * S).filter("shard_idx = 1").select("source", "shard_idx", "pos", "tokens")
    more.sortWithinPartitions("pos").coalesce(1).write.format("token_shards").mode("append").save(tmp_out)
    assert [(f.source, f.shard_idx, f.n_tokens) for f in tokenshards.files_of(tmp_out)] == [("c", 0, 100), ("c", 1, S)]
    with pytest.raises(Exception, match="not among"):
        tokenshards.write_shards(segments(spark, ["d"], 10), tmp_out, sources=["c"])


def test_old_versions_are_swept(spark, tmp_out):
    for n in (100, 200, 300, 400):
        tokenshards.write_shards(segments(spark, ["a"], n), tmp_out)
        sinks.write_packed(segments(spark, ["a"], n), f"{tmp_out}/packed")
    assert len([n for n in os.listdir(f"{tmp_out}/a") if n.startswith("v")]) == 2  # the newest and the one before
    assert len([n for n in os.listdir(f"{tmp_out}/packed") if n.startswith("version=")]) == 2
    assert versions.numbers(versions.ArrowStore(), f"{tmp_out}/a") == [3, 4]
    assert versions.numbers(versions.HadoopStore(spark), f"{tmp_out}/packed") == [3, 4]


@pytest.mark.parametrize("hadoop", [False, True])
def test_two_writers_of_one_version(spark, tmp_out, hadoop):
    store = versions.HadoopStore(spark) if hadoop else versions.ArrowStore()
    assert versions.newest(store, tmp_out) is None
    assert versions.commit(store, tmp_out, 0, {"by": "é"}) == 1
    with pytest.raises(FileExistsError, match="another writer"):
        versions.commit(store, tmp_out, 0, {"by": "second"})
    assert versions.newest(store, tmp_out) == (1, {"by": "é"})
    assert [n for n in os.listdir(f"{tmp_out}/_versions") if n.endswith(".tmp")] == []


def test_pruned_files_are_never_opened(spark, tmp_out):
    seg = segments(spark, ["a", "b", "c"], 3 * S)
    tokenshards.write_shards(seg, tmp_out)
    tokenshards.register(spark)
    files = tokenshards.files_of(tmp_out)
    reader = ShardReader(files, 512, 1 << 20)
    left = list(reader.pushFilters([In(("source",), ("a", "c")), GreaterThanOrEqual(("shard_idx",), 2), StringStartsWith(("source",), "x")]))
    assert [type(f) for f in left] == [StringStartsWith]
    assert [(f.source, f.shard_idx) for f in reader.files] == [("a", 2), ("c", 2)]
    assert sum(end - start for p in reader.partitions() for _, start, end in p.stretches) == 2 * S
    for f in files:  # the files that the filter excludes are damaged: reading them would fail
        if not (f.source == "b" and f.shard_idx == 1):
            open(f.path, "wb").close()
    df = spark.read.format("token_shards").load(tmp_out).filter("source = 'b' AND shard_idx = 1")
    assert ids_of(df)["b"] == ids_of(seg)["b"][S : 2 * S]
    with pytest.raises(Exception, match="shorter"):
        spark.read.format("token_shards").load(tmp_out).collect()


def test_partitions_are_even():
    files = [File("a", i, 0, n, str(i)) for i, n in enumerate([10, 20, 5000, 1, 0, 999])]
    parts = ShardReader(files, 100, 1000).partitions()
    sizes = [sum(e - s for _, s, e in p.stretches) for p in parts]
    assert sum(sizes) == 6030 and max(sizes) <= 1000 and len(parts) <= 8
    assert [(f.path, i) for p in parts for f, s, e in p.stretches for i in range(s, e)] == [(f.path, i) for f in files for i in range(f.n_tokens)]


def test_folders_of_other_tools(spark, tmp_out):
    for folder in ("x/en", "y/en"):
        os.makedirs(f"{tmp_out}/{folder}")
        for number in (2, 10):
            np.arange(number, dtype="<u4").tofile(f"{tmp_out}/{folder}/shard_{number:05d}.bin")
    files = tokenshards.files_of(None, [f"{tmp_out}/y/en", f"{tmp_out}/x/en"])
    assert [(f.source, f.shard_idx, f.n_tokens) for f in files] == [("0:en", 0, 2), ("0:en", 1, 10), ("1:en", 0, 2), ("1:en", 1, 10)]
    assert tokenshards.read_shards(spark, [f"{tmp_out}/x/en"]).agg(F.sum(F.size("tokens"))).first()[0] == 12
    open(f"{tmp_out}/x/en/_INCOMPLETE", "w").close()
    with pytest.raises(ValueError, match="did not finish"):
        tokenshards.files_of(None, [f"{tmp_out}/x/en"])


# --------------------------------------------------------------------------- windows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 200_000), st.integers(1, 3000)), max_size=40))
def test_stretches_cover_each_range_once(rows):
    rows = sorted(rows)
    groups = list(window_reads.stretches(rows))
    assert [i for a, b in groups for i in range(a, b)] == list(range(len(rows)))
    for a, b in groups:
        assert len({r[0] for r in rows[a:b]}) == 1
        span = max(f + n for _, f, n in rows[a:b]) - rows[a][1]
        assert span * 4 <= window_reads.READ_BYTES or b == a + 1
        ends = [max(f + n for _, f, n in rows[a:i]) for i in range(a + 1, b)]
        assert all(rows[i][1] - e <= window_reads.GAP_BYTES // 4 for i, e in zip(range(a + 1, b), ends))


@pytest.mark.parametrize("whole", [True, False])
def test_windows_equal_slices_and_the_block_join(spark, tmp_out, whole):
    """Also where a window goes on in the next file of its shard, and behind the end of a short shard."""
    L = 200
    seg = segments(spark, ["a", "b"], 10_000, piece=130).repartition(40, "pos")
    tokenshards.write_shards(seg, tmp_out, whole_shards=whole)
    files = tokenshards.files_table(spark, tokenshards.files_of(tmp_out))
    draws = windows.draw_windows(spark, packing.shard_inventory(files), 700, L, 5, ["a", "b"])
    got = window_reads.cut_windows_by_range(draws, files, L)
    flat = ids_of(seg)
    for r in got.collect():
        ids = flat[r.source][r.shard_idx * S : (r.shard_idx + 1) * S][r.start : r.start + L + 1]
        assert list(r.x) == ids[:-1] and list(r.y) == ids[1:]
    want = windows.cut_windows(draws, windows.to_blocks(seg, 512), L, 512).select(got.columns)
    assert got.count() == 700 and sorted(got.collect()) == sorted(want.collect())
    late = spark.createDataFrame([(0, "a", 2, 10_000 - 2 * S - 50)], "sample_id bigint, source string, shard_idx int, start bigint")
    short = window_reads.cut_windows_by_range(late, files, L).first()
    assert list(short.x) == flat["a"][-50:] and list(short.y) == flat["a"][-49:]


def test_no_ids_are_exchanged(spark, tmp_out):
    tokenshards.write_shards(segments(spark, ["a"], 9_000), tmp_out)
    files = tokenshards.files_table(spark, tokenshards.files_of(tmp_out))
    draws = windows.draw_windows(spark, packing.shard_inventory(files), 300, 100, 5, ["a"])
    cut = window_reads.cut_windows_by_range(draws, files, 100)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Repartition" not in top and "Join" not in top and "Aggregate" not in top
    assert "tokens" not in plan.replace("n_tokens", "")


# --------------------------------------------------------------------------- A10


def test_prepare_again_when_input_or_options_change(spark, tmp_out):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").select("text")
    docs.coalesce(1).write.parquet(f"{tmp_out}/fwe/train")
    run = lambda **more: jobs.prepare_corpus(
        spark, {"fineweb-edu": f"{tmp_out}/fwe"}, f"{tmp_out}/out", **{"targets": None, "shard_tokens": 8192, "batch_docs": 10, "split": "train", **more})
    total = lambda: sinks.read_packed(spark, f"{tmp_out}/out").agg(F.sum("n_tokens")).first()[0]
    assert run() is not None and run() is None
    whole = total()
    assert run(targets=20_000) is not None and 20_000 <= total() < whole
    assert run(targets=20_000) is None
    assert run(targets=20_000, shard_tokens=4096) is not None and run(piece_tokens=1024) is not None and total() == whole
    docs.limit(3).coalesce(1).write.mode("append").parquet(f"{tmp_out}/fwe/train")  # the input grows
    assert run(piece_tokens=1024) is not None and total() > whole
    assert run(piece_tokens=1024) is None and run(piece_tokens=1024, force=True) is not None


def test_manifest_text(spark, tmp_out):
    sinks.write_packed(segments(spark, ["é/x"], 10), tmp_out)
    content = json.load(open(f"{tmp_out}/_versions/00000001.json", encoding="utf-8"))
    assert list(content["sources"]) == ["é/x"] and ids_of(sinks.read_packed(spark, tmp_out)) == {"é/x": list(range(10))}
