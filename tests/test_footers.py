"""Budget prefixes from Parquet footers: what is read, and that nothing changes."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuspack.functions.tokens import ByteTokenizer
from corpuspack.operators import packing
from corpuspack.plans import jobs
from corpuspack.sources import footers, registry, sinks

SPEC = registry.lookup("fineweb-edu")


def write_source(root, texts, per_file, per_group, **options):
    os.makedirs(f"{root}/train")
    for k, at in enumerate(range(0, len(texts), per_file)):
        table = pa.table({"text": pa.array(texts[at : at + per_file], pa.string()), "other": ["x" * 50] * len(texts[at : at + per_file])})
        pq.write_table(table, f"{root}/train/part-{k:03d}.parquet", row_group_size=per_group, **options)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").orderBy("doc_id").select("text").collect()
    return [r.text for r in rows]


def test_index(spark, tmp_out, texts):
    write_source(tmp_out, texts[:70], 30, 8)
    files = registry.source_files(spark, tmp_out)
    index = sorted(footers.row_groups(spark, files, "text").collect(), key=lambda g: (g.file_no, g.row_group))
    assert [(g.file_no, g.row_group, g.first_row, g.n_rows) for g in index[:5]] == [(0, 0, 0, 8), (0, 1, 8, 8), (0, 2, 16, 8), (0, 3, 24, 6), (1, 0, 0, 8)]
    assert sum(g.n_rows for g in index) == 70
    scan = footers.group_scan(spark, [index[1], index[5]], "text").orderBy("_file", "_row").collect()
    assert [r.text for r in scan] == texts[8:16] + texts[38:46] and [r._row for r in scan] == [*range(8, 16), *range(8, 16)]
    assert {r._file for r in scan} <= {r._file for r in registry.text_scan(spark, SPEC, files).select("_file").distinct().collect()}


@pytest.mark.parametrize("per_file,per_group", [(40, 5), (1000, 6), (7, 100)])
def test_reads_at_most_a_fifth_more_than_needed(spark, tmp_out, texts, per_file, per_group):
    write_source(f"{tmp_out}/src", texts, per_file, per_group)
    target, S, B = 400_000, 65_536, 10
    files = registry.source_files(spark, f"{tmp_out}/src")
    prefix, index = footers.budget_prefix(spark, SPEC, files, target, S, B, ByteTokenizer())
    run = lambda out, early: jobs.prepare_corpus(
        spark, {"fineweb-edu": f"{tmp_out}/src"}, f"{tmp_out}/{out}", target, S, B, split="train", early_stop=early).first()
    a, b = run("a", True), run("b", False)
    assert a.kept_tokens == b.kept_tokens and a.reached
    got, want = (sinks.read_packed(spark, f"{tmp_out}/{n}").drop("version") for n in "ab")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    needed = sum(len(t.encode()) for t in texts[: b.last_seq + 1])
    read = prefix.scan(spark, SPEC, index).agg(F.sum(F.octet_length("text"))).first()[0]
    assert needed <= read <= 1.2 * needed
    size = lambda g: sum(len(t.encode()) for t in texts[g.file_no * per_file + g.first_row :][: g.n_rows])
    assert sum(map(size, prefix.groups)) <= 1.2 * needed + max(map(size, index))  # what is fetched ends with a row group
    assert sum(map(size, prefix.counted)) <= 1.2 * needed + max(map(size, index))


@pytest.mark.parametrize("target", [1, 2_000, 60_000, 10**9])
def test_awkward_sources(spark, tmp_out, texts, target):
    """Nulls and empty texts, copies that a dictionary shrinks, files without rows, budgets at either end."""
    rows = [None, "", "a"] * 20 + [texts[0]] * 60 + [""] * 50 + texts[:40] + [None] * 30 + texts[40:60]
    write_source(f"{tmp_out}/src", rows, 45, 9, use_dictionary=True)
    pq.write_table(pa.table({"text": pa.array([], pa.string()), "other": pa.array([], pa.string())}), f"{tmp_out}/src/train/part-001a.parquet")
    files = registry.source_files(spark, f"{tmp_out}/src")
    prefix, index = footers.budget_prefix(spark, SPEC, files, target, 1000, 7, ByteTokenizer())
    cut = lambda docs: packing.pack(docs, 1000, target, 7).cut.first()
    read = lambda **more: registry.read_source(spark, "fineweb-edu", f"{tmp_out}/src", **more)
    early, full = cut(read(scan=prefix.scan(spark, SPEC, index))), cut(read())
    assert early.kept_tokens == full.kept_tokens and early.reached == full.reached
    if full.reached:
        assert early.last_seq == full.last_seq
    assert (len(prefix.groups) == len(index)) or full.reached


def test_stores_that_tasks_cannot_open():
    assert footers.readable(["/a/b", "file:///a", "hdfs://n/a"]) and not footers.readable(["/a", "viewfs://c/a"])


def test_a_missing_field_is_an_error(spark, tmp_out):
    pq.write_table(pa.table({"body": ["x"]}), f"{tmp_out}/p.parquet")
    with pytest.raises(ValueError, match="no column"):
        footers.budget_prefix(spark, SPEC, [f"file://{tmp_out}/p.parquet"], 10, 10, 10, ByteTokenizer())
