"""Streams whose files arrive in any order: state store, restart, replay, gaps, late files."""

import os

import pytest
from pyspark.sql import functions as F

from corpuspack.operators import packing
from corpuspack.plans import queries as Q
from corpuspack.sources.registry import fixture_docs
from corpuspack.streaming import ordered

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id BIGINT, text STRING"
TARGETS = {"en": 120_000, "de": None, "fr": 30_000, "es": 10**9}
S, B = 8192, 7
COLUMNS = ["source", "shard_idx", "pos", "doc_seq", "n_tokens", "tokens"]


def write_file(spark, root, seq, low, high, lang=None):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter((F.col("doc_id") >= low) & (F.col("doc_id") < high))
    docs = docs.filter(F.col("lang") == lang) if lang else docs
    part = docs.select("doc_id", "text", F.col("lang").alias("source"), F.lit(seq).alias("seq"))
    part.repartition(1, "source").write.mode("append").partitionBy("source", "seq").parquet(root)


def stream(spark, root, appender, lateness=None, files=4):
    raw = ordered.read_files(spark, root, SCHEMA, files)
    docs = raw.select(F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"), "file_seq", "path", "text")
    ordered.start_ordered(docs, appender, lateness).awaitTermination()


def appender_for(spark, tmp_out, targets=TARGETS):
    return ordered.OrderedAppender(spark, f"{tmp_out}/out", SCHEMA, S, targets, B)


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def batch_rows(spark, targets=TARGETS, docs=None):
    docs = docs if docs is not None else fixture_docs(spark, SF)
    return rows(packing.pack(docs, S, targets, B).segments())


def test_out_of_order_over_several_runs_equals_the_batch(spark, tmp_out):
    """Three runs of one stream (state and output outlive each), files out of order within and across them."""
    root = f"{tmp_out}/src"
    app = appender_for(spark, tmp_out)
    for run in ((3, 1), (4, 0), (2,)):
        for k in run:
            write_file(spark, root, k, 40 * k, 40 * k + 40)
        stream(spark, root, appender_for(spark, tmp_out))
        if run == (3, 1):  # file 0 is missing: nothing is let go, and closing is an error
            assert app.segments().count() == 0 and {r.n_held for r in app.progress().collect()} == {2}
            with pytest.raises(ValueError, match="files are missing"):
                app.finish()
    app.finish()
    app.finish()  # closing again changes nothing
    assert rows(app.segments()) == batch_rows(spark)
    assert {r.source: r.n_held for r in app.progress().collect()} == dict.fromkeys(TARGETS, 0)
    assert len([n for n in os.listdir(f"{app.out_dir}/_versions") if n.endswith(".json")]) <= 2  # no list that grows


def test_restart_after_a_crash_and_replay(spark, tmp_out):
    """A batch dies after its segments were written and before its commit; the next run plays it again."""
    root = f"{tmp_out}/src"
    for k in (1, 0, 2):
        write_file(spark, root, k, 70 * k, 70 * k + 70)

    class Dying(ordered.OrderedAppender):
        def _commit(self, number, sources, **more):
            if number == 1:
                raise RuntimeError("power cut")
            super()._commit(number, sources, **more)

    with pytest.raises(Exception, match="power cut"):
        stream(spark, root, Dying(spark, f"{tmp_out}/out", SCHEMA, S, TARGETS, B))
    app = appender_for(spark, tmp_out)
    before = app._newest()[0]
    assert before == 1 and os.path.isdir(f"{app.out_dir}/segments")
    stream(spark, root, app)
    done = app._newest()[0]
    replayed = spark.read.parquet(f"{app.out_dir}/released/batch_id={done - 1}")
    app(spark.createDataFrame(replayed.collect(), replayed.schema), done - 1)
    assert app._newest()[0] == done  # a committed batch played again changes nothing
    app.finish()
    assert rows(app.segments()) == batch_rows(spark)


def test_a_file_given_up(spark, tmp_out):
    """With lateness 2 file 1 is given up when file 3 has come; what arrives of it later is late."""
    root = f"{tmp_out}/src"
    for k in (0, 2, 3):
        write_file(spark, root, k, 50 * k, 50 * k + 50, "en")
    app = appender_for(spark, tmp_out, None)
    stream(spark, root, app, lateness=2, files=1)
    write_file(spark, root, 1, 50, 100, "en")
    stream(spark, root, app, lateness=2, files=1)
    app.finish()
    docs = fixture_docs(spark, SF).filter("source = 'en' and not (doc_seq between 50 and 99)")
    assert rows(app.segments()) == batch_rows(spark, None, docs)
    assert [(r.source, r.n_held, r.n_late) for r in app.progress().collect()] == [("en", 0, 1)]


def test_unfinished_streams_end_at_whole_batches(spark, tmp_out):
    root = f"{tmp_out}/src"
    write_file(spark, root, 0, 0, 200, "en")
    app = appender_for(spark, tmp_out, None)
    stream(spark, root, app)
    n_docs = app.progress().first().n_docs
    seen = app.segments().select("doc_seq").distinct().count()
    assert n_docs % B and seen == n_docs - n_docs % B
    app.finish()
    assert rows(app.segments()) == batch_rows(spark, None, fixture_docs(spark, SF).filter("source = 'en'"))


def test_files_of_a_full_source_are_not_read(spark, tmp_out):
    app = appender_for(spark, tmp_out, {"a": 20_000})
    file = lambda seq, first_token, n_docs=5, n_tokens=10_000: {"source": "a", "file_seq": seq, "path": str(seq), "n_docs": n_docs, "n_tokens": n_tokens, "first_token": first_token}
    files = [file(k, 10_000 * k) for k in range(8)]
    # the budget is 24,576 when rounded: crossed in file 2; seven more documents lie in files 3 and 4
    assert [r["file_seq"] for r in app._needed(files, {})] == [0, 1, 2, 3, 4]
    assert app._needed(files, {"a": {"kept": 24_576}}) == []
    assert [r["file_seq"] for r in app._needed([file(0, 0, 0, 0), file(1, 0)], {})] == [1]


def test_empty_texts_and_numbers_of_files(spark, tmp_out):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "xy")], SCHEMA)
    docs.coalesce(1).write.parquet(f"{tmp_out}/src/source=a/seq=1")
    docs.filter("doc_id < 3").coalesce(1).write.parquet(f"{tmp_out}/src/source=a/seq=0")  # a file without documents still arrives
    app = ordered.pack_files_in_order(spark, f"{tmp_out}/src", f"{tmp_out}/out", SCHEMA, S, None, B)
    assert rows(app.segments()) == [("a", 0, 0, 3, 3, [120, 121, 256])]
    paths = ["/x/source=a/seq=12/part-00003-u.c000.parquet", "/x/part-00003-u.c000.parquet", "/x/seq=x/file.json"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(ordered.file_number(F.col("p")).alias("n")).collect()
    assert [r.n for r in got] == [12, 3, None]


def test_query_arrival_is_really_out_of_order(spark):
    assert sorted(Q.ARRIVAL) == [0, 1, 2, 3] != list(Q.ARRIVAL)
    root = Q._files_out_of_order(spark, SF)
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{root}/source=en") for f in names if f.endswith(".parquet")]
    by_time = sorted(files, key=os.path.getmtime)
    assert [int(p.split("seq=")[1].split("/")[0]) for p in by_time] == list(Q.ARRIVAL)


def documents(spark, at, rows):
    spark.createDataFrame([(k, text, lang, "s", len(text)) for k, text, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def test_sources_without_documents_in_a_range_have_no_gap(spark, tmp_out, monkeypatch):
    """A source's files are numbered one after the other, and its documents lie in more files as they grow."""
    monkeypatch.setattr(Q, "TARGETS", {"en": None, "es": None})
    at = documents(spark, tmp_out, [(k, "abc", "es" if k in (0, 11) else "en") for k in range(12)])
    want = {(0, "97,98,99,256"), (11, "97,98,99,256")}
    for size in (64 << 20, 5):
        monkeypatch.setattr(Q, "FILE_BYTES", size)
        got = Q.stream_shards_reordered(spark, at).filter("source = 'es'").collect()
        assert {(r.doc_seq, r.tokens_csv) for r in got} == want and {r.pos for r in got} == {0, 4}


def test_a_file_of_few_long_documents_is_placed_by_more_tasks(spark, tmp_out, monkeypatch):
    write_file(spark, f"{tmp_out}/src", 0, 0, 10**9)
    called = []
    shared = ordered.packing.exclusive_prefix_sums
    monkeypatch.setattr(ordered, "FILE_TOKENS", 1000)
    monkeypatch.setattr(ordered.packing, "exclusive_prefix_sums", lambda *a, **k: called.append(a) or shared(*a, **k))
    app = ordered.pack_files_in_order(spark, f"{tmp_out}/src", f"{tmp_out}/out", SCHEMA, S, TARGETS, B)
    assert called and rows(app.segments()) == batch_rows(spark)


def test_query_files_grow_in_number(spark, monkeypatch):
    root = Q._files_out_of_order(spark, SF, 5)
    numbers = sorted(int(d.split("=")[1]) for d in os.listdir(f"{root}/source=en") if d.startswith("seq="))
    assert numbers == list(range(20))


def test_a_source_is_not_one_tasks_read(spark, tmp_out, capsys):
    """The cuts are broadcast: no exchange brings all segments of a source together."""
    write_file(spark, f"{tmp_out}/src", 0, 0, 60)
    app = ordered.pack_files_in_order(spark, f"{tmp_out}/src", f"{tmp_out}/out", SCHEMA, S, TARGETS, B)
    app.segments().explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
