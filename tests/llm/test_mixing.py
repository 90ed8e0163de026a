import duckdb
import numpy as np
import pytest

from corpuspack.llm import mixing
from corpuspack.llm.queries import op2_poisson_mixing
from tests.conftest import SF_SMALL


def test_query_against_sql(spark):
    got = op2_poisson_mixing(spark, SF_SMALL)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = con.sql(mixing.MIX_SQL)
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_weights_are_met_and_copies_are_poisson(spark, docs_of):
    rows = [(i, "x" * 100, "en", "big" if i % 10 else "small") for i in range(6000)]
    df = mixing.mix(docs_of(rows), {"big": 1.0, "small": 1.0, "absent": 3.0})
    counts = {r["source"]: r["count"] for r in df.groupBy("source").count().collect()}
    assert counts["big"] == pytest.approx(3000, rel=0.06) and counts["small"] == pytest.approx(3000, rel=0.06)
    own = np.array([r["count"] for r in df.filter("source = 'small'").groupBy("doc_id").count().collect()])
    assert own.mean() == pytest.approx(5.0, rel=0.06) and own.var() == pytest.approx(5.0, rel=0.25)


def test_large_rates_are_sums_of_draws(spark, docs_of):
    df = docs_of([(i, "y" * 1000, "en", "base") for i in range(400)] + [(1000 + i, "z" * 10, "en", "tiny") for i in range(40)])
    table = mixing.rates(df, {"base": 1.0, "tiny": 1.0})
    assert max(r["draws"] for r in table.collect()) > 1
    copies = mixing.replicate(df, table).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in copies}["tiny"] == pytest.approx(20020, rel=0.05)


def test_same_in_every_run_and_order(spark, docs_of):
    rows = [(i, "t" * (i % 50), "en", f"s{i % 3}") for i in range(300)]
    a = mixing.mix(docs_of(rows)).select("doc_id", "copy", "shuffle_key").collect()
    b = mixing.mix(docs_of(rows[::-1]).repartition(7)).select("doc_id", "copy", "shuffle_key").collect()
    assert sorted(a) == sorted(b) and [r["doc_id"] for r in a[:20]] != sorted(r["doc_id"] for r in a[:20])
    other = mixing.mix(docs_of(rows), seed=5).select("doc_id", "copy", "shuffle_key").collect()
    assert sorted(other) != sorted(a)


def test_odd_rows(spark, docs_of):
    rows = [(1, None, "en", None), (2, "", "en", "empty"), (None, "abc", "en", "a"), (3, "abc", "en", "a"), (3, "abc", "en", "a"), (4, "w " * 50000, "en", None)]
    df = mixing.mix(docs_of(rows, extra=("copy", "_copies", "rate", "cdf")), {"a": 1.0, "empty": 1.0})
    got = [tuple(r) for r in df.select("doc_id", "source").collect()]
    assert all(s in ("a", "empty") for _, s in got)  # a source without a weight gets none
    default = mixing.mix(docs_of(rows, extra=("size",)))
    n = [r["doc_id"] for r in default.collect()]
    assert n.count(3) % 2 == 0  # equal ids, equal numbers of copies
    assert {r["_source"] for r in mixing.rates(docs_of(rows)).collect()} == {"{}", '{"source":"empty"}', '{"source":"a"}'}
    assert mixing.mix(docs_of([])).count() == 0
