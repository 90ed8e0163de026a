import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from corpuspack.llm import mixing, packing, quality_rules
from corpuspack.llm.common import documents
from corpuspack.llm.queries import op4_counterfactual_toxicity
from corpuspack.session import materialize
from tests.conftest import SF_SMALL
from tests.llm.test_near_dedup import brute_force
from tests.llm.test_packing import check_sequences


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_each_stage_against_its_own_input(spark):
    columns = documents(spark, SF_SMALL).columns
    docs = rows_of(documents(spark, SF_SMALL))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "mixing", "packing"]
    kept = {}
    table = documents(spark, SF_SMALL)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF_SMALL)
        assert out.columns == columns
        kept[name], table = rows_of(out), materialize(out, f"test-{name}")
        if name == "quality_rules":
            judged = quality_rules.quality_rules(spark.createDataFrame(kept["toxicity"], table.schema))
            good = {r["doc_id"] for r in judged.collect() if r["kept"]}
            assert kept[name] == [r for r in kept["toxicity"] if r[0] in good]
        if name == "near_dedup":
            groups = brute_force([r[:2] for r in kept["quality_rules"]], 80)
            assert kept[name] == [r for r in kept["quality_rules"] if groups[r[0]][1] == r[0]]
        if name == "mixing":
            want = mixing.mix(spark.createDataFrame(kept["near_dedup"], table.schema))
            assert kept[name] == rows_of(want.select(*columns)) and set(kept[name]) <= set(kept["near_dedup"])
    toxic = {r["doc_id"] for r in op4_counterfactual_toxicity(spark, SF_SMALL).collect() if r["predicted"]}
    assert kept["toxicity"] == [r for r in docs if r[0] not in toxic] and toxic
    packed = corpus_pipeline.STAGES[-1][1](spark, table, SF_SMALL).collect()
    check_sequences(packed, packing.Limits())
    assert sum(r["piece"] == 0 for r in packed) == len(kept["mixing"])
    assert sorted(r["length"] for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == sorted(r["length"] for r in packed)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, "x"), (2, "")]])
def test_odd_documents_pass_every_stage(spark, docs_of, rows):
    docs = docs_of(rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF_SMALL), f"test-odd-{name}")
    assert docs.count() == 0  # without fifty words nothing passes the quality rules


def test_stages_leave_columns_as_they_are(spark):
    """Columns named like an operator's own come back with their values from every stage."""
    names = ["score", "held_out", "predicted", "_cdf", "_u", "_source", "_copies", "_draws", "copy", "shuffle_key", "_row", "node", "text_key", "set_hash", "_group", "kept", "distance", "n_words", "label"]
    docs = documents(spark, SF_SMALL)
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF_SMALL), f"test-clash-{name}")
        assert docs.columns == [*documents(spark, SF_SMALL).columns, *names]
        rows = docs.collect()
        assert len(rows) > 50 and all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() >= docs.count()
