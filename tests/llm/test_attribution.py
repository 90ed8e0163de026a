import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuspack.llm import attribution
from corpuspack.llm.common import documents
from corpuspack.llm.queries import op9_token_attribution
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def by_token(reference, text, spans, rule):
    """Token by token from the library's own pieces: byte spans, overlaps, the rule."""
    at = 0
    from corpuspack.llm import bpe

    lengths = bpe.load(open(bpe.default_path()).read()).lengths
    counts = [0.0] * len(spans)
    spans = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans]
    for i in reference.encode(text, add_special_tokens=False).ids:
        a, b = at, at + int(lengths[i])
        at = b
        over = [max(0, min(b, e) - max(a, s)) for s, e in spans]
        if not any(over):
            continue
        if rule == "split":
            for k, o in enumerate(over):
                counts[k] += o / (b - a)
        elif rule == "most":
            counts[over.index(max(over))] += 1
        else:
            at_byte = a if rule == "first" else b - 1
            for k, (s, e) in enumerate(spans):
                counts[k] += s <= at_byte < e
    return counts


def test_query_against_brute_force(spark, reference):
    rows = op9_token_attribution(spark, SF_MID).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    docs = documents(spark, SF_MID).collect()
    assert got.keys() == {d["doc_id"] for d in docs}
    for d in docs:
        own = sorted(got[d["doc_id"]], key=lambda r: r["line"])
        ids = reference.encode(d["text"], add_special_tokens=False).ids
        assert sum(r["n_tokens"] for r in own) == len(ids)
        assert own[0]["start"] == 0 and own[-1]["end"] == len(d["text"]) and len(own) == d["text"].count("\n") + 1
        assert all(x["end"] == y["start"] for x, y in zip(own, own[1:]))
        if len(d["text"]) < 1500:
            assert [r["n_tokens"] for r in own] == by_token(reference, d["text"], [(r["start"], r["end"]) for r in own], "most")


@pytest.mark.parametrize("rule", attribution.RULES)
def test_rules_on_crossing_tokens(spark, docs_of, reference, rule):
    text = "one\n\n\ntwo  thrée 🙂🙂 fourteenth\n"
    spans = [(0, 2), (2, 5), (5, 5), (6, 9), (12, 17), (17, 18), (18, 30)]
    column = F.array(*[F.struct(F.lit(str(i)).alias("section"), F.lit(a).alias("start"), F.lit(b).alias("end")) for i, (a, b) in enumerate(spans)])
    rows = attribution.token_counts(docs_of([(1, text)]), F.col("text"), column, rule).orderBy(F.col("section").cast("int")).collect()
    assert [r["n_tokens"] for r in rows] == pytest.approx(by_token(reference, text, spans, rule))
    assert sum(r["n_crossing"] for r in rows) > 0


def test_odd_rows(docs_of, spark):
    df = docs_of([(1, None), (2, ""), (None, "a\nb"), (3, "x y"), (3, "x y"), (4, "w " * 40000)], extra=("sections", "section", "start"))
    rows = attribution.token_counts(df, F.col("text")).collect()
    assert [r["doc_id"] for r in rows].count(1) == 0 and [r["n_tokens"] for r in rows if r["doc_id"] == 2] == [0.0]
    assert len([r for r in rows if r["doc_id"] is None]) == 2 and len([r for r in rows if r["doc_id"] == 3]) == 2
    assert attribution.token_counts(docs_of([]), F.col("text")).count() == 0
    with pytest.raises(ValueError):
        attribution.token_counts(df, F.col("text"), None, "other")


def test_fields(spark, docs_of, reference):
    df = spark.createDataFrame([(1, "A title", None, "Body text here")], "doc_id long, title string, note string, body string")
    text, sections = attribution.field_sections(["title", "note", "body"])
    rows = attribution.token_counts(df, text, sections, "most").collect()
    assert [r["section"] for r in rows] == ["title", "note", "body"] and rows[1]["n_tokens"] == 0
    assert rows[0]["n_tokens"] == 2 and rows[2]["n_tokens"] == 3
