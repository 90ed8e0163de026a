import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuspack.llm import attribution, bpe, packing
from corpuspack.llm.common import documents
from corpuspack.llm.queries import op5_best_fit_packing
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def reference_ids():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "a\n\n b", "x y  z", "don't DON'T we'll", "é́🙂漢字 123abc", "\x1c\x1d a", "<|endoftext|> a", "\r\n\t  tab", "a" * 5000]


def test_ids_equal_the_tokenizers_library(reference_ids):
    encoder = bpe.load(open(bpe.default_path()).read())
    for text, ids in zip(ODD, reference_ids(ODD)):
        assert encoder.encode(text).tolist() == ids
        assert encoder.lengths[ids].sum() == len(text.encode())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_on_any_text(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert bpe.load(open(bpe.default_path()).read()).encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [*ODD, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", " <|endoftext|>\n\n é"])
def test_ids_of_the_library_at_its_defaults(text):
    encoder = bpe.load(open(bpe.default_path()).read())
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert encoder.encode(text, added=True).tolist() == ids
    assert encoder.lengths[ids].sum() == len(text.encode())


def test_operators_read_added_tokens(docs_of):
    text = "a <|endoftext|> b"
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    row = packing.pieces(docs_of([(1, text)]), with_ids=True).first()
    assert row["ids"] == [*ids, packing.EOS]
    assert attribution.token_counts(docs_of([(1, text)]), F.col("text")).first()["n_tokens"] == len(ids)


def check_sequences(rows, limits):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(own) <= limits.documents and sum(r["length"] ** 2 for r in own) <= limits.attention
    return by


def test_query_against_brute_force(spark, reference_ids):
    rows = op5_best_fit_packing(spark, SF_MID).collect()
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF_MID).collect()}
    ids = dict(zip(texts, reference_ids(list(texts.values()))))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, own in by_doc.items():
        full, own = ids[doc] + [0], sorted(own, key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["length"] for r in own] == packing.cut_lengths(len(full), 2048)
        at = 0
        for r in own:
            part = np.array(full[at : at + r["length"]], dtype="<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(full)
    by = check_sequences(rows, packing.Limits())
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(by) <= 1.02 * least + 1


def test_odd_rows(docs_of, spark):
    long = "word " * 30000
    df = docs_of([(1, None), (2, ""), (None, "x"), (3, "same"), (3, "same"), (4, long)], extra=("ids", "sequence_id", "_row", "length"))
    rows = packing.pack_documents(df, with_ids=True).collect()
    check_sequences(rows, packing.Limits())
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert len([r for r in rows if r["doc_id"] == 3]) == 2 and len([r for r in rows if r["doc_id"] is None]) == 1
    own = sorted((r for r in rows if r["doc_id"] == 4), key=lambda r: r["piece"])
    assert all(r["length"] == 2048 for r in own[1:]) and sum(len(r["ids"]) for r in own) == sum(r["length"] for r in own)
    assert packing.pack_documents(docs_of([])).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(spark, rule):
    rng = np.random.default_rng(7)
    limits = packing.Limits(tokens=100, documents=4, attention=5000, rule=rule, weights=(1.0, 0.5, 0.5))
    lengths = rng.integers(1, 70, 400)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = [r.asDict() for r in packing.pack(df, limits, bucket_pieces=150).collect()]
    assert len(out) == 400
    by = check_sequences(out, limits)
    floor = max(lengths.sum() / 100, 400 / 4, (lengths.astype(float) ** 2).sum() / 5000)
    assert len(by) <= 1.35 * floor


def test_best_fit_rejects_too_long():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([11]), packing.Limits(tokens=10))


@pytest.mark.parametrize(("length", "limits"), [(10, packing.Limits(tokens=10, attention=99)), (8, packing.Limits(tokens=10, attention=50)), (10, packing.Limits(tokens=10, documents=0))])
def test_pieces_that_no_sequence_takes_are_errors(spark, length, limits):
    with pytest.raises(ValueError):
        packing.best_fit(np.array([length]), limits)
    df = spark.createDataFrame([(1, 0, 0, length, 0)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    with pytest.raises(ValueError):
        packing.pack(df, limits)
