"""Subword ids by a corpus-wide dictionary, held against the ``tokenizers`` library on whole texts."""

import json
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuspack.functions import subwords
from corpuspack.functions.subwords import DictionaryTokenizer, Merges
from corpuspack.operators import packing
from corpuspack.sources.registry import fixture_docs

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
EOS = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return Merges(Path(PATH).read_text())


@pytest.fixture(scope="module")
def tokenizer(spark):
    return DictionaryTokenizer(Path(PATH).read_text(), EOS, spark)


@settings(max_examples=300, deadline=None)
@given(piece=st.text(alphabet=st.sampled_from("abcdefghinorst éñ중🙂.-_0129"), min_size=1, max_size=30))
def test_merges_of_a_piece(library, merges, piece):
    """Any string without inner white space changes is one piece to the model itself."""
    assert merges.encode(piece) == [library.token_to_id(t.value) for t in library.model.tokenize("".join(subwords.byte_symbols()[b] for b in piece.encode()))]


def test_long_pieces_are_not_quadratic(merges):
    assert len(merges.encode("ab" * 100_000)) > 1000
    assert sum(merges.encode(" " * 50_000)) > 0


def ids_of(df):
    return {(r.source, r.doc_seq): list(r.tokens) for r in df.collect()}


def test_whole_texts_equal_the_library(spark, tokenizer, library):
    docs = packing.nonempty(fixture_docs(spark, SF))
    got = ids_of(tokenizer.tokenize_table(docs))
    rows = docs.collect()
    assert len(got) == len(rows) > 100
    for r in rows:
        assert got[r.source, r.doc_seq] == library.encode(r.text, add_special_tokens=False).ids + [tokenizer.eos_id]


HARD = [
    "a", " ", "  ", "\n\n\n", "x \n y", "I'll we've he's 'S '", "a  b   c\t\td \t e ", "１２３ ½ ٣", "no break wide　end　", "é é ñ 中文 한국어 🙂👩‍👩‍👧", "!!<|endoftext|>!! <|endoftext|><|endoftext|> x",
    "<|endoftext|", "tab\tx\r\ny\x0b\x0cz\x1c\x85w", "-" * 500, "ab" * 300 + " " * 300, "don't can't DON'T", "​ zero‍", "\x00\x01", "a" * 65 + " " + "b" * 64,
]


@pytest.mark.parametrize("top,top_ids", [(100_000, 10**6), (3, 10**6), (100_000, 5)])
def test_hard_texts_and_rare_pieces(spark, tokenizer, library, monkeypatch, top, top_ids):
    """The same ids whether pieces are found in the broadcast table or by the shuffled join."""
    monkeypatch.setattr(subwords, "TOP", top)
    monkeypatch.setattr(subwords, "TOP_IDS", top_ids)
    docs = spark.createDataFrame([("s", i, t) for i, t in enumerate(HARD)], "source string, doc_seq bigint, text string")
    got = ids_of(tokenizer.tokenize_table(docs))
    for i, t in enumerate(HARD):
        assert got["s", i] == library.encode(t, add_special_tokens=False).ids + [tokenizer.eos_id], repr(t)


def test_every_piece_is_encoded_once(spark, tokenizer):
    docs = packing.nonempty(fixture_docs(spark, SF))
    doubled = docs.unionByName(docs.withColumn("doc_seq", F.col("doc_seq") + 10**6))
    once, twice = tokenizer.dictionary(docs), tokenizer.dictionary(doubled)
    assert once.select("key").distinct().count() == once.count() == twice.count()
    assert {r.key: 2 * r.n for r in once.collect()} == {r.key: r.n for r in twice.collect()}


def test_packing_subwords(spark, tokenizer, library):
    """Shards of a corpus packed with subword ids are its documents' ids one after the other."""
    docs = fixture_docs(spark, SF).filter("source = 'es'")
    p = packing.pack(docs, 2000, None, 10, tokenizer=tokenizer)
    flat = [t for r in p.segments().orderBy("shard_idx", "pos").collect() for t in r.tokens]
    want = [t for r in docs.orderBy("doc_seq").collect() if r.text for t in [*library.encode(r.text, add_special_tokens=False).ids, tokenizer.eos_id]]
    assert flat == want


def test_other_definitions_are_refused(spark):
    spec = json.loads(Path(PATH).read_text())
    with pytest.raises(ValueError, match="byte-level"):
        Merges(json.dumps({**spec, "normalizer": {"type": "NFC"}}))
    with pytest.raises(ValueError, match="end-of-document"):
        DictionaryTokenizer(json.dumps(spec), "</s>", spark)


def test_frequent_pieces_do_not_travel(spark, tokenizer, monkeypatch):
    """A document is one row on its way, and a row more for each occurrence of a piece outside the broadcast table."""
    docs = spark.createDataFrame([("s", i, "a b a b " * 40 + f"w{i}x") for i in range(6)], "source string, doc_seq bigint, text string")
    assert tokenizer.parts(docs).count() == 6
    monkeypatch.setattr(subwords, "TOP", 2)  # " a" and " b"
    assert {r.pos for r in tokenizer.parts(docs).collect()} == {-1, 0, 160, 161, 162}


def test_texts_of_one_key_are_merged_by_place(spark, tokenizer, library, monkeypatch):
    """Keys should not repeat; where they do, the texts' pieces at each place follow one another, by their ids."""
    texts = ["one two three", "four two"]
    ids = [[library.encode(p, add_special_tokens=False).ids for p in t.replace(" ", "| ").split("|")] for t in texts]
    want = [t for _, piece in sorted((k, piece) for own in ids for k, piece in enumerate(own)) for t in piece] + [tokenizer.eos_id]
    docs = spark.createDataFrame([(None, 7, t) for t in [*texts, None, ""]], "source string, doc_seq bigint, text string")
    for top in (100_000, 1):
        monkeypatch.setattr(subwords, "TOP", top)
        assert ids_of(tokenizer.tokenize_table(docs)) == {(None, 7): want}
