"""A user-given tokenizer definition (tokenizers JSON), run as an Arrow-batched UDF."""

import pytest

tokenizers = pytest.importorskip("tokenizers")


from corpuspack.functions.tokens import JsonTokenizer  # noqa: E402
from corpuspack.operators import packing  # noqa: E402


def _definition():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {"[UNK]": 0, "</s>": 1, "the": 2, "cat": 3, "sat": 4}
    tok = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    return tok.to_str()


def test_json_tokenizer_pack(spark):
    tok = JsonTokenizer(_definition(), "</s>", spark)
    assert tok.eos_id == 1
    docs = spark.createDataFrame(
        [("a", 0, "the cat sat"), ("a", 1, "cat dog"), ("a", 2, ""), ("a", 3, "sat")],
        "source string, doc_seq bigint, text string")
    p = packing.pack(docs, shard_tokens=3, targets=None, batch_docs=2, bucket_docs=2, tokenizer=tok)
    seg = p.segments().orderBy("shard_idx", "pos").collect()
    stream = [t for r in seg for t in r.tokens]
    assert stream == [2, 3, 4, 1, 3, 0, 1, 4, 1]
    assert [r.n_tokens for r in p.inventory().orderBy("shard_idx").collect()] == [3, 3, 3]
    dec = docs.filter("doc_seq = 0").select(tok.decode(tok.encode("text")).alias("t")).first().t
    assert dec == "the cat sat"


def test_json_tokenizer_needs_eos(spark):
    with pytest.raises(ValueError):
        JsonTokenizer(_definition(), "<eos>", spark)
