"""Tokenizers as column expressions.

``ByteTokenizer`` (default) maps text to its UTF-8 bytes, ids 0-255, end-of-document 256. It is
pure Spark SQL: the bytes are re-read as ISO-8859-1 (one character per byte), split into
characters and turned into code points, all inside whole-stage code generation.

``JsonTokenizer`` wraps a user-supplied tokenizer definition (the ``tokenizers`` JSON format).
It runs as an Arrow-batched pandas UDF; the definition travels once per executor as a
broadcast variable and is parsed once per Python worker.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Tokenizer:
    """Interface: ``encode`` (text → ids, no EOS), ``count`` (ids incl. EOS), ``decode``."""

    eos_id: int
    vocab_size: int
    native: bool  # True when encode/count are plain Spark expressions
    columnar = True  # False when ids come from ``tokenize_table`` only, not from a column expression

    def identity(self) -> str:
        """What tells this tokenizer from another one in a fingerprint."""
        return f"{type(self).__name__}:{self.eos_id}:{self.vocab_size}"

    def encode(self, text: Column | str) -> Column:  # pragma: no cover - interface
        raise NotImplementedError

    def count(self, text: Column | str) -> Column:
        """Tokens per document including the end-of-document mark."""
        return F.size(self.encode(text)) + F.lit(1)

    def encode_with_eos(self, text: Column | str) -> Column:
        """Ids with EOS appended; a document with no tokens still gets its EOS."""
        return F.array_append(self.encode(text), F.lit(self.eos_id))

    def decode(self, tokens: Column | str) -> Column:  # pragma: no cover - interface
        raise NotImplementedError

    def guard(self, tokens: Column | str) -> Column:
        """Fail the task if an id does not fit the vocabulary (and so ``uint32``)."""
        t = _c(tokens)
        ok = F.forall(t, lambda x: (x >= 0) & (x < self.vocab_size))
        return F.when(F.assert_true(ok, F.lit("token id outside the vocabulary")).isNull(), t)


@dataclass(frozen=True)
class ByteTokenizer(Tokenizer):
    eos_id: int = 256
    vocab_size: int = 257
    native: bool = True

    def encode(self, text: Column | str) -> Column:
        t = _c(text)
        return F.when(t == "", F.array().cast("array<int>")).otherwise(self.encode_bytes(F.encode(t, "UTF-8")))

    def encode_bytes(self, data: Column) -> Column:
        """UTF-8 bytes (a binary column, possibly a cut inside a character) → ids."""
        latin = F.decode(data, "ISO-8859-1")
        ids = F.transform(F.split(latin, ""), lambda ch: F.ascii(ch))
        # split('') of an empty string yields one empty piece; no bytes means no ids.
        return F.when(F.octet_length(data) == 0, F.array().cast("array<int>")).otherwise(ids)

    def count(self, text: Column | str) -> Column:
        return (F.octet_length(F.encode(_c(text), "UTF-8")) + F.lit(1)).cast("bigint")

    def decode(self, tokens: Column | str) -> Column:
        """Ids → text; ids >= 256 (EOS) are skipped. A cut inside a character decodes to U+FFFD."""
        t = _c(tokens)
        latin = F.array_join(F.transform(F.filter(t, lambda x: x < 256), lambda x: F.chr(x)), "")
        # the bytes as a string without validation, then invalid sequences → U+FFFD
        return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


# One tokenizer call per Arrow batch and one batch per core: no extra threads per call.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LOADED: dict[str, object] = {}


def _load(definition: str):
    key = hashlib.sha1(definition.encode()).hexdigest()
    tok = _LOADED.get(key)
    if tok is None:
        from tokenizers import Tokenizer as _HF

        tok = _HF.from_str(definition)
        _LOADED[key] = tok
    return tok


@dataclass
class JsonTokenizer(Tokenizer):
    """A tokenizer given as a ``tokenizers`` JSON definition, with its EOS token string."""

    definition: str
    eos_token: str
    spark: SparkSession
    native: bool = False
    eos_id: int = field(init=False)
    vocab_size: int = field(init=False)

    def __post_init__(self) -> None:
        tok = _load(self.definition)
        eos = tok.token_to_id(self.eos_token)
        if eos is None:
            raise ValueError(f"the definition lacks the end-of-document token {self.eos_token!r}")
        self.eos_id = int(eos)
        self.vocab_size = int(tok.get_vocab_size(with_added_tokens=True))
        self._bc = self.spark.sparkContext.broadcast(self.definition)

    def identity(self) -> str:
        return f"{super().identity()}:{hashlib.sha256(self.definition.encode()).hexdigest()}"

    def encode(self, text: Column | str) -> Column:
        bc = self._bc

        @pandas_udf("array<int>")
        def _encode(texts: pd.Series) -> pd.Series:
            tok = _load(bc.value)
            values = texts.fillna("").tolist()
            encs = tok.encode_batch(values, add_special_tokens=False)
            return pd.Series([e.ids for e in encs])

        return _encode(_c(text))

    def decode(self, tokens: Column | str) -> Column:
        bc = self._bc

        @pandas_udf("string")
        def _decode(ids: pd.Series) -> pd.Series:
            tok = _load(bc.value)
            return pd.Series(tok.decode_batch([list(x) for x in ids], skip_special_tokens=True))

        return _decode(_c(tokens))


def detokenize(tokens: Column | str, tokenizer: Tokenizer | None = None) -> Column:
    """Ids → text with special ids skipped, then Python-equal strip."""
    from corpuspack.functions.text import strip_ws

    return strip_ws((tokenizer or ByteTokenizer()).decode(tokens))
