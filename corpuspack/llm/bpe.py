"""A byte-level BPE vocabulary inside tasks: ids of a whole text, and the bytes of each id.

The vocabulary comes from a ``tokenizers`` JSON definition (a path is a parameter; the driver
reads it and Spark broadcasts it). Its ids are merge ranks, so the faster of the installed
encoders runs it; tests hold the ids against the ``tokenizers`` library's on whole texts. The
operators encode with ``added=True``, the library's default: the strings of the definition's added tokens
in a text are those tokens.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from corpuspack.llm.common import worker_cache


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    def __init__(self, definition: str):
        import tiktoken

        spec = json.loads(definition)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE definition without normalizer or prefix space is needed")
        added = spec.get("added_tokens", [])
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("added tokens that take in spaces or need whole words are not supported")
        special = {t["content"]: t["id"] for t in added}
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        # Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self._encoding = tiktoken.Encoding("corpuspack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for piece, rank in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.lengths[rank] = len(piece)

    def encode(self, text: str | None, added: bool = False) -> np.ndarray:
        """The ids of a whole text as ``uint32`` (null: none). Without ``added``, added tokens' strings are ordinary text."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        return self._encoding.encode_to_numpy(text, allowed_special="all" if added else set(), disallowed_special=()).astype(np.uint32)


def load(definition: str) -> Bpe:
    """The vocabulary of this worker process; built once."""
    key = ("bpe", hashlib.sha1(definition.encode()).hexdigest())
    kept = worker_cache()
    if key not in kept:
        kept[key] = Bpe(definition)
    return kept[key]


def broadcast_definition(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Path(path).read_text())
