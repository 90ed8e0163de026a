"""C1 with subword ids by a dictionary of the whole corpus.

Byte-level BPE gives a text's pre-tokens their ids one by one, and the pre-tokens of a corpus repeat: a few hundred
thousand make up nearly all of it. So the corpus is cut into pre-tokens by a Spark expression, each distinct one is
encoded once, by its merge ranks, and the documents' ids are put together again by a join. No document is ever
handed to an encoder.

The join is safe from skew: the most frequent pre-tokens, whatever share of the corpus they are, are a table of
bounded size that is broadcast, and become ids where the document is; only occurrences of the others are shuffled, by
pre-token, and of these none is frequent. Long pre-tokens travel as digests. Documents are put together by one exchange
of their ids: a row with all its frequent pre-tokens, and a row for each of the others.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspack.functions.tokens import Tokenizer
from corpuspack.session import materialize

# The pre-tokens of byte-level vocabularies, with Unicode's white space spelled out for Java.
PRE_TOKENS = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
#: Pre-tokens in the broadcast table, and ids in it, at most.
TOP = 100_000
TOP_IDS = 1_000_000
#: Pre-tokens longer than this travel as digests.
LONG = 64


def byte_symbols() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others from U+0100 on, in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, other = [""] * 256, 0x100
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b], other = chr(other), other + 1
    return out


class Merges:
    """The ids of one pre-token by merge ranks."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a byte-level BPE definition without normalizer, prefix space or dropout is needed")
        vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes = [vocab[s] for s in byte_symbols()]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}

    def encode(self, piece: str) -> list[int]:
        """Of all neighbours the pair of the lowest rank merges first, the leftmost one of equal pairs."""
        if piece in self.added:
            return [self.added[piece]]
        ids = [self.bytes[b] for b in piece.encode()]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i, pair in enumerate(zip(ids, ids[1:])):
            if pair in self.pairs:
                rank, made = self.pairs[pair]
                queue.append((rank, i, made, *pair))
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged with another neighbour meanwhile
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (pair := (ids[left], ids[right])) in self.pairs:
                    rank, made = self.pairs[pair]
                    heapq.heappush(queue, (rank, left, made, *pair))
        return [t for t in ids if t >= 0]


def pre_tokens(text: Column, added: list[str]) -> Column:
    """The pre-tokens of a text; the added tokens' strings in it are pre-tokens of their own."""
    cut = lambda s: F.regexp_extract_all(s, F.lit(PRE_TOKENS), F.lit(0))
    if not added:
        return cut(text)
    either = "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))
    holds = F.lit(False)
    for a in added:
        holds = holds | F.contains(text, F.lit(a))
    parts = F.split(text, f"(?<={either})|(?={either})" if len(added) == 1 else f"(?<=(?:{either}))|(?=(?:{either}))")
    apart = F.flatten(F.transform(parts, lambda s: F.when(s.isin(added), F.array(s)).otherwise(cut(s))))
    return F.when(holds, apart).otherwise(cut(text))


def _key(piece: Column) -> Column:
    return F.when(F.length(piece) > LONG, F.concat(F.lit("\x00"), F.sha2(piece, 256))).otherwise(piece)


@dataclass
class DictionaryTokenizer(Tokenizer):
    """A byte-level BPE definition (the ``tokenizers`` JSON format) with its end-of-document token."""

    definition: str
    eos_token: str
    spark: SparkSession
    native: bool = False
    columnar: bool = False  # ids are a table's, not a column expression
    eos_id: int = field(init=False)
    vocab_size: int = field(init=False)

    def __post_init__(self) -> None:
        merges = Merges(self.definition)
        if self.eos_token not in merges.added:
            raise ValueError(f"the definition lacks the end-of-document token {self.eos_token!r}")
        self.added = sorted(merges.added)
        self.eos_id = merges.added[self.eos_token]
        self.vocab_size = 1 + max(*(new for _, new in merges.pairs.values()), *merges.bytes, *merges.added.values())
        self._shared = self.spark.sparkContext.broadcast(self.definition)

    def identity(self) -> str:
        import hashlib

        return f"{super().identity()}:{hashlib.sha256(self.definition.encode()).hexdigest()}"

    def dictionary(self, docs: DataFrame) -> DataFrame:
        """``key, n, ids``: every distinct pre-token of ``docs`` (a column ``text``), how often it occurs, and its ids."""
        shared = self._shared

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merges = Merges(shared.value)
            for batch in batches:
                ids = [merges.encode(p) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["key", "n", "ids"])

        pieces = docs.select(F.explode(pre_tokens(F.col("text"), self.added)).alias("piece"))
        counts = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).select(_key(F.col("piece")).alias("key"), "n", "piece")
        return materialize(counts.mapInArrow(encode, "key STRING, n BIGINT, ids ARRAY<INT>"), "pre-tokens")

    def parts(self, docs: DataFrame) -> DataFrame:
        """``source, doc_seq, pos, sizes, ids``: a row at ``pos`` -1 for each document, with the sizes of its pre-tokens (-1: not a
        frequent one) and the ids of the frequent ones, and a row for each of the others, with its place and ids."""
        dictionary = self.dictionary(docs)
        most = dictionary.select("key", "ids", "n", F.size("ids").alias("_size")).orderBy(F.col("n").desc(), "key").limit(TOP)
        within = F.sum("_size").over(Window.orderBy(F.col("n").desc(), "key"))  # TOP rows at most
        frequent = materialize(most.withColumn("_upto", within).filter(F.col("_upto") <= TOP_IDS).select("key", "ids"), "frequent")
        shared = self.spark.sparkContext.broadcast(frequent.toArrow())  # its size is bounded by TOP and TOP_IDS

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, ids = (shared.value.column(c).combine_chunks() for c in ("key", "ids"))
            for batch in batches:
                own = batch.column(2)
                found = ids.take(pc.index_in(own.flatten(), value_set=keys))
                starts = _starts(own)
                columns = pa.ListArray.from_arrays(starts, pc.fill_null(pc.list_value_length(found), -1)), pa.ListArray.from_arrays(_starts(found)[starts], found.flatten())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["source", "doc_seq", "sizes", "ids"])

        pieces = docs.select("source", "doc_seq", pre_tokens(F.col("text"), self.added).alias("_p"))
        whole = pieces.select("source", "doc_seq", F.transform("_p", _key).alias("_p")).filter(F.size("_p") > 0)
        whole = whole.mapInArrow(look_up, "source STRING, doc_seq BIGINT, sizes ARRAY<INT>, ids ARRAY<INT>")
        known = F.broadcast(frequent.select("key"))
        rare = dictionary.select("key", "ids").join(known, "key", "left_anti")
        seldom = pieces.select("source", "doc_seq", F.posexplode("_p").alias("pos", "piece")).select("source", "doc_seq", "pos", _key(F.col("piece")).alias("key"))
        seldom = seldom.join(known, "key", "left_anti").join(rare, "key").withColumn("sizes", F.lit(None).cast("array<int>"))
        return whole.withColumn("pos", F.lit(-1)).unionByName(seldom.drop("key"))

    def tokenize_table(self, docs: DataFrame) -> DataFrame:
        """``source, doc_seq, n_tokens, tokens`` of non-empty documents, each closed by the end-of-document id."""
        eos = self.eos_id

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = [np.append(ids, eos).astype(np.int32) for ids in put_together(batch.column(2))]
                sizes = np.array([len(t) for t in tokens], np.int64)
                flat = pa.array(np.concatenate([np.empty(0, np.int32), *tokens]))
                starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                columns = [*batch.columns[:2], pa.array(sizes), pa.ListArray.from_arrays(starts, flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "doc_seq", "n_tokens", "tokens"])

        parts = self.parts(docs.select("source", "doc_seq", "text"))
        placed = parts.groupBy("source", "doc_seq").agg(F.collect_list(F.struct("pos", "sizes", "ids")).alias("_p"))
        return placed.mapInArrow(close, "source STRING, doc_seq BIGINT, n_tokens BIGINT, tokens ARRAY<INT>")


def _starts(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in the flattened values, and their end; a null one has none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def put_together(documents: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each document from its rows of ``parts``. Texts that share a key are one document, merged by place."""
    rows = documents.flatten()
    pos, sizes, ids = rows.field("pos").to_numpy(), rows.field("sizes"), rows.field("ids")
    of, size_at, id_at = _starts(documents), _starts(sizes), _starts(ids)
    sizes, ids = sizes.flatten().to_numpy(), ids.flatten().to_numpy()
    own = lambda r: ids[id_at[r] : id_at[r + 1]]
    for low, high in zip(of, of[1:]):
        texts = low + np.flatnonzero(pos[low:high] < 0)
        others = sorted((r for r in range(low, high) if pos[r] >= 0), key=lambda r: pos[r]) if high - low > len(texts) else []
        before = {r: np.concatenate([[0], np.cumsum(np.maximum(sizes[size_at[r] : size_at[r + 1]], 0))]) for r in texts if others or len(texts) > 1}
        if len(texts) > 1:
            merged = [(pos[r], own(r).tolist()) for r in others]
            for r in texts:
                merged += [(k, own(r)[a:b].tolist()) for k, (a, b) in enumerate(zip(before[r], before[r][1:])) if sizes[size_at[r] + k] >= 0]
            yield np.array([t for _, piece in sorted(merged) for t in piece], np.int32)
        elif others:
            places = np.repeat(before[texts[0]][pos[others]], [id_at[r + 1] - id_at[r] for r in others])
            yield np.insert(own(texts[0]), places, np.concatenate([own(r) for r in others]))
        else:
            yield own(texts[0])
