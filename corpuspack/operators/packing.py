"""Corpus packing: filter, count, running offsets, budget cutoff, shard split.

A source is a stream of documents in ``doc_seq`` order. Each document contributes its tokens
plus one end-of-document id. The stream is cut into shards of ``shard_tokens``; a per-source
``target`` stops the stream once whole shards reach it, tested only at the end of each batch of
``batch_docs`` documents (so the budget is overshot, by design of the original loop).

Nothing here orders a whole source in one task:

* running sums are two-level (or deeper): documents are bucketed by ``doc_seq div bucket_docs``,
  bucket totals are summed over buckets (a table ``bucket_docs`` times smaller, recursively), and
  only the rows of one bucket are ordered together;
* the stop rule is a closed form over per-document offsets, evaluated with one partial
  aggregate per source (no window over batches);
* shards are produced by ``explode(sequence(...))`` per document, so a shard is never a single
  value and a document that straddles shards becomes one piece per shard.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.functions.tokens import ByteTokenizer, Tokenizer
from corpuspack.session import materialize

DEFAULT_TARGET = 100_000_000
DEFAULT_SHARD_TOKENS = 100_000_000
DEFAULT_BATCH_DOCS = 1000
DEFAULT_BUCKET_DOCS = 1 << 16
# The per-source cut table is broadcast only below this many rows (one row per source).
MAX_BROADCAST_SOURCES = 10_000

Targets = int | Mapping[str, int] | None


# --------------------------------------------------------------------------- B2 / C4


def nonempty(docs: DataFrame, text: str = "text") -> DataFrame:
    """Drop null and '' texts; whitespace-only text is kept (B2)."""
    return docs.filter(F.col(text).isNotNull() & (F.col(text) != ""))


def with_token_counts(docs: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Add ``n_tokens`` (ids incl. EOS). Uses ``tokens`` when already tokenized (C4)."""
    tokenizer = tokenizer or ByteTokenizer()
    if "tokens" in docs.columns:
        return docs.withColumn("n_tokens", F.size("tokens").cast("bigint"))
    return docs.withColumn("n_tokens", tokenizer.count("text"))


def tokenize(docs: DataFrame, tokenizer: Tokenizer | None = None, guard: bool = False) -> DataFrame:
    """``(source, doc_seq, text)`` → ``(source, doc_seq, n_tokens, tokens)``, EOS appended."""
    tokenizer = tokenizer or ByteTokenizer()
    if not tokenizer.columnar:
        table = tokenizer.tokenize_table(docs)
        return table.withColumn("tokens", tokenizer.guard("tokens"))
    tokens = tokenizer.encode_with_eos("text")
    if guard or not tokenizer.native:  # an outside tokenizer's ids are checked before they are written
        tokens = tokenizer.guard(tokens)
    out = docs.select("source", "doc_seq", tokens.alias("tokens"))
    return out.select("source", "doc_seq", F.size("tokens").cast("bigint").alias("n_tokens"), "tokens")


# --------------------------------------------------------------------------- D1 / D2


def _bucket(order: str, bucket_size: int) -> Column:
    return F.expr(f"`{order}` div {int(bucket_size)}")


def bucket_bases(
    df: DataFrame,
    keys: list[str],
    order: str,
    weights: Mapping[str, Column],
    bucket_size: int = DEFAULT_BUCKET_DOCS,
    levels: int = 2,
    bucket_col: str = "_bucket",
) -> DataFrame:
    """Per ``(keys, bucket)`` with ``bucket = order div bucket_size``: for each weight, the sum
    over all earlier buckets of the key (columns ``_base_<name>``). A table ``bucket_size``
    times smaller than ``df``, itself summed with ``levels - 1`` levels."""
    names = list(weights)
    b = df.select(*keys, _bucket(order, bucket_size).alias(bucket_col),
                  *[weights[n].cast("bigint").alias(f"_w_{n}") for n in names])
    sums = b.groupBy(*keys, bucket_col).agg(*[F.sum(f"_w_{n}").alias(f"_w_{n}") for n in names])
    return exclusive_prefix_sums(
        sums, keys, bucket_col, {f"_base_{n}": F.col(f"_w_{n}") for n in names}, bucket_size, levels - 1
    ).drop(*[f"_w_{n}" for n in names])


def apply_bucket_bases(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    weights: Mapping[str, Column],
    bases: DataFrame,
    bucket_size: int,
    bucket_col: str = "_bucket",
) -> DataFrame:
    """Finish the prefix sums: a window inside each ``(keys, bucket)`` plus the bucket's base.

    ``df`` is shuffled once by ``(keys, bucket)`` for the window; the join with ``bases`` uses
    the same keys, so the (possibly wide) rows of ``df`` do not move again.
    """
    names = list(weights)
    orders = [order] if isinstance(order, str) else list(order)
    b = df.select("*", _bucket(orders[0], bucket_size).alias(bucket_col))
    w = Window.partitionBy(*keys, bucket_col).orderBy(*orders).rowsBetween(Window.unboundedPreceding, -1)
    inner = b.select("*", *[F.coalesce(F.sum(weights[n]).over(w), F.lit(0)).alias(f"_in_{n}") for n in names])
    joined = inner.join(bases, on=[*keys, bucket_col], how="inner")
    return joined.select(
        *df.columns, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).cast("bigint").alias(n) for n in names]
    )


def exclusive_prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    weights: Mapping[str, Column],
    bucket_size: int = DEFAULT_BUCKET_DOCS,
    levels: int = 2,
) -> DataFrame:
    """For each ``name → weight``, add ``name`` = sum of ``weight`` over earlier rows of the key.

    ``order`` is an integer column (or a list whose first item is one, the rest breaking
    ties); together unique within ``keys``. With ``levels`` = 1 this is a plain window over
    the whole key. With more levels, rows are bucketed by ``order div bucket_size``; the
    bucket totals recurse one level down and are joined back, so each window holds the rows of
    one bucket (plus the top level, which holds ``rows / bucket_size ** (levels - 1)``).
    """
    names = list(weights)
    orders = [order] if isinstance(order, str) else list(order)
    if levels <= 1:
        w = Window.partitionBy(*keys).orderBy(*orders).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(
            "*", *[F.coalesce(F.sum(weights[n]).over(w), F.lit(0)).cast("bigint").alias(n) for n in names]
        )
    col = f"_bucket{levels}"
    bases = bucket_bases(df, keys, orders[0], weights, bucket_size, levels, col)
    return apply_bucket_bases(df, keys, orders, weights, bases, bucket_size, col)


def offset_weights() -> dict[str, Column]:
    """Documents before (``rank``) and tokens before (``offset``)."""
    return {"rank": F.lit(1), "offset": F.col("n_tokens")}


def running_offsets(
    counts: DataFrame,
    batch_docs: int = DEFAULT_BATCH_DOCS,
    bucket_docs: int = DEFAULT_BUCKET_DOCS,
    levels: int = 2,
    bases: DataFrame | None = None,
) -> DataFrame:
    """Add ``rank`` (documents before), ``offset`` (tokens before) and ``batch``.

    ``counts`` needs ``source, doc_seq, n_tokens``; ``doc_seq`` unique within a source.
    ``bases`` (from ``bucket_bases``) may be passed when already computed.
    """
    if batch_docs <= 0:
        raise ValueError("batch_docs must be positive")
    if bases is not None:
        out = apply_bucket_bases(counts, ["source"], "doc_seq", offset_weights(), bases, bucket_docs)
    else:
        out = exclusive_prefix_sums(counts, ["source"], "doc_seq", offset_weights(), bucket_docs, levels)
    return out.withColumn("batch", F.expr(f"rank div {int(batch_docs)}"))


# --------------------------------------------------------------------------- D3 / D5


def target_column(targets: Targets) -> Column:
    """Per-source token target as a column (a literal map lookup for a dict).

    ``None``, for all sources or as a source's value, means no budget: everything is kept. A
    source that a dict does not name is an error when its rows are read.
    """
    if isinstance(targets, Mapping):
        for k, v in targets.items():
            if v is not None and v <= 0:
                raise ValueError(f"target for {k!r} must be positive")
        stop = F.raise_error(F.concat(F.lit("no target is given for source "), F.coalesce("source", F.lit("null"))))
        if not targets:
            return stop.cast("bigint")
        pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]
        known = F.create_map(*pairs)
        source = F.coalesce("source", F.lit(""))
        return F.when(F.map_contains_key(known, source), F.try_element_at(known, source)).otherwise(stop.cast("bigint"))
    if targets is not None and targets <= 0:
        raise ValueError("target must be positive")
    return F.lit(targets).cast("bigint")


def budget_cutoff(
    offsets: DataFrame,
    shard_tokens: int = DEFAULT_SHARD_TOKENS,
    targets: Targets = DEFAULT_TARGET,
    batch_docs: int = DEFAULT_BATCH_DOCS,
) -> DataFrame:
    """One row per source: where the stream stops.

    With S = shard size and T = target, the stream stops after the first batch whose
    running total C_b satisfies ``floor(C_b / S) * S >= T``; it keeps ``floor(C_b / S) * S``
    tokens. If no batch does, all tokens are kept and the last shard is short. Because C_b
    grows with b, the first such batch is the one with the smallest batch-end total that is
    at least ``ceil(T / S) * S``: a min-aggregate, no ordering. ``last_seq`` is the ``doc_seq``
    behind which no document has a kept token, so later ones need not be read again.
    """
    if shard_tokens <= 0:
        raise ValueError("shard_tokens must be positive")
    S = int(shard_tokens)
    o = offsets.select(
        "source", "doc_seq", "n_tokens", "rank", "batch",
        (F.col("offset") + F.col("n_tokens")).alias("end"),
        target_column(targets).alias("target"),
    ).withColumn("t_round", F.expr(f"((target + {S - 1}) div {S}) * {S}"))
    batch_end = ((F.col("rank") + 1) % F.lit(int(batch_docs))) == 0
    hit = batch_end & (F.col("end") >= F.col("t_round"))
    agg = o.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").alias("total_tokens"),
        F.max("target").alias("target"),
        F.max("t_round").alias("t_round"),
        F.min(F.when(hit, F.col("end"))).alias("hit_end"),
        F.min(F.when(hit, F.col("batch"))).alias("hit_batch"),
        F.min(F.when(hit, F.col("doc_seq"))).alias("hit_seq"),
        F.max("doc_seq").alias("max_seq"),
        F.max("batch").alias("last_batch"),
    )
    reached = F.col("t_round").isNotNull() & (F.col("total_tokens") >= F.col("t_round"))
    kept = F.when(
        reached, F.expr(f"(coalesce(hit_end, total_tokens) div {S}) * {S}")
    ).otherwise(F.col("total_tokens"))
    return agg.select(
        "source",
        F.col("n_docs").cast("bigint").alias("n_docs"),
        F.col("total_tokens").cast("bigint").alias("total_tokens"),
        F.col("target").cast("bigint").alias("target"),
        kept.cast("bigint").alias("kept_tokens"),
        reached.alias("reached"),
        F.when(reached, F.coalesce("hit_batch", "last_batch")).otherwise(F.col("last_batch"))
        .cast("bigint").alias("stop_batch"),
        F.when(reached, F.coalesce("hit_seq", "max_seq")).otherwise(F.col("max_seq")).alias("last_seq"),
    ).withColumn("n_shards", F.expr(f"(kept_tokens + {S - 1}) div {S}"))


# --------------------------------------------------------------------------- D4


def shard_pieces(docs: DataFrame, shard_tokens: int, piece_tokens: int | None = None) -> DataFrame:
    """Cut documents at shard boundaries.

    ``docs`` needs ``offset, n_tokens, kept_tokens``; documents starting at or after
    ``kept_tokens`` are dropped, the document that crosses it is cut. Adds
    ``shard_idx, pos`` (position in the shard), ``start`` (position in the document) and
    ``length``; every other column is carried along. With ``piece_tokens`` (a divisor of the
    shard size) pieces are also cut at its multiples inside a shard, which bounds every row.
    """
    S = int(shard_tokens)
    U = int(piece_tokens or S)
    if S % U:
        raise ValueError("piece_tokens must divide shard_tokens")
    end = F.least(F.col("offset") + F.col("n_tokens"), F.col("kept_tokens"))
    live = docs.filter(F.col("offset") < F.col("kept_tokens"))
    exploded = live.select(
        "*",
        F.explode(
            F.sequence(F.expr(f"offset div {U}"), F.expr(f"(least(offset + n_tokens, kept_tokens) - 1) div {U}"))
        ).alias("_unit"),
    )
    lo = F.greatest(F.col("offset"), F.col("_unit") * F.lit(U))
    hi = F.least(end, (F.col("_unit") + 1) * F.lit(U))
    shard = F.expr(f"_unit div {S // U}")
    return exploded.select(
        "*",
        shard.cast("int").alias("shard_idx"),
        (lo - shard * F.lit(S)).alias("pos"),
        (lo - F.col("offset")).alias("start"),
        (hi - lo).alias("length"),
    ).drop("_unit")


# --------------------------------------------------------------------------- D6 / D7


def shard_inventory(segments: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Tokens per shard (D7): ``(source, shard_idx, n_tokens)``."""
    return segments.groupBy("source", "shard_idx").agg(F.sum(length).cast("bigint").alias("n_tokens"))


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """Per source: number of shards and total tokens."""
    return inventory.groupBy("source").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_shards"), F.sum("n_tokens").cast("bigint").alias("total_tokens")
    )


def shard_progress(inventory: DataFrame, cut: DataFrame, shard_tokens: int) -> DataFrame:
    """Progress lines (D6): tokens of each shard, tokens written so far, target.

    Every shard but the last of a source is full, so the running total is arithmetic
    (``min((shard_idx + 1) * S, kept)``): no window over shards.
    """
    S = int(shard_tokens)
    small = cut.select("source", "target", "kept_tokens")
    return inventory.join(small, "source").select(
        "source", "shard_idx", "n_tokens",
        F.least((F.col("shard_idx").cast("bigint") + 1) * F.lit(S), F.col("kept_tokens")).alias("written"),
        "target",
    )


# --------------------------------------------------------------------------- the whole job


@dataclass
class PackResult:
    offsets: DataFrame  # per document: source, doc_seq, n_tokens, rank, offset, batch
    cut: DataFrame  # per source: budget outcome
    docs: DataFrame  # the documents packed (text or tokens)
    shard_tokens: int
    tokenizer: Tokenizer
    cut_checked: bool = False  # cut checked to hold at most MAX_BROADCAST_SOURCES rows: broadcast it
    bases: DataFrame | None = None  # per (source, bucket): tokens and documents before it
    bucket_docs: int = DEFAULT_BUCKET_DOCS
    piece_tokens: int | None = None  # also cut pieces at multiples of this (divides shard_tokens)

    def _with_cut(self, df: DataFrame) -> DataFrame:
        small = self.cut.select("source", "kept_tokens")
        return df.join(F.broadcast(small) if self.cut_checked else small, "source")

    def pieces(self) -> DataFrame:
        """Narrow pieces (no token arrays): ``source, shard_idx, pos, doc_seq, start, n_tokens``."""
        p = shard_pieces(self._with_cut(self.offsets), self.shard_tokens)
        return p.select("source", "shard_idx", "pos", "doc_seq", "start", F.col("length").alias("n_tokens"))

    def inventory(self) -> DataFrame:
        return shard_inventory(self.pieces())

    def progress(self) -> DataFrame:
        cut = F.broadcast(self.cut) if self.cut_checked else self.cut
        return shard_progress(self.inventory(), cut, self.shard_tokens)

    def segments(self) -> DataFrame:
        """Packed segments: ``source, shard_idx, pos, doc_seq, n_tokens, tokens`` (D4 with ids).

        The documents (text, or token arrays for a non-native tokenizer) are shuffled once,
        by ``(source, bucket)``: the within-bucket running sum is a window on that
        partitioning and the bucket bases join on the same keys, so the text does not move
        again. Documents behind the budget's last one (``last_seq``) are dropped before that
        shuffle, by a join with the small per-source cut. Output rows stay grouped by bucket, i.e. by stream position.
        """
        has_tokens = "tokens" in self.docs.columns
        payload = "tokens" if has_tokens else "text"
        docs = self.docs.select("source", "doc_seq", payload)
        if self.cut_checked:
            docs = docs.join(F.broadcast(self.cut.select("source", "last_seq")), "source")
            docs = docs.filter(F.col("doc_seq") <= F.col("last_seq")).drop("last_seq")
        wide = with_token_counts(docs, self.tokenizer)
        if self.bases is not None:
            with_off = apply_bucket_bases(
                wide, ["source"], "doc_seq", {"offset": F.col("n_tokens")},
                self.bases.select("source", "_bucket", "_base_offset"), self.bucket_docs,
            )
        else:
            with_off = wide.join(self.offsets.select("source", "doc_seq", "offset"), ["source", "doc_seq"])
        kept = self._with_cut(with_off).filter(F.col("offset") < F.col("kept_tokens"))
        if not has_tokens and isinstance(self.tokenizer, ByteTokenizer):
            # byte ids are the UTF-8 bytes: cut the bytes per piece and encode only the piece,
            # so no row ever holds more than one piece's ids (plus EOS on the last piece)
            kept = kept.select("source", "doc_seq", "offset", "n_tokens", "kept_tokens",
                               F.encode("text", "UTF-8").alias("_bytes"))
            p = shard_pieces(kept, self.shard_tokens, self.piece_tokens)
            body_end = F.least(F.col("start") + F.col("length"), F.col("n_tokens") - 1)
            piece = F.substring("_bytes", (F.col("start") + 1).cast("int"), (body_end - F.col("start")).cast("int"))
            ids = self.tokenizer.encode_bytes(piece)
            with_eos = F.when(F.col("start") + F.col("length") == F.col("n_tokens"),
                              F.array_append(ids, F.lit(self.tokenizer.eos_id))).otherwise(ids)
            return p.select("source", "shard_idx", "pos", "doc_seq", F.col("length").alias("n_tokens"),
                            with_eos.alias("tokens"))
        ids = F.col("tokens") if has_tokens else self.tokenizer.encode_with_eos("text")
        kept = kept.select("source", "doc_seq", "offset", "n_tokens", "kept_tokens", ids.alias("tokens"))
        p = shard_pieces(kept, self.shard_tokens, self.piece_tokens)
        return p.select(
            "source", "shard_idx", "pos", "doc_seq",
            F.col("length").alias("n_tokens"),
            F.slice("tokens", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("tokens"),
        )

    def write(self, path: str, sources: Sequence[str] | None = None, fingerprints: Mapping[str, str] | None = None) -> None:
        """A8 for this plan: segments are already grouped by stream position, so a local sort
        replaces the shuffle by shard (files per shard ≈ shard size / bucket size + 1)."""
        from corpuspack.sources.sinks import write_packed

        write_packed(self.segments(), path, shuffle=False, sources=sources, fingerprints=fingerprints)


def auto_buckets(
    docs: DataFrame, per_core: int = 4, cap: int = DEFAULT_BUCKET_DOCS, width: int | None = None
) -> tuple[int, int]:
    """Bucket width (unless given) and number of prefix-sum levels, from one pass over ``doc_seq``.

    The width is the ``doc_seq`` span over ``per_core * cores`` (so small inputs still spread
    over the cores), never above ``cap``. As keys are unique integers, a width of at most
    ``cap`` means no bucket holds more than ``cap`` documents and no level holds more than
    ``cap`` buckets per group, whatever the key distribution: sparse or clustered keys only
    add levels, which are added until the top level has at most ``cap`` entries too.
    """
    lo, hi = docs.agg(F.min("doc_seq"), F.max("doc_seq")).first()
    if lo is None:
        return width or 1, 2
    cores = docs.sparkSession.sparkContext.defaultParallelism
    span = int(hi) - int(lo) + 1
    width = int(width or max(1, min(cap, -(-span // (per_core * cores)))))
    levels = 2
    while width > 1 and -(-span // width ** (levels - 1)) > cap:
        levels += 1
    return width, levels


def small_table(df: DataFrame, name: str, max_rows: int = MAX_BROADCAST_SOURCES) -> tuple[DataFrame, bool]:
    """Bring a per-source table to the driver when it has at most ``max_rows`` rows (checked
    with a bounded ``limit``), as a local relation that broadcasts for free. Beyond the bound
    it is materialized in the scratch folder instead and callers use a shuffle join."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return materialize(df, name), False


def pack(
    docs: DataFrame,
    shard_tokens: int = DEFAULT_SHARD_TOKENS,
    targets: Targets = DEFAULT_TARGET,
    batch_docs: int = DEFAULT_BATCH_DOCS,
    bucket_docs: int | None = None,
    levels: int | None = None,
    tokenizer: Tokenizer | None = None,
    persist: bool = True,
    piece_tokens: int | None = None,
) -> PackResult:
    """Plan the packing of ``docs`` (``source, doc_seq, text``; empty texts are dropped).

    With ``persist`` the per-document counts and offsets (narrow: a few integers per
    document), the bucket bases and the per-source cut are written to the shared scratch
    folder: the text is scanned twice in all (counting, then splitting), the consumers (cut,
    inventory, segments) do not recompute the prefix sums, and a lost executor recomputes from
    those tables, not from the source scan. A non-native tokenizer always persists its
    token arrays first: it is the expensive step and must run once.
    """
    tokenizer = tokenizer or ByteTokenizer()
    if levels is None or bucket_docs is None:
        bucket_docs, auto_levels = auto_buckets(docs, width=bucket_docs)
        levels = levels or auto_levels
    docs = nonempty(docs)
    if not tokenizer.native:
        docs = materialize(tokenize(docs, tokenizer), "tokenized_docs")
    counts = with_token_counts(docs.select("source", "doc_seq", *(["tokens"] if "tokens" in docs.columns else ["text"])), tokenizer)
    counts = counts.select("source", "doc_seq", "n_tokens")
    if persist:
        counts = materialize(counts, "token_counts", rebalance=True)  # the one counting scan of the text
    bases = bucket_bases(counts, ["source"], "doc_seq", offset_weights(), bucket_docs, levels)
    if persist:
        bases = materialize(bases, "bucket_bases")
    offsets = running_offsets(counts, batch_docs, bucket_docs, levels, bases=bases)
    if persist:
        offsets = materialize(offsets, "offsets")
    cut = budget_cutoff(offsets, shard_tokens, targets, batch_docs)
    small = False
    if persist:
        cut, small = small_table(cut, "cut")
    return PackResult(
        offsets=offsets, cut=cut, docs=docs, shard_tokens=shard_tokens, tokenizer=tokenizer, cut_checked=small,
        bases=bases, bucket_docs=bucket_docs, piece_tokens=piece_tokens,
    )
