"""Seeded shuffles and training windows.

Random draws are hashes, not generator state: ``md5('seed:sample_id:what')`` → a 60-bit integer.
They are the same in every engine, on every re-run and after a lost task, and each sample is
independent of the others (so sample ``i`` can be recomputed alone).

Windows are cut without random access: packed shards are re-cut into blocks of
``block_tokens`` ids; a window of ``seq_len + 1`` ids touches at most
``ceil((seq_len + 1) / block) + 1`` blocks, so the range lookup becomes
``explode(sequence(first_block, last_block))`` plus an equi-join on ``(source, shard_idx, block)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hash_draw(*parts: Column | str) -> Column:
    """A uniform integer in [0, 2^60) from ``md5(concat_ws(':', parts))``."""
    key = F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def with_shuffle_key(df: DataFrame, seed: int, id_col: str, name: str = "shuffle_key") -> DataFrame:
    return df.withColumn(name, hash_draw(F.lit(seed), F.col(id_col)))


# Shuffle keys are uniform on [0, 2^60): buckets of 2^40 give at most 2^20 equal-sized groups.
_KEY_BUCKET = 1 << 40


def with_positions(df: DataFrame, seed: int, id_col: str, position: str = "position") -> DataFrame:
    """F1 with explicit positions: ``position`` = rank of the row in the seeded permutation.

    Exact and distributed: the uniform shuffle key is cut into equal buckets, bucket counts
    are summed in order (a table of at most 2^20 rows), and only one bucket's rows are ordered
    together. No global sort, no single task.
    """
    from corpuspack.operators.packing import exclusive_prefix_sums

    keyed = with_shuffle_key(df, seed, id_col)
    return exclusive_prefix_sums(
        keyed, [], ["shuffle_key", id_col], {position: F.lit(1)}, bucket_size=_KEY_BUCKET, levels=2
    )


def take_shuffled(df: DataFrame, n: int, seed: int, id_col: str, position: str = "position") -> DataFrame:
    """the first ``n`` rows of the seeded permutation, with their positions.

    ``n`` = 0 gives no rows; ``n`` larger than the table is an error, as upstream. One scan of the ids
    counts the buckets of the shuffle key; rows of buckets behind the ``n``-th row are dropped before
    the shuffle of the others, so what moves is about ``n`` rows.
    """
    from corpuspack.operators.packing import apply_bucket_bases
    from corpuspack.session import materialize

    if n < 0:
        raise ValueError("n must be >= 0")
    keyed = with_shuffle_key(df, seed, id_col)
    counts = keyed.groupBy(F.expr(f"shuffle_key div {_KEY_BUCKET}").alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_bucket"))  # at most 2^20 rows
    counts = materialize(counts.withColumn("_upto", upto), "take-buckets")
    total, last = counts.agg(F.max("_upto"), F.min(F.when(F.col("_upto") >= n, F.col("_bucket")))).first()
    if n > (total or 0):
        raise ValueError(f"cannot take {n} rows from a table of {total or 0}")
    kept = keyed.filter(F.expr(f"shuffle_key div {_KEY_BUCKET}") <= F.lit(-1 if n == 0 or last is None else last))
    bases = counts.select("_bucket", (F.col("_upto") - F.col("_n")).alias(f"_base_{position}"))
    placed = apply_bucket_bases(kept, [], ["shuffle_key", id_col], {position: F.lit(1)}, bases, _KEY_BUCKET)
    return placed.filter(F.col(position) < F.lit(n))


# --------------------------------------------------------------------------- F3 / F4


def number_shards(shards: DataFrame, source_order: Sequence[str]) -> DataFrame:
    """Give shards the global number of the upstream loader: sources in ``source_order``,
    shards of a source by ``shard_idx`` (dense from 0). Only per-source counts are ordered."""
    order = F.element_at(
        F.create_map(*[x for i, s in enumerate(source_order) for x in (F.lit(s), F.lit(i))]), F.col("source")
    )
    shards = shards.filter(F.col("source").isin(list(source_order)))
    per_source = shards.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ord", order)
    # One row per source (bounded by ``source_order``): a single ordered window is fine.
    w = Window.orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_source.select("source", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"),
                              F.sum("_n").over(Window.partitionBy()).alias("n_shards_total"))
    return shards.join(F.broadcast(bases), "source").select(
        (F.col("_base") + F.col("shard_idx")).cast("bigint").alias("shard_no"),
        "source", "shard_idx", F.col("n_tokens").alias("shard_len"), "n_shards_total",
    )


def check_shards_long_enough(shards: DataFrame, seq_len: int) -> None:
    """Shards of ``seq_len`` ids or fewer would give short windows: refuse, naming them."""
    short = shards.filter(F.col("n_tokens") <= seq_len).select("source", "shard_idx").limit(10).collect()
    if short:
        names = ", ".join(f"{r.source}/{r.shard_idx}" for r in short)
        raise ValueError(f"shards not longer than seq_len={seq_len}: {names}")


def draw_windows(
    spark: SparkSession,
    shards: DataFrame,
    n_samples: int,
    seq_len: int,
    seed: int,
    source_order: Sequence[str],
    check: bool = True,
) -> DataFrame:
    """F3 + F4: for each sample, a shard drawn uniformly (with replacement) and a start drawn
    uniformly in ``[0, max(len - seq_len - 1, 1))``.

    ``shards``: ``(source, shard_idx, n_tokens)``. Returns ``sample_id, source, shard_idx,
    shard_len, start``.
    """
    from corpuspack.session import materialize

    # one row per shard (total tokens / shard size): written once, then checked, counted, joined
    numbered = materialize(number_shards(shards, source_order), "shards")
    if check:
        check_shards_long_enough(numbered.withColumnRenamed("shard_len", "n_tokens"), seq_len)
    total = numbered.agg(F.max("n_shards_total")).first()[0]
    if not total:
        raise FileNotFoundError("no shards to draw from")
    draws = spark.range(n_samples).select(
        F.col("id").alias("sample_id"),
        (hash_draw(F.lit(seed), F.col("id"), F.lit("shard")) % F.lit(int(total))).alias("shard_no"),
    )
    picked = draws.join(numbered, "shard_no")
    hi = F.greatest(F.col("shard_len") - F.lit(seq_len) - 1, F.lit(1))
    return picked.select(
        "sample_id", "source", "shard_idx", "shard_len",
        (hash_draw(F.lit(seed), F.col("sample_id"), F.lit("start")) % hi).alias("start"),
    )


# --------------------------------------------------------------------------- F5


def to_blocks(segments: DataFrame, block_tokens: int) -> DataFrame:
    """Re-cut packed segments at block boundaries: ``(source, shard_idx, block, pos, tokens)``."""
    B = int(block_tokens)
    ex = segments.select(
        "source", "shard_idx", "pos", "tokens", F.col("n_tokens").alias("_n"),
        F.explode(F.sequence(F.expr(f"pos div {B}"), F.expr(f"(pos + n_tokens - 1) div {B}"))).alias("block"),
    )
    lo = F.greatest(F.col("pos"), F.col("block") * F.lit(B))
    hi = F.least(F.col("pos") + F.col("_n"), (F.col("block") + 1) * F.lit(B))
    return ex.select(
        "source", "shard_idx", "block", lo.alias("piece_pos"),
        F.slice("tokens", (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"),
    )


def aligned_blocks(segments: DataFrame, block_tokens: int) -> DataFrame:
    """Segments already cut at block boundaries (``piece_tokens`` = ``block_tokens``) as blocks: nothing is cut again."""
    return segments.select(
        "source", "shard_idx", F.expr(f"pos div {int(block_tokens)}").alias("block"), F.col("pos").alias("piece_pos"),
        F.col("tokens").alias("piece"),
    )


def drawn_shards(segments: DataFrame, draws: DataFrame) -> DataFrame:
    """The segments of shards from which a window is drawn (pruned partitions, where the scan has them)."""
    return segments.join(draws.select("source", "shard_idx").distinct(), ["source", "shard_idx"], "left_semi")


def cut_windows(draws: DataFrame, blocks: DataFrame, seq_len: int, block_tokens: int) -> DataFrame:
    """``seq_len + 1`` ids from ``start``; ``x`` = all but the last, ``y`` = all but the first.

    Each joined piece is trimmed to its overlap with ``[start, start + seq_len]`` before the
    per-sample gather, so that shuffle moves exactly ``seq_len + 1`` ids per window, however
    large the blocks are.
    """
    B, L = int(block_tokens), int(seq_len)
    want = draws.select(
        "sample_id", "source", "shard_idx", "start",
        F.explode(F.sequence(F.expr(f"start div {B}"), F.expr(f"(start + {L}) div {B}"))).alias("block"),
    )
    joined = want.join(blocks, ["source", "shard_idx", "block"])
    lo = F.greatest(F.col("piece_pos"), F.col("start"))
    hi = F.least(F.col("piece_pos") + F.size("piece"), F.col("start") + F.lit(L + 1))
    trimmed = joined.select(
        "sample_id", "source", "shard_idx", "start", lo.alias("_lo"), hi.alias("_hi"), "piece", "piece_pos"
    ).filter(F.col("_hi") > F.col("_lo")).select(
        "sample_id", "source", "shard_idx", "start", F.col("_lo").alias("piece_pos"),
        F.slice("piece", (F.col("_lo") - F.col("piece_pos") + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int"))
        .alias("piece"),
    )
    gathered = trimmed.groupBy("sample_id", "source", "shard_idx", "start").agg(
        F.array_sort(F.collect_list(F.struct("piece_pos", "piece"))).alias("_pieces")
    )
    chunk = F.flatten(F.transform("_pieces", lambda p: p["piece"]))
    out = gathered.select("sample_id", "source", "shard_idx", "start", chunk.alias("_chunk"))
    return out.select(
        "sample_id", "source", "shard_idx", "start",
        F.slice("_chunk", 1, L).alias("x"),
        F.slice("_chunk", 2, L).alias("y"),
    )


# --------------------------------------------------------------------------- F6


def batch_layout(df: DataFrame, micro_batch: int, grad_accum: int, ranks: int) -> DataFrame:
    """place ``sample_id`` in the training schedule.

    Per optimizer step every rank draws ``grad_accum`` micro-batches of ``micro_batch``
    windows: ``sample_id = ((step * ranks + rank) * grad_accum + micro) * micro_batch + slot``.
    """
    per_rank = micro_batch * grad_accum
    per_step = per_rank * ranks
    s = F.col("sample_id")
    return df.select(
        "*",
        F.expr(f"sample_id div {per_step}").alias("step"),
        F.expr(f"(sample_id % {per_step}) div {per_rank}").alias("rank"),
        F.expr(f"(sample_id % {per_rank}) div {micro_batch}").alias("micro"),
        (s % F.lit(micro_batch)).alias("slot"),
    )


def write_windows(windows: DataFrame, path: str) -> None:
    """Write windows per rank (``rank=…`` folders), files in step order.

    Range partitioning on ``(rank, step)`` keeps tasks even (a rank is never one task) and
    gives each file a contiguous run of steps.
    """
    (
        windows.repartitionByRange("rank", "step")
        .sortWithinPartitions("rank", "step", "micro", "slot")
        .write.mode("overwrite")
        .partitionBy("rank")
        .parquet(path)
    )
