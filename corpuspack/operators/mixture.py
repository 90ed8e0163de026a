"""Mixture: per-source budgets, union of sources, effective weights, epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Token budgets per mixture part and scale.
SCALES = {
    "validate": {"en": 8_000_000_000, "ko": 2_500_000_000, "code": 1_500_000_000},
    "full": {"en": 65_000_000_000, "ko": 20_000_000_000, "code": 15_000_000_000},
}
# Which registered source fills which mixture part.
PARTS = {"fineweb-edu": "en", "fineweb-2-kor": "ko", "the-stack": "code"}


def mixture_budgets(scale: str = "full", parts: dict[str, str] | None = None) -> dict[str, int]:
    """Source → token target. ``validate`` is the small run; any other word means full."""
    budget = SCALES["validate"] if scale == "validate" else SCALES["full"]
    parts = PARTS if parts is None else parts
    return {source: budget[part] for source, part in parts.items()}


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """The mixture is the union of its sources (UNION ALL by column name)."""
    if not frames:
        raise ValueError("no sources in the mixture")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _per_source(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("source").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_shards"), F.sum("n_tokens").cast("bigint").alias("n_tokens")
    )


def mix_weights(inventory: DataFrame) -> DataFrame:
    """Shards are drawn uniformly, whatever their length, so a source's real weight is its
    share of shards, not of tokens. Reports both (one row per source)."""
    per = _per_source(inventory)
    # One row per source: a global window over this table is bounded by the number of sources.
    everything = Window.partitionBy()
    return per.select(
        "source", "n_shards", "n_tokens",
        (F.col("n_shards") / F.sum("n_shards").over(everything)).alias("shard_weight"),
        (F.col("n_tokens") / F.sum("n_tokens").over(everything)).alias("token_share"),
    )


def tokens_per_step(micro_batch: int, grad_accum: int, ranks: int, seq_len: int) -> int:
    return int(micro_batch) * int(grad_accum) * int(ranks) * int(seq_len)


def mix_epochs(inventory: DataFrame, steps: int, micro_batch: int, grad_accum: int, ranks: int, seq_len: int) -> DataFrame:
    """Epochs over unique tokens, overall (``source`` = '*') and per source.

    A source receives a share of the drawn windows equal to its shard weight, so its expected
    epochs are ``trained * n_shards / all_shards / n_tokens``.
    """
    tps = tokens_per_step(micro_batch, grad_accum, ranks, seq_len)
    trained = int(steps) * tps
    per = _per_source(inventory)
    total = per.agg(F.lit("*").alias("source"), F.sum("n_shards").alias("n_shards"), F.sum("n_tokens").alias("n_tokens"))
    everything = Window.partitionBy()
    per_rows = per.select(
        "source", "n_shards", "n_tokens",
        ((F.lit(trained) * F.col("n_shards")) / (F.sum("n_shards").over(everything) * F.col("n_tokens"))).alias("epochs"),
    )
    total_rows = total.select(
        "source", F.col("n_shards").cast("bigint").alias("n_shards"), F.col("n_tokens").cast("bigint").alias("n_tokens"),
        (F.lit(trained) / F.col("n_tokens")).alias("epochs"),
    )
    return per_rows.unionByName(total_rows).select(
        "source", "n_shards", "n_tokens", F.lit(tps).cast("bigint").alias("tokens_per_step"),
        F.lit(int(steps)).cast("bigint").alias("steps"), F.lit(trained).cast("bigint").alias("trained_tokens"), "epochs",
    )
