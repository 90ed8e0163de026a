"""Run-versus-baseline benchmark table (H1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The default evaluation tasks, English general and reasoning, then Korean.
DEFAULT_TASKS = ["mmlu", "hellaswag", "arc_challenge", "winogrande", "gsm8k", "kmmlu", "haerae"]
TAGS = ["run", "baseline"]


def score_table(scores: DataFrame, tags: Sequence[str] = TAGS) -> DataFrame:
    """Item-level ``scores(tag, task, item_id, correct)`` → per task: accuracy per tag, delta,
    items per tag. A task missing from one tag gets null there (and a null delta).

    ``pivot`` with the tag list given up front: one aggregation, no extra job to find tags.
    """
    tags = list(tags)
    acc = scores.groupBy("task").pivot("tag", tags).agg(
        F.avg("correct").alias("acc"), F.count("correct").cast("bigint").alias("n")
    )
    first, second = tags[0], tags[1]
    return acc.select(
        "task",
        F.col(f"{first}_acc").alias(first),
        F.col(f"{second}_acc").alias(second),
        (F.col(f"{first}_acc") - F.col(f"{second}_acc")).alias("delta"),
        F.coalesce(F.col(f"{first}_n"), F.lit(0)).cast("bigint").alias(f"n_{first}"),
        F.coalesce(F.col(f"{second}_n"), F.lit(0)).cast("bigint").alias(f"n_{second}"),
    )
