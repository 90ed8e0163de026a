"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

#: The space characters between words: blank and U+0009 to U+000D (fixed values).
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process.

    Task functions are shipped by value and unpickled for every task, so a global of their own
    module would start empty each time.
    """
    return sys.__dict__.setdefault("_corpuspack_llm", {})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
