"""The corpus pipeline: the stages in order, each a function ``(spark, docs, sf_dir) -> DataFrame``.

``run`` applies them to ``documents``; each stage's result is written as Parquet to the shared folder and
read again as the next one's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.llm import mixing, near_dedup, packing, quality_rules, toxicity
from corpuspack.llm.common import documents, labels
from corpuspack.session import materialize


#: The columns that operators read; others are renamed while an operator runs, so that none can meet its own names.
READ = ("doc_id", "text", "lang", "source")


def _aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with the columns that no operator reads out of the way, and the columns that bring them back."""
    names = [c if c in READ else f"_aside_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the documents that the classifier does not call toxic."""
    docs, back = _aside(docs)
    scored = toxicity.toxicity(docs, labels(spark, sf_dir), labelled=documents(spark, sf_dir))
    return scored.filter("predicted = 0").select(*back)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the documents that the quality rules keep."""
    docs, back = _aside(docs)
    return quality_rules.keep_good(docs).select(*back)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near-duplicates (similarity 0.8 or more)."""
    docs, back = _aside(docs)
    return near_dedup.keep_one_of_each(docs).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sources replicated to their target weights and shuffled."""
    docs, back = _aside(docs)
    return mixing.mix(docs).select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the documents' pieces packed into training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, similarity on shingles and tokens are not SQL; tests hold the pipeline against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
