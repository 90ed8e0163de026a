"""The registered queries of this subpackage: ``opN_<name>(spark, sf_dir)`` over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.llm import attribution, centroids, fingerprints, main_text, mixing, near_dedup, packing, personal_data, quality_rules, ranking, toxicity, warc, word_runs
from corpuspack.llm.common import documents, embeddings, labels, pages


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(pages(spark, sf_dir))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources mixed to weights of their characters to the power 0.7, as large as the corpus."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "text", "copy", "shuffle_key")


def op3_lsh_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op6_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(pages(spark, sf_dir))


def op7_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranking.quality(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(documents(spark, sf_dir))


def op9_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a crossing token goes where most of its bytes are."""
    counted = attribution.token_counts(documents(spark, sf_dir), F.col("text"))
    tokens = F.col("n_tokens").cast("long").alias("n_tokens")
    return counted.select("doc_id", F.col("section").cast("int").alias("line"), "start", "end", tokens, "n_crossing")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op11_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(embeddings(spark, sf_dir))


def op12_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(documents(spark, sf_dir))


def op13_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.periodic_runs(documents(spark, sf_dir), planted=True)


QUERIES = {
    "op1_warc_capture_index": op1_warc_capture_index,
    "op2_poisson_mixing": op2_poisson_mixing,
    "op3_lsh_forest_dedup": op3_lsh_forest_dedup,
    "op4_counterfactual_toxicity": op4_counterfactual_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_line_block_text": op6_line_block_text,
    "op7_bradley_terry_quality": op7_bradley_terry_quality,
    "op8_imatch_fingerprints": op8_imatch_fingerprints,
    "op9_token_attribution": op9_token_attribution,
    "op10_quality_rules": op10_quality_rules,
    "op11_laesa_clusters": op11_laesa_clusters,
    "op12_bilstm_crf_pii": op12_bilstm_crf_pii,
    "op13_dyadic_runs": op13_dyadic_runs,
}

SQL: dict[str, str] = {
    "op1_warc_capture_index": warc.ROUND_TRIP_SQL,
    "op2_poisson_mixing": mixing.MIX_SQL,
    "op11_laesa_clusters": centroids.CLUSTERS_SQL,
}
