"""The queries of the training-data operators, as the driver calls them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from kvartal.llm import annindex, decontaminate, divergence, embeddings, html, langid, linededup, mixing, negatives, pii, simhash, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that recur across documents."""
    return linededup.line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_components(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens, tokens and bytes of every document."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return annindex.nearest(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector's positives."""
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, and in which terms."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_html": op2_html,
        "op3_mix": op3_mix,
        "op4_embeddings": op4_embeddings,
        "op5_language_id": op5_language_id,
        "op6_line_dedup": op6_line_dedup,
        "op7_simhash": op7_simhash,
        "op8_toxicity": op8_toxicity,
        "op9_pii": op9_pii,
        "op10_token_counts": op10_token_counts,
        "op11_ann": op11_ann,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE, "op4_embeddings": embeddings.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_source_divergence": divergence.ORACLE}
