"""A training corpus in five stages, each written and read again before the next.

Every stage works on all that its predecessor kept. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.llm import decontaminate, langid, linededup, mixing, simhash
from kvartal.llm.names import fresh
from kvartal.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus itself teaches; those without a letter or like none of them go.

    Null and empty texts go, having no letter. Repeated rows stay or go alike. With no
    language learned (no row, no lang) every document goes. Extra columns come through
    as they are, whatever their names.
    """
    names = tuple(fresh(docs.columns, *langid.NAMES))
    return langid.predict(docs, langid.train(docs), names).where(langid.accepted(names)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those with nothing else go.

    n_chars follows the text. Null and empty texts stay as they are: no line of them was
    dropped. Equal rows are one document and are treated alike; rows that share a doc_id
    only are told apart by their texts. No rows: no rows. Extra columns come through as
    they are, whatever their names.
    """
    names = n_lines, n_dropped = tuple(fresh(docs.columns, "n_lines", "n_dropped"))
    out = linededup.line_dedup(docs, names).where((F.col(n_dropped) == 0) | (F.length(F.trim("text")) > 0))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id.

    Null and empty texts have fingerprint zero and are one group. Rows that share a doc_id
    stay or go together, repeated rows too. Rows without doc_id go if a document with one
    is near, and else stay. No rows: no rows. Extra columns come through as they are.
    """
    return simhash.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item.

    Null and empty texts have no words, are not contaminated and stay. Repeated rows stay
    or go alike. An empty benchmark contaminates nothing. No rows: no rows. Extra columns
    come through as they are, whatever their names.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = tuple(fresh(docs.columns, *decontaminate.NAMES))
    return decontaminate.decontaminate(docs, benchmark, whole_rows=True, names=names).where(~F.col(names[-1])).select(*docs.columns)


def _mix_names(docs: DataFrame) -> tuple[str, ...]:
    return tuple(fresh(docs.columns, *mixing.NAMES))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of each, and the shards that it goes to.

    Null and empty texts have size 0 and are never taken. A null source is a source, the
    last. Of equal rows as many are taken as their source's edge asks for. No rows: no
    rows. Extra columns come through as they are; where one has the name of a new column,
    the new one gets an underscore more.
    """
    return mixing.mix(docs, whole_rows=True, names=_mix_names(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: Language profiles, line templates and fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus that the stages make of ``documents``: a row for each time that the mix takes a document, shuffled inside its shard."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = mixing.NAMES
    for name, stage in STAGES:
        names = _mix_names(docs)
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return mixing.draw(docs, shards=names[-1])
