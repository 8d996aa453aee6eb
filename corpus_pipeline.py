"""Corpus pipeline: five stages over `documents`, each written as Parquet and reread by the next.

Each stage takes (spark, docs, sf_dir), works on every row that the stage
before kept, and all but the last return the columns of documents. Null and
empty texts: language ID rejects them, so later stages see them only if called
alone, and then keep them as they are. Repeated rows are copies, of which the
join keeps one. Extra columns pass through. An empty table gives no rows.

Stages that run Python bound the session's Arrow batches by their bytes
(`bound_batches`): an executor's workers serve all stages one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm import bpe, decontam, jaccard, langid, lines
from spectrafold.llm.shared import bound_batches, keep, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of a language; the others, and those without a letter, go."""
    bound_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of chunks and of whole shared runs of lines are cut out of the texts; n_chars follows. No document goes."""
    (removed,) = unused(docs.columns, "removed")
    out = lines.dedup(docs, runs=True, removed=removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the least id that is not null, then the least text hash."""
    bound_batches(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text no benchmark item stands."""
    bound_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the hash of the decoded bytes of each document."""
    bound_batches(spark)
    return bpe.transcode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: Centroids, hashes of lines, connected components, SimHash and merge replay are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
