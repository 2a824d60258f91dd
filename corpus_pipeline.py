"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Documents scored toxic go; one document of each group of near copies stays; documents that
hold benchmark passages beyond the contamination limit go; secrets in the texts that
remain are masked; at last every text becomes a sampled sequence of pieces.

Defined cases: null and empty texts are no copies of anything, are clean, and have no pieces; rows with a
null doc_id go through all stages as others do and are never copies; rows that share a doc_id are judged by their own
texts, equal ones become one; texts of any length are read whole; without labels of both classes nothing is toxic; an
empty benchmark contaminates nothing; an empty documents table gives an empty result; extra columns go
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import decontaminate, ngram_join, piece_sampling, secrets, toxicity_gru
from treeline.llm.shared import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network scores below 0.5."""
    return toxicity_gru.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by n-gram similarity the document with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the contamination limit."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact_secrets(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids, lossless."""
    return piece_sampling.encode_rows(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode_pieces),
]
#: No stage but one is SQL's to express; the tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
