"""From raw documents to token ids: rules, near duplicates, benchmark passages, secrets, encoding.

Each stage reads all that its predecessor kept, written as Parquet to the shared folder, and its decisions take
effect. All but the last return the columns of `documents`, further ones whatever their names too. Rows are judged by
their own values, also where ids are null or repeat: null and empty texts fail the quality rules; in near-dedup rows
of a null id all stay, and of rows that share id and text one does. Whole texts are read, however long. An empty table
passes all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentrel.llm import bpe, decontam, minhash, queries, rules, secrets
from sentrel.llm._shared import scratch_path
from sentrel.sources.commits import remove as deleted


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return rules.without_rejected(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return minhash.without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go."""
    return decontam.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return bpe.encode(docs, queries.VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", ruled),
    ("MinHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redacted),
    ("BPE encoding and decoding", encoded),
]

#: The quality rules' covariance estimates and the inferred automata are iterative, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's documents are written once, and deleted when the next stage's are; the last ones stay, as the result reads them."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            deleted(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
