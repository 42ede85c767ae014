"""Training-data pipeline over ``documents``: toxicity, exact dedup, SimHash
near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is a stored table, and
works on all of it; all but the last return rows of it with its columns.  ``labels``
and ``benchmark`` are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartlens.llm import decontaminate, exact, simhash, toxicity
from cartlens.llm.common import stored, table
from cartlens.llm.queries import bpe_digest


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity network, trained on the labelled rows of ``docs``, rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group linked within 4 of 64 bits over shingles of 4 words, the row with
    the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs, distance=4, shingle=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests, and of the bytes decoded from them."""
    return bpe_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level bpe", encode),
]

#: The first stage is a trained network, which SQL can't express; tests hold every
#: other stage against brute force on the rows that reach it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two, the rows are written as Parquet
    under the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs), sf_dir)
    return docs
