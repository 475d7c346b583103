"""A corpus pipeline of five stages, each on one operator of ``tracklake.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and
returns a DataFrame; the caller writes it as Parquet and reads it again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracklake.llm import decontaminate, near_copies, packing, pii, toxicity
from tracklake.llm.common import remove, scratch, shared_dir, table
from tracklake.llm.queries import toxicity_model, word_bpe_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard 0.8): that with the smallest id."""
    return near_copies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the kind's name."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences of at most 2048 tokens."""
    return packing.pack(docs, word_bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: The stages learn models, run graphs and tokenise: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again.

    A stage's tables go when it is written; what stays is the last one's.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for nr, (name, stage) in enumerate(STAGES):
        path = f"{base}/{nr}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:  # read to the end by the stage that has just been written
            remove(spark, before)
        before, docs = path, spark.read.parquet(path)
    return docs
