"""Training-data pipeline: filter, dedup, decontaminate and encode the documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between
stages the documents are written as Parquet and read again. Part of the subpackage llm.

Edge cases: a null or empty text is a document like others (all empty ones are equal, one stays);
rows that repeat an id are told apart by their texts; columns besides id and text are carried
along, whatever their names; without labels nothing is toxic, without a benchmark nothing leaks;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontaminate, exact_dedup, ngram_join, piece_sampling, toxicity
from corpusmill.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on those that are left and labelled, rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return ngram_join.keep_one_per_class(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark, copied or edited, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document that is left."""
    return piece_sampling.sample_encodings(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("piece sampling", encode),
]

#: Word alignment, trained models and MinHash have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared checkpoint folder.

    They stay there, as the result is read from the last of them; the folder is the caller's to clear.
    """
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}")
            docs = spark.read.parquet(f"{top}/{k}")
    return docs
