"""A corpus from raw documents: quality, exact copies, near copies, benchmark passages, packed sequences.

Each stage gets what the one before has written, and what it decides takes
effect; all but the last return the columns of ``documents``, whatever further
columns there are and whatever they are called.

Defined results: a null text counts as empty; empty texts get a score like any other,
are equal to each other and link with nothing; of rows with equal texts one stays, also
where their doc_ids are equal or null; a row whose doc_id is null is in no group that
goes; very long texts are read whole; an empty table gives no rows. Tables of labels or
of the benchmark may be empty, have nulls, repeated rows and rows of no document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grantmill.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from grantmill.llm.store import Scratch, table
from grantmill.session import temporaries


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one row of each text stays, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of linked documents the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents of which benchmark passages make up 5 % of the words or more go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: The classifier, the join and packing are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents, each written and read again; what a stage wrote on the way goes."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with temporaries(spark):
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
