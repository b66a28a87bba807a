"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; `run` writes each
stage's rows to the shared folder and reads them back, so a lost executor costs a stage's tasks at most.
ORACLE_SQL is None: fingerprints, the classifier and the packer are beyond SQL; tests compare the stages with
brute force instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lucerna.llm import decontaminate, packing, quality, secrets, simhash
from lucerna.llm.common import drop, spool, table
from lucerna.llm.queries import RANKS_FILE

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from these documents and `labels`, accepts. Null and empty texts are scored as empty
    ones; repeated rows share their score; with nothing to learn from (no positive label, or no document) all stay."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more), the one with the smallest id.
    Rows are judged each by its own text, also where they share an id; a row without an id stays where its group has no other.
    Null, empty and wordless texts are one group; rows equal in id and text are one row after."""
    return simhash.distinct_texts(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows. Texts without words stay; rows that share an
    id, or have none, are judged each by its own text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and their lengths counted anew. Null texts stay null; repeated rows stay."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences. A null text is an empty one: one piece, the end token alone."""
    return packing.pack(packing.pieces(docs, "doc_id", "text", public_tokenizers.path(RANKS_FILE)))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spool(docs, name)
            drop(before)
    return docs
