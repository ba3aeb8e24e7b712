"""A corpus pipeline: toxic documents go, repeated chunks of lines go, near copies go, secrets are blotted out, the rest is
packed. Each stage is written as Parquet to the session's shared folder and read again as the next one's documents.

All stages: null text counts as empty and stays as it is; extra columns stay, whatever their names; an empty table gives an
empty result with the same columns. What repeated rows, ties and null ids do is said at each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import lines, packing, secrets, simhash, toxicity
from tidemark.llm.common import read, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic. Rows are judged one by one, so repeated ones fare alike."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without chunks of lines that came before, by doc_id (null first), then place. Repeated rows of one id and text keep theirs alike."""
    return lines.deduplicated(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the smallest doc_id of each group; all rows of that doc_id stay. Rows with a null doc_id count as one
    document, which stays if some group has no other."""
    return simhash.deduplicated(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret of every kind replaced by a mark. Rows are judged by their text alone."""
    return secrets.redacted(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids; repeated rows are packed as often as they occur."""
    return packing.pack_balanced(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_dedup),
    ("secret_scan", secret_redaction),
    ("packing", sequence_packing),
]

#: No stage of models, hashes and packing is expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result: pieces of packed sequences with their ids. The texts that they encode are scratch tables."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
