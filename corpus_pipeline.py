"""A corpus pipeline of five stages: quality, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which its predecessor kept; all but the last
return the columns of docs. run() writes each stage's rows as Parquet into the cluster's shared folder and reads them
again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import cotraining, near_copies, pii, tokens, toxicity
from wardline.llm.common import documents, forget, labels, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Rows with a null doc_id are judged by their own text."""
    model = cotraining.train(docs, labels(spark, sf_dir))
    return cotraining.kept(docs, model)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    return toxicity.kept(docs, toxicity.train(docs, labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 5-word Jaccard similarity 0.8 or more connect, the document with the smallest doc_id stays, once if its row
    is repeated. Rows with a null doc_id can't stand for a group: of those with equal texts one stays."""
    groups = near_copies.near_copies(docs)
    first = docs.join(groups.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
    return first.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of 1024 tokens."""
    return tokens.pack(docs)


STAGES = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained classifiers and byte-pair merges have no SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        forget(before)
    return docs
