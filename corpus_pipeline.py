"""The corpus pipeline: from raw documents to packed training sequences, each stage written as Parquet and read again.

Each stage works on all rows that the one before it kept and judges rows, not doc_ids: rows without a doc_id, or that
share one, are documents of their own. A null text is an empty document, which the quality rules reject; an empty table
goes through as one; other columns than those of documents are dropped, whatever their names. What the stages do about
very long texts, ties and repeated rows, their operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.llm import jaccard, mixing, packing, quality, secrets
from fathomline.llm.common import cut, ensure_checkpoint_dir, if_small, numbered, remove_at_exit

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the classifier is trained on the labelled ones."""
    return quality.judge(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 80 % similarity hold together, the one of smallest doc_id (null last).

    Rows are numbered first, so copies are told apart also where their doc_id is null or the same. Documents without
    words are in no group and stay.
    """
    rows = numbered(docs, COLUMNS)
    found = jaccard.components(rows.select(F.col("row").alias("doc_id"), "record.text"))
    ids = rows.select("row", F.col("record.doc_id").alias("id"))
    first = found.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row"))
    return rows.join(if_small(cut(first.select("row"))), "row", "left_semi").select("record.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark, and their number of characters brought up to date."""
    found = secrets.scan(docs.select(*COLUMNS), carry=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's weight asks for."""
    return mixing.stream(docs.select(*COLUMNS), boundary="round")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with the sequence and the place each has."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained stages; tests/llm/test_pipeline.py holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them goes to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
