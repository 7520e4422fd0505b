"""From raw documents to packed training sequences: toxic ones go, then copies, then near copies.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; all but the
last return the columns of docs. A stage first lets the driver give back what the one before has left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from almanac.llm.common import checkpoint_dir, read, release
from almanac.llm.exact_dedup import exact_dedup
from almanac.llm.near_dedup import near_dedup
from almanac.llm.packing import pack
from almanac.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those judged toxic; null texts are judged as empty ones."""
    release(spark)
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    release(spark)
    return exact_dedup(docs, carry=docs.columns, only_kept=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group of near duplicates, the one with the smallest id; links from a similarity of 0.8."""
    release(spark)
    return near_dedup(docs, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences."""
    release(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", copies), ("near_dedup", near_copies), ("packing", packing)]
#: A trained network and a search don't have an SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's table goes once the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        to = f"{checkpoint_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        before = to
    return STAGES[-1][1](spark, docs, sf_dir)
