"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that its predecessor kept, and all but the last return the columns of documents. A doc_id names
a document: rows that share one go or stay together. Rows with a null doc_id can't be named by a decision and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwatch.llm.common import remove, scope, scratch, table, written
from pathwatch.llm.decontamination import find_leaks
from pathwatch.llm.minhash_dedup import near_duplicates
from pathwatch.llm.packing import pack_sequences
from pathwatch.llm.substring_dedup import dedup_substrings
from pathwatch.llm.toxicity import score_toxicity


#: Names for a while that no column of documents has.
_TAG, _KEPT = "pipeline text hash", "pipeline kept text"


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(written(ids.select("doc_id").distinct()).hint("merge"), "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return _without(docs, score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the smallest doc_id stays."""
    return _without(docs, near_duplicates(docs).where("not kept"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out; other texts stay as they are."""
    cut = dedup_substrings(docs.select("doc_id", "text"), with_text=True).where("kept_text is not null")
    cut = cut.select("doc_id", F.col("tag").alias(_TAG), F.col("kept_text").alias(_KEPT)).dropDuplicates(["doc_id", _TAG])
    tagged = docs.withColumn(_TAG, F.xxhash64("text")).join(cut.hint("merge"), ["doc_id", _TAG], "left")
    new = {"text": F.coalesce(_KEPT, "text"), "n_chars": F.when(F.col(_KEPT).isNotNull(), F.length(_KEPT).cast("long")).otherwise(F.col("n_chars"))}
    return tagged.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    return pack_sequences(docs)


STAGES = [("toxicity", toxicity), ("minhash_dedup", minhash_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Learned scores, signatures and packing can't be expressed in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote on its way goes once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark, kept=True)
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
