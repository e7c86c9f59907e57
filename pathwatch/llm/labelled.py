"""Labelled rows to learn from: a bounded sample of each class, never of held-out documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_labels(labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most `per_class` rows of each class 0 and 1, and how many rows each class has in all.

    Held-out ids and null ids or labels are left out; of repeated ids the largest label counts. Rows are chosen by a
    hash of their id, by Spark's top-k in each partition, so nothing but the sample meets in one place.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id")))
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionAll(parts[1]), total
