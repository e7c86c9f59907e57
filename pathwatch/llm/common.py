"""What the operators of this subpackage share: written intermediate tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders written within the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written within it are removed at its end; results that outlive it are written `kept`."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession, kept: bool = False) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local one only where that is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pathwatch-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/pathwatch/{uuid.uuid4().hex}"
    if _SCOPES and not kept:
        _SCOPES[-1].append(path)
    return path


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of `df`, written once as Parquet in the shared folder (or at `path`) and read back.

    Lineage ends there, so that a lost executor costs no recomputation, and Spark knows the table's size.
    """
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long); component is the least node reachable.

    Alternating large-star and small-star rounds: each links a node's larger neighbours, then its smaller ones, to
    its least neighbour, until nothing changes. A node's neighbours are never gathered: the least comes from a
    partially aggregated min(), and a join hands it on. No edges give no rows; loops and repeated edges are ignored.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def facts(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        return tuple(row)

    known = facts(now)
    while known[0]:
        if known[0] == known[2] and not now.join(now.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi").limit(1).count():
            break  # each node has one parent and no parent has one: stars
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = written(small)
        before, known = known, facts(now)
        if known == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
