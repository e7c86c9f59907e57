"""Raw logs that Spark derives from the driver's tables and lands as files, for queries over the import path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..tables import folder, written


def lines(df: DataFrame, line: Column) -> str:
    """Text files of one line a row."""
    path = folder(df.sparkSession)
    df.select(line.alias("value")).write.text(path)
    return path


def csv(df: DataFrame, sep: str = ",") -> str:
    path = folder(df.sparkSession)
    df.write.options(header=True, sep=sep, escape='"').csv(path)
    return path


parquet = written
