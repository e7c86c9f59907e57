"""Token ids in ORC files: run-length encoded integers, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch
from .tokens import Encoder, vocabulary


def _encode(path: str | None, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path or vocabulary("word_bpe_49k.json"), added=True), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for first in range(0, len(batch), 1000):
                part = batch.slice(first, 1000)
                ids = [encoder.encode(t or "") + end for t in part["text"].to_pylist()]
                bounds = np.cumsum([0, *map(len, ids)]) // 4
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)], ["doc_id", "n_tokens", "ids"])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Write the ids of each row of `docs` (doc_id, text; null: empty) and `end_id` to ORC files at `path`.

    Files hold ascending ranges of doc_id and are sorted within (nulls first), so row indexes and stripe statistics
    prune ranges of doc_id, and Bloom filters prune single ones. Texts are ranged before they are encoded, so that only
    they are shuffled. `part` numbers the files; rows of equal doc_id are ordered by their text's hash, over several files if
    they are many.
    """
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ids = ranged.mapInArrow(_encode(tokenizer, end_id), "doc_id long, n_tokens long, ids array<int>")
    out = ids.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "doc_id", "n_tokens", "ids")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "compression": "zstd"}
    out.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, place, doc_id, n_tokens, ids; a filter on doc_id is pushed to stripes and Bloom filters."""
    return spark.read.schema("part int, place long, doc_id long, n_tokens long, ids array<int>").orc(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
        offs = ids.offsets.to_numpy()
        raw = memoryview(flat).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([batch["part"], batch["place"], batch["doc_id"], pc.cast(pc.list_value_length(ids), pa.int64()), pa.array(crc, pa.int64())], ["part", "place", "doc_id", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files at `path`, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Documents follow one another by part and place, which is ascending doc_id. Running sums are taken within each file;
    what precedes a file is summed over the files' totals, one row a file. Empty files give no rows.
    """
    rows = read_tokens(spark, path).select("part", "place", "doc_id", "ids").mapInArrow(_sums, "part int, place long, doc_id long, n_tokens long, ids_crc32 long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place"))
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.withColumn("upto", within).join(before.hint("shuffle_hash"), "part").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_to_orc(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """write_tokens() to `path` (a new shared folder if not given), then token_digest() of what it wrote.

    An empty table gives no rows; repeated rows are documents of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch(spark)
    write_tokens(docs, path, tokenizer, end_id)
    return token_digest(spark, path)
