"""Packing by powers of two: documents are split into binary-length pieces, and pieces of equal length share a bucket.

A document of n tokens becomes n // tokens pieces of full length and one piece for each bit that is set in the rest,
from the longest. Each piece is a sequence of its own: none crosses documents, and none needs padding, since a batch is
drawn from one bucket, in which all sequences have the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, vocabulary

#: Texts whose ids a task holds at a time.
TEXTS = 500


def binary_pieces(counts: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of `counts` ids, in order of document and start."""
    bits = tokens.bit_length() - 1
    full, rest = counts // tokens, counts % tokens
    down = np.arange(bits - 1, -1, -1)
    times = np.concatenate([full[:, None], rest[:, None] >> down & 1], 1)  # how many pieces of each length, longest first
    doc, kind = np.nonzero(times)
    repeat = times[doc, kind]
    doc, length = np.repeat(doc, repeat), np.repeat(tokens >> kind, repeat)
    upto = np.cumsum(length)
    before = (np.cumsum(counts) - counts)[doc]
    return doc, upto - length - before, length


def _decompose(path: str | None, tokens: int, end_id: int, with_ids: bool):
    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path or vocabulary("word_bpe_49k.json"), added=True), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for first in range(0, len(batch), TEXTS):
                part = batch.slice(first, TEXTS)
                encoded = [encoder.encode(t or "") + end for t in part["text"].to_pylist()]
                counts = np.array([len(e) // 4 for e in encoded], np.int64)
                doc, start, length = binary_pieces(counts, tokens)
                raw = memoryview(b"".join(encoded))
                at = (np.cumsum(counts) - counts)[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                cols = [part["doc_id"].take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:  # pieces follow one another as their ids do
                    bounds = pa.array(np.append(at, len(raw) // 4), pa.int32())
                    cols.append(pa.ListArray.from_arrays(bounds, pa.array(np.frombuffer(raw, "<i4"), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return decompose


def decompose(docs: DataFrame, tokens: int = 4096, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Per piece of each row of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and `end_id`; a null text is empty and still has the end id. `tokens` must be a power of
    two. start counts the document's ids before the piece; offset is the piece's place in its sequence, always 0; ids are
    the piece's own ids, if `with_ids`. sequence_id is unique and ascends by bucket: the exponent of the length stands in
    its bits from 56 on. Texts are encoded where they are read, so nothing is shuffled. Repeated rows and rows with null
    doc_id are documents like any other. An empty table gives no rows; other columns are ignored.
    """
    if tokens < 1 or tokens & (tokens - 1):
        raise ValueError(f"tokens must be a power of two, not {tokens}")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_decompose(tokenizer, tokens, end_id, with_ids), kinds)
    exponent = F.length(F.bin("length")) - 1
    return cut.withColumn("sequence_id", F.shiftleft(exponent.cast("long"), 56) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(docs: DataFrame, path: str, tokens: int = 4096, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Write the pieces with their ids as Parquet at `path`, one folder bucket=<length> for each length.

    Every task writes to the folders of the lengths that it has, so a bucket is as many files as tasks and no task holds
    a bucket. An empty table writes no folders.
    """
    pieces = decompose(docs, tokens, tokenizer, end_id, with_ids=True).withColumn("bucket", F.col("length"))
    pieces.write.partitionBy("bucket").parquet(path)
