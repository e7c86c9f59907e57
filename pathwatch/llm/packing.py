"""Best-fit packing: pieces of documents are packed into sequences under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import Encoder, vocabulary

#: Pieces that one task packs together; groups are dealt out by hash, so that their number grows with the input.
GROUP = 4096


def _pieces(path: str | None, tokens: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path or vocabulary("byte_bpe_50k.json"), added=True), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                ends = range((n - 1) % tokens + 1, n + 1, tokens)
                for piece, stop in enumerate(ends):
                    start = ends[piece - 1] if piece else 0
                    rows.append((doc, piece, start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop])))
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def vector_best_fit(lengths: np.ndarray, capacity: tuple[int, int, int]) -> np.ndarray:
    """A bin for each piece under capacities of tokens, pieces and attention cost (the sum of squared lengths).

    Pieces are taken from the largest. Of the bins that meet every constraint, the one is taken whose residuals, each
    as a share of its capacity and weighted, have the least norm afterwards; with no such bin a new one is opened. The
    residuals are weighted by how much of their capacities all pieces take, so that the scarcest counts most. A piece
    that alone exceeds a capacity gets a bin of its own.
    """
    cap = np.array(capacity, float)
    size = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / cap
    demand = size.sum(0)
    weight = demand / demand.max() if len(lengths) else demand
    out = np.empty(len(lengths), np.int64)
    residual, ids, n_open, n_bins = np.empty((len(lengths), size.shape[1])), np.empty(len(lengths), np.int64), 0, 0
    slack = 1e-12
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    least = np.minimum.accumulate(size[order][::-1], 0)[::-1]  # what the smallest piece still to come needs
    for turn, i in enumerate(order):
        if turn % 256 == 0 and n_open:  # bins that nothing to come can enter are closed
            open_ = (residual[:n_open] >= least[turn] - slack).all(1)
            kept = int(open_.sum())
            residual[:kept], ids[:kept], n_open = residual[:n_open][open_], ids[:n_open][open_], kept
        after = residual[:n_open] - size[i]
        norm = np.where((after >= -slack).all(1), (weight * after**2).sum(1), np.inf)
        at = int(norm.argmin()) if n_open else -1
        if at >= 0 and np.isfinite(norm[at]):
            residual[at], out[i] = after[at], ids[at]
        else:
            out[i], ids[n_open], residual[n_open] = n_bins, n_bins, 1 - size[i]
            n_open, n_bins = n_open + 1, n_bins + 1
    return out


def _pack(capacity: tuple[int, int, int]):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=False, ignore_index=True)
        bins = vector_best_fit(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = rows["grp"] * (1 << 20) + bins
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.drop(columns="grp")

    return pack


def pack_sequences(docs: DataFrame, tokens: int = 1024, pieces: int | None = None, attention: int | None = None, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Per piece of each row of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and `end_id`; a null text is empty and still has the end id. A document of more than
    `tokens` ids is cut into pieces of that many, the first of which may be shorter. A sequence holds at most `tokens`
    ids, `pieces` pieces and an attention cost (sum of squared piece lengths) of `attention`; the last two default to
    what the first implies, and weigh in the choice of a sequence all the same. Pieces are dealt by hash into groups of about 4096, each packed by vector best fit in one
    task; sequence ids are unique over all groups, and offsets in a sequence are gapless from 0. Repeated rows and rows
    with null doc_id are documents like any other. An empty table gives no rows; other columns are ignored.
    """
    capacity = (tokens, pieces or tokens, attention or tokens * tokens)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    cut = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, tokens, end_id), kinds))
    groups = cut.count() // GROUP + 1
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("grp").applyInPandas(_pack(capacity), kinds + ", sequence_id long, offset long")


def lower_bound(packed: DataFrame, tokens: int = 1024) -> DataFrame:
    """One row: sequences used, and the least number that the total of ids allows."""
    return packed.agg(F.count_distinct("sequence_id").alias("sequences"), F.ceil(F.sum("length") / tokens).alias("at_least"))


