"""Importance resampling towards a target distribution, over hashed n-gram features.

Each batch of texts interns its n-grams in an open-addressed NumPy table: xxhash64 keys, verified byte by byte, with a
bucket and a count in every slot. An n-gram's bucket is taken once a slot, and what its occurrences give to the counts of
buckets, or get from their gains, goes through the slots' ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .textbuf import slices, text_buffer

_M = np.uint64
_P1, _P2, _P3, _P4, _P5 = map(_M, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that share a table; one of this size stays in the processor's caches.
BATCH_BYTES = 1 << 20
#: Bytes of words once A-Z are lower-cased: digits, a-z, and all of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << _M(r) | x >> _M(64 - r)


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxhash64(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxhash64 of the spans of `buf`, which has eight bytes beyond the last one, all spans at once."""
    eight = np.lib.stride_tricks.as_strided(buf[:8].view("<u8"), shape=(len(buf) - 7,), strides=(1,))
    four = np.lib.stride_tricks.as_strided(buf[:4].view("<u4"), shape=(len(buf) - 3,), strides=(1,))
    seeds = np.array([seed], np.uint64) + np.array([int(_P1) + int(_P2) & 2**64 - 1, _P2, 0, 2**64 - int(_P1)], np.uint64)
    h = np.full(len(start), np.uint64(seed)) + _P5
    at, left = start.copy(), size.copy()
    long_ = np.flatnonzero(size >= 32)
    if len(long_):
        acc = [np.full(len(long_), v, np.uint64) for v in seeds]
        who = np.arange(len(long_))
        while len(who):
            for k in range(4):
                acc[k][who] = _round(acc[k][who], eight[at[long_[who]] + 8 * k])
            at[long_[who]] += 32
            left[long_[who]] -= 32
            who = who[left[long_[who]] >= 32]
        total = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            total = (total ^ _round(np.zeros(len(a), np.uint64), a)) * _P1 + _P4
        h[long_] = total
    h += size.astype(np.uint64)
    while len(w := np.flatnonzero(left >= 8)):
        h[w] = _rotl(h[w] ^ _round(np.zeros(len(w), np.uint64), eight[at[w]]), 27) * _P1 + _P4
        at[w] += 8
        left[w] -= 8
    w = np.flatnonzero(left >= 4)
    h[w] = _rotl(h[w] ^ four[at[w]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    at[w] += 4
    left[w] -= 4
    while len(w := np.flatnonzero(left > 0)):
        h[w] = _rotl(h[w] ^ buf[at[w]].astype(np.uint64) * _P5, 11) * _P1
        at[w] += 1
        left[w] -= 1
    h = (h ^ h >> _M(33)) * _P2
    h = (h ^ h >> _M(29)) * _P3
    return h ^ h >> _M(32)


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the pairs of spans (a, b: starts) hold the same bytes, eight at a time."""
    eight = np.lib.stride_tricks.as_strided(buf[:8].view("<u8"), shape=(len(buf) - 7,), strides=(1,))
    same, who, done = np.ones(len(a), bool), np.flatnonzero(size > 0), 0
    while len(who):
        differ = eight[a[who] + done] ^ eight[b[who] + done]
        rest = size[who] - done
        short = rest < 8
        differ[short] &= (_M(1) << (rest[short].astype(np.uint64) * _M(8))) - _M(1)
        same[who] = differ == 0
        who = who[(differ == 0) & (rest > 8)]
        done += 8
    return same


class NgramTable:
    """An open-addressed table of the distinct byte spans of one buffer.

    A slot holds the key (xxhash64), the span that took it, its bucket and how often it came. Spans whose keys agree and
    whose bytes don't go on to the next slot, as all collisions do; at most half of the slots are taken.
    """

    def __init__(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int):
        capacity = 1 << max(4, int(2 * len(start)).bit_length())
        self.key, self.owner = np.zeros(capacity, np.uint64), np.full(capacity, -1, np.int64)
        self.slot = self._intern(buf, start, size, _M(capacity - 1))
        self.count = np.bincount(self.slot, minlength=capacity)
        self.bucket = np.zeros(capacity, np.int64)
        taken = np.flatnonzero(self.owner >= 0)
        raw, first = memoryview(buf), self.owner[taken]
        self.bucket[taken] = [zlib.crc32(raw[a : a + n]) % buckets for a, n in zip(start[first].tolist(), size[first].tolist())]

    def _intern(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, mask: np.uint64) -> np.ndarray:
        key = xxhash64(buf, start, size)
        slot = (key & mask).astype(np.int64)
        left = np.arange(len(start))
        while len(left):
            s = slot[left]
            free = left[self.owner[s] < 0]
            self.owner[slot[free]] = free  # of several that want one slot the last gets it, and the rest compare with it
            self.key[slot[free]] = key[self.owner[slot[free]]]
            owner = self.owner[s]
            equal = (self.key[s] == key[left]) & (size[owner] == size[left])
            equal[equal] = same_bytes(buf, start[owner[equal]], start[left[equal]], size[left[equal]])
            left = left[~equal]
            slot[left] = (slot[left] + 1) & int(mask)
        return slot


def ngram_spans(buf: np.ndarray, offs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as words joined by one space, and their runs of 1 to `most` words: (buffer, start, size, row, words of each row)."""
    n = int(offs[-1])
    low = _LOWER[buf[:n]]
    solid = _WORD[low]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    letters = low[solid]
    size = last - first
    start = np.cumsum(size) - size + np.arange(len(size))  # a space follows each word
    joined = np.full(len(letters) + len(size) + 8, 0x20, np.uint8)
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    per_row = np.diff(np.searchsorted(first, offs))
    row = np.repeat(np.arange(len(per_row)), per_row)
    starts, sizes, rows = [start], [size], [row]
    for k in range(1, most):
        at = np.flatnonzero(row[:-k] == row[k:]) if len(row) > k else np.zeros(0, np.int64)
        starts.append(start[at])
        sizes.append(start[at + k] + size[at + k] - start[at])
        rows.append(row[at])
    return joined, np.concatenate(starts), np.concatenate(sizes), np.concatenate(rows), per_row


def _buckets(most: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                joined, start, size, _, _ = ngram_spans(*text_buffer(part["text"]), most)
                table = NgramTable(joined, start, size, buckets)
                taken = table.owner >= 0
                np.add.at(total, table.bucket[taken], table.count[taken])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many n-grams of 1 to `most` words of `texts` (text) fall in each bucket; those without any are left out."""
    return texts.select("text").mapInArrow(_buckets(most, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """What an occurrence in each bucket adds to a weight, from two bucket_counts(): `buckets` whole numbers.

    floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), in doubles, with t of the target's T and s of the
    source's S. The counts are `buckets` rows at most, however large the tables are, so they are gathered.
    """
    counts = []
    for df in (source, target):
        dense = np.zeros(buckets)
        for r in df.collect():
            dense[r.bucket] = r.n
        counts.append(dense)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weights(gains: np.ndarray, most: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                joined, start, size, row, words = ngram_spans(*text_buffer(part["text"]), most)
                table = NgramTable(joined, start, size, len(gains))
                gain = gains[table.bucket][table.slot]
                weight = np.zeros(len(part), np.int64)
                np.add.at(weight, row, gain)
                features = np.bincount(row, minlength=len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(words.astype(np.int64)), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def ranked(rows: DataFrame, order: list, upto) -> DataFrame:
    """`rows` (place: unique) with rank 1, 2, 3, ... in `order`, in ranges of it, null from rank `upto(number of rows)` + 1 on.

    Ranges are numbered within; what precedes a range is summed over the ranges' sizes, one row a range.
    """
    dealt = rows.repartitionByRange(*order, "place").sortWithinPartitions(*order, "place")
    numbered = written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    last = upto(sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    rank = F.col("_before") + F.col("_at") + 1
    placed = numbered.join(before.hint("broadcast"), "_part")  # as many rows as shuffle partitions, whatever the input
    return placed.select(*rows.columns, F.when(rank <= last, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, most: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_features, weight, score, rank, all long; rank is null unless drawn.

    Words are runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased. Features are all runs of 1 to
    `most` words joined by one space; a feature's bucket is its crc32 modulo `buckets`. weight sums bucket_gains() towards
    the texts of `target` over a document's features (none: 0). score adds Gumbel noise, floor(-1000 * ln(-ln(u))) with u
    from the SHA-256 of `<seed>:<doc_id>`, so that the highest scores are a sample without replacement in proportion to
    exp(weight / 1000). Of documents with at least `min_words` words the highest `percent` in a hundred are drawn, ties to
    the smaller doc_id, and rank counts them from 1.

    Null and empty texts have no features; a null doc_id counts as an empty text in the noise and ranks before others of
    its score; repeated rows are documents of their own. An empty table gives no rows; an empty target gives gains
    towards rare buckets. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets), buckets)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighed = base.mapInArrow(_weights(gains, most), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("place")))
    can = F.col("n_words") >= min_words
    drawn = ranked(scored.where(can), [F.desc("score"), F.asc_nulls_first("doc_id")], lambda n: percent * n // 100)
    rest = scored.where(~can).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
