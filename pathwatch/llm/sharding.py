"""Sharding by extendible hashing: a directory of hash-prefix bits in which only oversized buckets split further."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of the hash that a directory can use, and how many a round looks at.
BITS, STEP = 60, 12


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def row_hash(key: str) -> Column:
    """hash60 of a row's key; rows without one are dealt by their text."""
    return hash60(F.coalesce(F.col(key).cast("long").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))))


def shard_directory(sizes: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard, rows, bytes): the leaves of the directory over `sizes` (hash, bytes).

    A bucket of hash prefix `prefix` of `depth` bits is a leaf if its rows fit `limit` bytes, or if its hashes have no
    further bit to split on; a bucket without rows isn't listed. shard is the prefix in bits, or 'all' at depth 0.
    Each round sums the rows of buckets not settled yet by 12 further bits and rolls these sums up to each depth, so
    rows are read once for every 12 bits that the largest buckets need, not once for each split.
    """
    left, leaves, depth = sizes, None, 0
    while True:
        fine = written(left.groupBy(F.shiftright("hash", max(0, BITS - depth - STEP)).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")))
        steps = range(depth, min(depth + STEP, BITS) + 1)
        levels = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("fine", steps[-1] - d).alias("prefix")) for d in steps]))
        sums = written(fine.select("bytes", "rows", levels.alias("l")).groupBy("l.depth", "l.prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")))
        fits = (F.col("bytes") <= limit) | (F.col("depth") == BITS)
        parent = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        new = sums.where(fits & (F.col("depth") == depth)) if not depth else sums.where("false")
        new = new.unionByName(sums.where(fits).join(parent.hint("merge"), ["depth", "prefix"], "left_semi"))
        leaves = new if leaves is None else leaves.unionByName(new)
        depth = steps[-1]
        large = sums.where(~fits & (F.col("depth") == depth)).select("prefix")
        if depth == BITS or not large.limit(1).count():
            break
        left = written(left.withColumn("prefix", F.shiftright("hash", BITS - depth)).join(large.hint("merge"), "prefix", "left_semi").drop("prefix"))
    bits = F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))
    return leaves.select("depth", "prefix", F.when(F.col("depth") == 0, "all").otherwise(bits).alias("shard"), "rows", "bytes")


def _sharded(docs: DataFrame, limit: int, key: str) -> DataFrame:
    """shard() with each row's hash."""
    rows = written(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), row_hash(key).alias("hash")))
    leaves = written(shard_directory(rows.select("hash", F.col("n_bytes").alias("bytes")), limit))
    depths = [r.depth for r in leaves.select("depth").distinct().collect()]  # at most 61
    at = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]) if depths else F.array().cast("array<int>")))
    at = at.withColumn("prefix", F.expr(f"shiftright(hash, {BITS} - depth)"))
    return at.join(leaves.hint("merge"), ["depth", "prefix"]).select("doc_id", "n_bytes", "shard", "depth", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "hash")


def shard(docs: DataFrame, limit: int = 4 << 20, key: str = "doc_id") -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, shard, depth, shard_rows, shard_bytes.

    n_bytes counts the text's UTF-8 bytes (null: 0). Every shard holds at most `limit` bytes, unless rows of equal hash
    exceed it alone: rows of one doc_id, equal texts without one, or one text longer than that. Such a shard has depth 60,
    and shard_bytes shows it. Rows with null doc_id are dealt by their text. An empty table gives no rows; other columns
    are ignored.
    """
    return _sharded(docs, limit, key).drop("hash")


def write_shards(docs: DataFrame, path: str, limit: int = 4 << 20) -> None:
    """Write `docs` as one Parquet folder per shard. A shard that fits `limit` is one file, written by one task; one whose
    rows have equal hashes, so that it can't be split, is dealt over as many tasks as limits it takes.

    Every row is written, those of null doc_id too. A column of `docs` that is called shard is replaced.
    """
    found = _sharded(docs.select("doc_id", "text"), limit, "doc_id")
    spread = found.groupBy(F.col("hash").alias("_hash")).agg(F.first("shard").alias("_shard"), F.ceil(F.first("shard_bytes") / limit).alias("_tasks"))
    placed = docs.withColumn("_hash", row_hash("doc_id")).join(spread.hint("merge"), "_hash").withColumn("shard", F.col("_shard"))
    # Rows are counted through, so that equal ones spread, too.
    placed = placed.withColumn("_turn", F.pmod(F.monotonically_increasing_id(), F.greatest("_tasks", F.lit(1))))
    placed.repartition("shard", "_turn").drop("_hash", "_shard", "_tasks", "_turn").write.partitionBy("shard").parquet(path)
