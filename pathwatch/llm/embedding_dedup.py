"""Embedding near-dedup: banded signs of projections, then collision counts within buckets, with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

#: Rows of one bucket that a task compares with one another; larger buckets are compared block by block.
BLOCK = 1024
#: Share of pairs at the similarity bound that buckets, and then counts, are calibrated to let through.
BUCKET_RECALL, COUNT_RECALL = 0.998, 0.9999


def bucket_tables(cosine: float, bits: int) -> int:
    """Tables of `bits` sorted projections each that give a pair at the bound a common half-line in all of one table's."""
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - BUCKET_RECALL) / math.log(1 - together))) if together < 1 else 1


def count_bound(projections: int, window: float, distance: float) -> int:
    """The collisions that all but 1 - COUNT_RECALL of pairs at `distance` reach, of `projections` Gaussian ones."""
    p = math.erf(window / (distance * math.sqrt(2)))
    total, k = 0.0, 0
    while k <= projections:
        total += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if total > 1 - COUNT_RECALL:
            break
        k += 1
    return k


def _project(tables: int, bits: int):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Unit vectors and their bucket in each table; vectors of each length are projected in their own space."""
        for batch in batches:
            sizes = batch["vector"].value_lengths().to_numpy()
            for dims in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                directions = np.random.default_rng(20240229).standard_normal((dims, tables * bits))
                x = part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
                with np.errstate(over="ignore", invalid="ignore"):
                    unit = x / np.abs(x).max(1, keepdims=True)
                    unit /= np.sqrt((unit**2).sum(1, keepdims=True))
                side = (unit @ directions > 0).reshape(len(part), tables, bits)
                keys = (side * (1 << np.arange(bits))).sum(2) + (np.arange(tables) << bits)
                lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))
                yield pa.RecordBatch.from_arrays([part["label"], part["node"], part["weight"], lists(unit, pa.float64()), lists(keys, pa.int64())], ["label", "node", "weight", "unit", "keys"])

    return project


def _linked(unit: np.ndarray, other: np.ndarray, directions: np.ndarray, window: float, least: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of unit, row of other) that collide in at least `least` query-centred windows and have the cosine.

    `other` is sorted by each projection, so that a query's window is a range of places, and a collision a place in it.
    """
    a, b = unit @ directions, other @ directions
    kind = np.uint16 if len(other) < 1 << 16 else np.uint32
    order = np.argsort(b, axis=0)
    place = np.empty(b.shape, kind)
    np.put_along_axis(place, order, np.arange(len(b), dtype=kind)[:, None], 0)
    low, wide = np.empty(a.shape, kind), np.empty(a.shape, kind)
    for p in range(a.shape[1]):
        sorted_ = b[order[:, p], p]
        low[:, p] = np.searchsorted(sorted_, a[:, p] - window, "left")
        wide[:, p] = np.searchsorted(sorted_, a[:, p] + window, "right") - low[:, p]
    place = np.ascontiguousarray(place.T)
    i, j = [], []
    for first in range(0, len(a), 64):
        q = slice(first, first + 64)
        count = np.zeros((len(a[q]), len(b)), np.uint8 if directions.shape[1] < 256 else np.uint32)
        for p in range(directions.shape[1]):
            count += place[p] - low[q, p, None] < wide[q, p, None]  # places before the window wrap around to large numbers
        x, y = np.nonzero(count >= least)
        close = np.einsum("ij,ij->i", unit[first + x], other[y]) >= cosine
        i.append(first + x[close])
        j.append(y[close])
    return np.concatenate(i), np.concatenate(j)


def _compare(projections: int, window: float, least: int, cosine: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks of one bucket: for each row its links found first here, and the root of its links."""
        if len(rows) < 2:
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        table = int(rows["table"].iloc[0])
        rows = rows.sort_values(["block", "node"], ignore_index=True)
        split = rows["block"].to_numpy() == rows["left"].to_numpy()[0]
        unit, keys = np.stack(rows["unit"]), np.stack(rows["keys"])
        directions = np.random.default_rng(20240301).standard_normal((unit.shape[1], projections))
        node, weight = rows["node"].to_numpy(), rows["weight"].to_numpy()
        left = np.flatnonzero(split)
        right = left if split.all() else np.flatnonzero(~split)
        i, j = _linked(unit[left], unit[right], directions, window, least, cosine)
        i, j = left[i], right[j]
        once = i != j if split.all() else np.ones(len(i), bool)
        once &= ~(keys[i, :table] == keys[j, :table]).any(1)  # an earlier table has this pair
        once &= node[i] != node[j]
        i, j = i[once], j[once]
        links = np.bincount(i, weight[j], len(rows))
        if not split.all():
            links += np.bincount(j, weight[i], len(rows))
        root = np.arange(len(rows))
        while True:  # least root over links, with pointers jumped
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some].astype("int64"), "root": node[root[some]]})

    return compare


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, projections: int = 64) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows of equal label and length are linked if their cosine in double precision is at least `cosine`. n_links counts the other
    rows linked directly; component_id is the smallest vec_id that links reach; kept is vec_id = component_id. Rows with
    a null label or vec_id, and vectors that are null, empty, zero, or hold null or non-finite components, link with
    nothing; a null vec_id has null component_id and is kept. Equal
    vectors of a label are one node with a weight and link with one another, whatever rounding makes of their cosine.
    Repeated rows are rows of their own; different vectors of one vec_id share their links. An empty table gives no rows; other columns are ignored.

    Each table puts rows in buckets by the signs of several projections; rows of one bucket are candidates
    (the number of projections a table follows the largest label's rows, and the number of tables the recall that this
    leaves at the bound). Candidates collide on a further projection if they differ by at most the window around the
    query, as wide as the distance at the bound; a bucket's rows are sorted by each projection for that. Those that collide often enough, by a count that all but 0.01 % of pairs
    at the bound reach, are verified. So about 0.2 % of the pairs at the bound, and fewer of closer ones, are not found.
    A bucket of more than 1024 rows is compared in pairs of blocks, each one task; a task returns only a count and a
    root for each row, never pairs.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform(e, lambda x: x.cast("double")).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(good, F.concat(F.size("vector").cast("string"), F.lit(":"), "label")).alias("label"), F.when(good, F.transform("vector", lambda x: x + F.lit(0.0))).alias("vector")).withColumn("good", F.col("label").isNotNull())
    rows = written(rows.withColumn("digest", F.when(F.col("good"), F.sha2(F.to_json(F.struct("label", "vector")), 256))))
    nodes = rows.where("good").groupBy("digest").agg(F.first("label").alias("label"), F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    distance = math.sqrt(2 - 2 * cosine)
    least = count_bound(projections, distance, distance)
    largest = rows.where("good").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = max(4, min(30, math.ceil(math.log2(largest / 64 + 1))))
    tables = bucket_tables(cosine, bits)

    signed = written(nodes.mapInArrow(_project(tables, bits), "label string, node long, weight long, unit array<double>, keys array<long>"))
    placed = signed.select("label", "node", F.explode("keys").alias("key"))
    sizes = placed.groupBy("label", "key").count().where("count > 1").select("label", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = signed.select("*", F.explode("keys").alias("key")).join(sizes.hint("merge"), ["label", "key"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).withColumn("table", F.shiftright("key", bits).cast("int"))
    found = dealt.groupBy("label", "key", "left", "right").applyInPandas(_compare(projections, distance, least, cosine), "node long, links long, root long")
    found = written(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))

    of = nodes.select("digest", "node", "weight").join(links.hint("merge"), "node", "left").join(components.hint("merge"), "node", "left")
    out = rows.select("vec_id", "digest").join(of.hint("merge"), "digest", "left")
    out = out.select("vec_id", F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "node", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
