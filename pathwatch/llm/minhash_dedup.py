"""MinHash near-dedup with DartMinHash signatures, banded joins, and exact verification of what the bands propose.

A document is the weighted set of its word shingles. Every shingle owns a fixed, hashed Poisson shower of darts on the
plane of weight by time; a dart lies in a document's region if its weight position is below the shingle's weight there.
Each dart hits one of `k` coordinates, and the earliest dart per coordinate is the signature: two documents agree on a
coordinate with the probability of their weighted Jaccard similarity. Darts are thrown cell by cell in order of time,
for all coordinates at once, until each coordinate holds one: about k ln k darts a document, instead of k a shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, written
from .textbuf import Words, grams, mix, slices, text_buffer

_M = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Parts of the hash space in which shared shingles are counted.
PARTS = 64


def _poisson(mean: float) -> np.ndarray:
    """Upper bounds, as 64-bit numbers, of the hashes that give 0, 1, 2, ... darts."""
    p, total, out = float(np.exp(-mean)), 0.0, []
    for n in range(1, 40):
        total += p
        out.append(min(total, 1.0))
        p *= mean / n
        if total >= 1 - 1e-16:
            break
    return (np.array(out) * 2.0**64).clip(max=2.0**64 - 2048).astype(np.uint64)


#: Cells of time: [0, 1/64), then doubling up to 1, then of width 1; with the darts that a unit of weight gets in each.
_CELLS = [(0.0, 1 / 64)] + [(2.0**e, 2.0**e) for e in range(-6, 0)]
_COUNTS = {width: _poisson(width) for width in {w for _, w in _CELLS} | {1.0}}


def _cell(c: int) -> tuple[float, float]:
    return _CELLS[c] if c < len(_CELLS) else (1.0 + c - len(_CELLS), 1.0)


def signatures(element: np.ndarray, doc: np.ndarray, n_docs: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """The dart that each of k coordinates keeps, for documents 0 .. n_docs - 1; 0 throughout for one without elements.

    element: hashes; doc: their documents, ascending; weight: above 0, 1 if not given. An element of weight w counts
    as ceil(w) unit strips of the plane, the last cut at its fraction. Repeating an element doesn't change the result.
    """
    if weight is not None:
        strips = np.ceil(weight).astype(np.int64)
        which = np.repeat(np.arange(len(element)), strips)
        strip = np.arange(len(which)) - np.repeat(np.cumsum(strips) - strips, strips)
        element, doc, share = mix(element[which] + strip.astype(np.uint64) * _M(0xD1342543DE82EF95)), doc[which], weight[which] - strip
    else:
        share = None
    kept = np.zeros(n_docs * k, np.uint64)
    filled = np.zeros(n_docs * k, bool)
    cell = 0
    while len(element):
        if cell == 5 and weight is None:  # what is left has few distinct elements, but may repeat them often
            element, doc, _ = _weighted(element, doc)
        width = _cell(cell)[1]
        counts = _COUNTS[width]
        h = mix(element + _M((cell + 1) * 0x9E3779B97F4A7C15 % 2**64))
        some = np.flatnonzero(h >= counts[0])
        n = np.searchsorted(counts, h[some], "right")
        at = np.repeat(some, n)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(h[at] ^ (turn + 1).astype(np.uint64) * _M(0xA0761D6478BD642F))
        slot = doc[at] * k + ((dart >> _M(32)) * _M(k) >> _M(32)).astype(np.int64)
        free = ~filled[slot]
        if share is not None:
            free &= (mix(dart + _M(0x5851F42D4C957F2D)) >> _M(11)) * 2.0**-53 < share[at]
        slot, dart = slot[free], dart[free]
        order = np.lexsort((mix(dart ^ _M(0xE7037ED1A0B428DB)), slot))  # the second hash is the time within the cell
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        kept[slot[first]], filled[slot[first]] = dart[first], True
        done = filled.reshape(n_docs, k).all(1)
        if done.any():
            left = ~done[doc]
            element, doc = element[left], doc[left]
            share = share[left] if share is not None else None
        cell += 1
    return kept.reshape(n_docs, k)


def shingles(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes of the word shingles of each row, A-Z lower-cased, and their rows; a shorter row is one shingle of all its words."""
    w = Words(_LOWER[buf], offs)
    h, rows, counts = w.hashes(), w.rows(), w.counts()
    g = grams(h, words)
    at = np.flatnonzero(rows[: len(g)] == rows[words - 1 :]) if len(g) else np.zeros(0, np.int64)
    element, doc = g[at], rows[at]
    for i in np.flatnonzero((counts > 0) & (counts < words)):
        own = h[w.first[i] : w.first[i + 1]]
        element, doc = np.append(element, grams(own, len(own)) + _M(len(own))), np.append(doc, i)
    order = np.argsort(doc, kind="stable")
    return element[order], doc[order], w


def _weighted(element: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((element, doc))
    element, doc = element[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    at = np.flatnonzero(new)
    return element[at], doc[at], np.diff(np.append(at, len(doc))).astype(float)


def _weight(times: np.ndarray) -> np.ndarray:
    """The weight of a shingle that comes so many times: 1, and 1 more each time that doubles."""
    return np.floor(np.log2(times)) + 1


def _sign(words: int, bands: int, rows: int, counted: bool):
    k = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = text_buffer(part["text"])
                element, doc, w = shingles(buf, offs, words)
                if counted:
                    element, doc, times = _weighted(element, doc)
                sig = signatures(element, doc, len(part), k, _weight(times) if counted else None)
                keys = np.zeros((len(part), bands), np.uint64)
                for j in range(rows):
                    keys = mix(keys * _M(0x9E3779B97F4A7C15) + sig[:, j::rows])
                keys = mix(keys + np.arange(bands, dtype=np.uint64))
                raw = w.buf.tobytes()
                digests = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(offs[:-1], offs[1:])]
                flat = pa.array(keys.view(np.int64).ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * bands, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["tag"], pa.array(w.counts(), pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "tag", "n_words", "digest", "bands"])

    return sign


def _sets(words: int, counted: bool):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                element, doc, times = _weighted(*shingles(*text_buffer(part["text"]), words)[:2])
                if counted:  # each unit of a shingle's weight is an element of its own
                    times = _weight(times).astype(np.int64)
                    which = np.repeat(np.arange(len(element)), times)
                    turn = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    element, doc = mix(element[which] + turn.astype(np.uint64) * _M(0xD1342543DE82EF95)), doc[which]
                bounds = pa.array(np.searchsorted(doc, np.arange(len(part) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([part["doc"], pa.ListArray.from_arrays(bounds, pa.array(element.view(np.int64), pa.int64()))], ["doc", "shingles"])

    return sets


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of each document's shared shingles fall in each of PARTS parts of the hash space."""
    for batch in batches:
        lists = batch["shingles"]
        sizes = np.diff(lists.offsets.to_numpy())
        of = np.repeat(np.arange(len(batch)), sizes)
        cell = of * PARTS + (mix(lists.flatten().to_numpy().view(np.uint64)) % _M(PARTS)).astype(np.int64)
        counts = np.bincount(cell, minlength=len(batch) * PARTS).astype(np.int32)
        bounds = pa.array(np.arange(len(batch) + 1) * PARTS, pa.int32())
        yield pa.RecordBatch.from_arrays([batch["doc"], batch["n"], lists, pa.ListArray.from_arrays(bounds, pa.array(counts))], ["doc", "n", "shingles", "parts"])


def shared_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """(doc, n, shingles, parts): of each set (doc, shingles) its size and what other sets hold of it, too.

    Shingles of one document alone can't be in common, so a set of which less than `similarity` is shared has no link
    and is left out.
    """
    flat = sets.select("doc", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    common = flat.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    kept = flat.join(common.hint("merge"), "g").groupBy("doc", "n").agg(F.collect_list("g").alias("shingles"))
    return kept.where(F.size("shingles") >= similarity * F.col("n") - 1e-9).select("doc", "n", "shingles").mapInArrow(_parts, "doc long, n int, shingles array<long>, parts array<int>")


def _can_link(similarity: float) -> Column:
    """Whether two sets can be similar enough: their shared shingles in each part bound what they have in common."""
    most = F.aggregate(F.zip_with("parts", "rep.parts", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return most * (1 + similarity) >= similarity * (F.col("n") + F.col("rep.n")) - 1e-9


def verified_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose shared_sets() have a Jaccard similarity of at least `similarity`, with it."""
    a = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")).hint("merge")
    b = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")).hint("merge")
    both = F.size(F.array_intersect("sa", "sb"))
    near = pairs.join(a, "a").join(b, "b").select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("similarity"))
    return near.where(F.col("similarity") >= similarity)


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the links among rows with `doc` and `rep`."""
    pairs = pairs.select(F.least("doc", "rep.doc").alias("a"), F.greatest("doc", "rep.doc").alias("b")).distinct()
    return verified_pairs(pairs, sets, similarity).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, bands: int = 24, rows: int = 6, counted: bool = True) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, copy_of, class_id, kept.

    Two documents are linked if the weighted Jaccard similarity of their shingles of `words` words (split at ASCII white
    space, A-Z lower-cased) is at least `similarity`. A shingle weighs 1, and 1 more each time that the number of its
    occurrences doubles, so that repeated lines count but don't drown the rest; unless `counted`, all weigh 1. class_id is the
    smallest doc_id that links reach; kept is doc_id = class_id, one document of each class. copy_of is the smallest
    doc_id with the same words as the row. A document of fewer than `words` words is one shingle. A null or empty text, or one of
    white space alone, is in a class of its own, whatever else its doc_id has; a row with null doc_id has null class_id and is kept. Rows with equal
    doc_id are one document: whatever any of their texts is linked with is in the document's class. An empty table gives no rows; other columns are ignored.

    With 24 bands of 6 coordinates two documents of similarity 0.8 share a bucket with probability 0.9993, of 0.5 in a
    third of cases; every proposal is then verified exactly. Equal texts are merged before signatures are compared.
    A bucket isn't expanded into all its pairs: first the member of which others share the largest part is compared with
    all others. Pairs that links already connect need no comparison, so then only members outside a bucket's largest
    component are compared with those of other components. In both steps what two documents can have in common at most
    is bounded within the join, so that few pairs that aren't links leave it to be compared shingle by shingle.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
    signed = written(base.mapInArrow(_sign(words, bands, rows, counted), "doc_id long, tag long, n_words long, digest binary, bands array<long>"))
    some = signed.where("n_words > 0 and doc_id is not null")
    # A text is a node of its own, since one doc_id may have several texts, and one text several doc_ids.
    texts = some.groupBy("digest").agg(F.min(F.struct("doc_id", "tag")).alias("row"), F.first("bands").alias("bands"))
    texts = written(texts.withColumn("doc", F.monotonically_increasing_id()))
    exploded = written(texts.select("doc", F.explode("bands").alias("key")))
    shared = exploded.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key")
    members = written(exploded.join(shared.hint("merge"), "key"))

    named = texts.select("doc", "digest", F.col("row.doc_id").alias("copy_of"))
    wanted = texts.select("doc", "row.doc_id", "row.tag").join(members.select("doc").distinct().hint("merge"), "doc", "left_semi")
    read = base.join(wanted.hint("merge"), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])
    sets = written(shared_sets(written(read.mapInArrow(_sets(words, counted), "doc long, shingles array<long>")), similarity))

    facts = sets.select("doc", "n", "parts", (F.size("shingles") / F.col("n")).alias("share"))
    state = written(members.join(facts.hint("merge"), "doc").select("key", "doc", "n", "parts", "share"))
    hub = F.max(F.struct("share", (-F.col("doc")).alias("_"), "doc", "n", "parts")).alias("rep")
    hubs = state.groupBy("key").agg(hub, F.count("*").alias("members")).where("members > 1").select("key", "rep")
    links = written(_linked(state.join(hubs.hint("merge"), "key").where((F.col("doc") != F.col("rep.doc")) & _can_link(similarity)), sets, similarity))
    ids = some.select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id")
    ids = some.join(ids.hint("merge"), "doc_id").join(named.hint("merge"), "digest").select("doc_id", "doc").distinct()
    links = written(links.unionAll(ids.withColumn("a", F.min("doc").over(Window.partitionBy("doc_id"))).where("a < doc").select("a", F.col("doc").alias("b"))))
    components = written(connected_components(links))

    of = components.select(F.col("node").alias("doc"), F.col("component").alias("comp"))
    state = written(state.join(of.hint("merge"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc")))
    sizes = state.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).where("comps > 1")
    state = written(state.join(open_.select("key", "main").hint("merge"), "key"))
    reps = state.where("comp <> main").select("key", F.struct("doc", "comp", "n", "parts").alias("rep"))
    more = written(_linked(state.join(reps.hint("merge"), "key").where((F.col("comp") != F.col("rep.comp")) & _can_link(similarity)), sets, similarity))
    if more.limit(1).count():
        components = written(connected_components(links.unionAll(more)))

    classes = named.join(components.select(F.col("node").alias("doc"), "component").hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    classes = classes.join(classes.groupBy("component").agg(F.min("copy_of").alias("class_id")).hint("merge"), "component").select("digest", "copy_of", "class_id")
    out = signed.select("doc_id", "n_words", "digest").join(classes.hint("merge"), "digest", "left")
    one = lambda c: F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_words") > 0, F.col(c)).otherwise(F.col("doc_id")))
    out = out.select("doc_id", one("copy_of").alias("copy_of"), one("class_id").alias("class_id"))
    return out.select("doc_id", "copy_of", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))
