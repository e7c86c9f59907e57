"""Substring dedup: word windows that another, earlier document already holds are cut out.

Prefix-partitioned suffix trees. Only suffixes of at least `min_words` words matter, down to that depth. They are
dealt out by a prefix that any two equal suffixes share: the least hashed word 8-gram among a suffix's first
`min_words` words. About one such prefix in 22 words is new, so one short text serves a run of suffixes, and prefixes
that only one document holds are dropped by exact counting: their subtrees can't branch between documents. Prefixes are
of variable length: the runs of a group of more than `max_suffixes` suffixes are dealt anew by the least hashed 24-gram
of each suffix. A group that fits gets a subtree in one task, from the top: the nodes of depth d are split into
those of depth 2d by prefix doubling. A node `min_words` deep whose smallest document differs from a suffix's own marks
that suffix, and marked neighbours merge into maximal repeats. What is too large under either prefix gets all `min_words`
words as its prefix: each is such a node by itself, has one row for each run that holds it, however often, and Spark's
partial aggregation finds its smallest document without bringing the group together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textbuf import Words, grams, slices, sliding_min, text_buffer

#: Words of the prefixes that suffixes are dealt by, each for what the one before leaves too large.
PREFIXES = (8, 24)


def _windows(w: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, row) of each suffix of `min_words` words in one document."""
    rows = w.rows()
    at = np.flatnonzero(rows[: max(0, len(rows) - min_words + 1)] == rows[min_words - 1 :])
    return at, rows[at]


def _anchors(h: np.ndarray, at: np.ndarray, words: int, min_words: int) -> np.ndarray:
    """The group of each suffix: its least hashed gram of so many words. Groups of different lengths are kept apart."""
    if not len(at):
        return np.zeros(0, np.int64)
    return sliding_min(grams(h + np.uint64(words), words), min_words - words + 1)[at].view(np.int64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values starts."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _counted(rows: int, row: np.ndarray, group: np.ndarray) -> pa.Array:
    """Each row's groups with the suffixes it has in them."""
    df = pd.DataFrame({"row": row, "group": group}).groupby(["row", "group"], sort=True).size()
    bounds = pa.array(np.searchsorted(df.index.get_level_values(0).to_numpy(), np.arange(rows + 1)), pa.int32())
    groups = [pa.array(df.index.get_level_values(1).to_numpy(), pa.int64()), pa.array(df.to_numpy(), pa.int64())]
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(groups, ["anchor", "n"]))


def _scan(min_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = text_buffer(part["text"])
                w = Words(buf, offs)
                raw, digests = buf.tobytes(), []
                for a, b in zip(offs[:-1], offs[1:]):
                    digests.append(hashlib.sha256(b" ".join(raw[a:b].split())).digest())
                at, row = _windows(w, min_words)
                anchors = _counted(len(part), row, _anchors(w.hashes(), at, PREFIXES[0], min_words))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["tag"], pa.array(w.counts(), pa.int64()), pa.array(digests, pa.binary()), anchors], ["doc_id", "tag", "n_words", "sha", "anchors"])

    return scan


_RUN = {"anchor": pa.int64(), "doc_id": pa.int64(), "tag": pa.int64(), "start": pa.int64(), "n": pa.int64(), "words": pa.binary()}
RUNS = "anchor long, doc_id long, tag long, start long, n long, words binary"


def _run_rows(part: pa.RecordBatch, first: np.ndarray, buf: np.ndarray, w: Words, at: np.ndarray, row: np.ndarray, group: np.ndarray, min_words: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """(where runs of suffixes of one group begin, the runs with their words); row r's words start at word first[r] of its text."""
    begin = _runs(group, row, at - np.arange(len(at)))
    size = np.diff(np.append(begin, len(at)))
    p, r, raw = at[begin], row[begin], buf.tobytes()
    texts = [raw[a:b] for a, b in zip(w.start[p], w.end[p + size + min_words - 2])]
    doc, tag = (part[c].take(pa.array(r)) for c in ("doc_id", "tag"))
    cols = [group[begin], doc, tag, first[r] + p - w.first[r], size, texts]
    return begin, pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(cols, _RUN.values())], list(_RUN))


def _emit(min_words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of the texts' suffixes in the groups listed, and whether the group is too large."""
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = text_buffer(part["text"])
                w = Words(buf, offs)
                at, row = _windows(w, min_words)
                group = _anchors(w.hashes(), at, PREFIXES[0], min_words)
                wanted = part["groups"]
                which = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
                anchors, large = (wanted.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                found = pd.MultiIndex.from_arrays([which, anchors]).get_indexer(pd.MultiIndex.from_arrays([row, group]))
                at, row, group, found = (x[found >= 0] for x in (at, row, group, found))
                begin, out = _run_rows(part, np.zeros(len(part), np.int64), buf, w, at, row, group, min_words)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(large[found[begin]].astype(bool), pa.bool_())], [*_RUN, "large"])

    return emit


def _split(words: int, min_words: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs, dealt anew by prefixes of so many words."""
        for batch in batches:
            for part in slices(batch, "words"):
                buf, offs = text_buffer(part["words"])
                w = Words(buf, offs)
                at, row = _windows(w, min_words)
                yield _run_rows(part, part["start"].to_numpy(), buf, w, at, row, _anchors(w.hashes(), at, words, min_words), min_words)[1]

    return split


def _whole(min_words: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different suffixes of each run, each a prefix of its own, with the places where they start."""
        for batch in batches:
            for part in slices(batch, "words"):
                buf, offs = text_buffer(part["words"])
                w = Words(buf, offs)
                at, row = _windows(w, min_words)
                first, second = (grams(x.hashes(), min_words)[at] for x in (w, Words(buf, offs, seed=1)))
                order = np.lexsort((at, second, first, row))
                at, row, first, second = at[order], row[order], first[order], second[order]
                begin = _runs(row, first, second)
                starts = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)), pa.int32()), pa.array(part["start"].to_numpy()[row] + at - w.first[row], pa.int64()))
                doc, tag = (part[c].take(pa.array(row[begin])) for c in ("doc_id", "tag"))
                yield pa.RecordBatch.from_arrays([pa.array(first[begin].view(np.int64)), pa.array(second[begin].view(np.int64)), doc, tag, starts], ["anchor", "second", "doc_id", "tag", "starts"])

    return whole


def _deep_nodes(rows: pd.DataFrame, min_words: int) -> pd.DataFrame:
    """Maximal repeats of whole prefix groups: runs of suffixes below a deep node that an earlier document reaches."""
    words = b"\n".join(rows["words"]).split()
    name = pd.factorize(np.array(words, object))[0].astype(np.int64)
    depth = 1
    while depth < min_words:  # names of twice as many words from pairs of names
        step = min(depth, min_words - depth)
        pairs = name[: len(name) - step] * (name.max() + 1) + name[step:]
        name, depth = pd.factorize(pairs)[0].astype(np.int64), depth + step
    n = rows["n"].to_numpy()
    first_word = np.concatenate([[0], np.cumsum(n + min_words - 1)[:-1]])
    chunk = np.repeat(np.arange(len(rows)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    node, doc = name[first_word[chunk] + within], rows["doc_id"].to_numpy()[chunk]
    least = np.full(node.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc)
    hit = np.flatnonzero(least[node] < doc)
    begin = _runs(chunk[hit], hit - np.arange(len(hit)))
    size = np.diff(np.append(begin, len(hit)))
    hit = hit[begin]
    own = rows.iloc[chunk[hit]]
    return pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "tag": own["tag"].to_numpy(), "start": own["start"].to_numpy() + within[hit], "n": size})


def _in_parts(rows: pd.DataFrame, min_words: int, words_at_once: int) -> Iterator[pd.DataFrame]:
    """Deep nodes of some whole groups at a time."""
    group = (rows["anchor"] != rows["anchor"].shift()).cumsum().to_numpy()
    size = np.cumsum((rows["n"] + min_words - 1).to_numpy())
    before = np.concatenate([[0], size[np.flatnonzero(np.diff(group))]])[group - 1]  # words of the groups before
    for _, part in rows.groupby(before // words_at_once, sort=False):
        yield _deep_nodes(part, min_words)


def _subtrees(min_words: int, words_at_once: int = 400_000):
    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames are sorted by group; a group is worked on once its last row has come."""
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            held.append(frame)
            size += int((frame["n"] + min_words - 1).sum())
            if size >= words_at_once:
                rows = pd.concat(held, ignore_index=True)
                whole = (rows["anchor"] != rows["anchor"].iloc[-1]).to_numpy()
                groups = np.flatnonzero(whole)
                if len(groups):
                    yield from _in_parts(rows.iloc[groups], min_words, words_at_once)
                held = [rows[~whole]]
                size = int((held[0]["n"] + min_words - 1).sum())
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(rows):
            yield from _in_parts(rows, min_words, words_at_once)

    return build


def _cut(min_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, repeats in zip(batch["text"].to_pylist(), batch["repeats"].to_pylist()):
                words = text.encode().split(None) if text else []
                delta = np.zeros(len(words) + 1, np.int64)
                for r in repeats:
                    starts = np.array(r["starts"])
                    np.add.at(delta, starts, 1)
                    np.add.at(delta, starts + r["n"] + min_words - 1, -1)
                gone = np.cumsum(delta[:-1]) > 0
                kept = b" ".join([x for x, g in zip(words, gone.tolist()) if not g])
                out.append((int(gone.sum()), hashlib.sha256(kept).digest(), kept.decode()))
            gone, sha, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tag"], pa.array(gone, pa.int64()), pa.array(sha, pa.binary()), pa.array(kept, pa.string())], ["doc_id", "tag", "removed", "kept_sha", "kept_text"])

    return cut


def _shared(groups: DataFrame, max_suffixes: int) -> DataFrame:
    """(anchor, large) of groups that more than one document has."""
    found = groups.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("n")).where("lo < hi")
    return found.select("anchor", (F.col("n") > max_suffixes).alias("large"))


def dedup_substrings(docs: DataFrame, min_words: int = 50, max_suffixes: int = 16_384, with_text: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and kept_text if `with_text`.

    Words are runs of bytes other than space and \\t \\n \\v \\f \\r. A word goes if a window of `min_words` words that
    covers it also starts in a document with a smaller doc_id; windows are judged on the input. Null and empty texts
    have no words; texts shorter than a window keep all. Rows with equal doc_id are the same document and never cut
    each other; a null doc_id is no smaller than any, and its row keeps all its words. Repeated rows give repeated
    results. An empty table gives no rows. Other columns are ignored.

    Equal word sequences are settled by the smallest doc_id among them before any suffix is made, so copies cost
    nothing. kept_text is null where nothing was removed. A window must be longer than the longest of PREFIXES.
    """
    if min_words <= PREFIXES[-1]:
        raise ValueError(f"windows of {min_words} words; {PREFIXES[-1] + 1} are the least")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
    seen = written(base.mapInArrow(_scan(min_words), "doc_id long, tag long, n_words long, sha binary, anchors array<struct<anchor:long,n:long>>"))
    first = seen.groupBy("sha").agg(F.min("doc_id").alias("first"))
    known = seen.join(first.hint("merge"), "sha")

    anchors = known.where("doc_id = first").select("doc_id", "tag", F.explode("anchors").alias("a")).select("doc_id", "tag", "a.*")
    wanted = anchors.join(_shared(anchors, max_suffixes).hint("merge"), "anchor").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "large")).alias("groups"))
    runs = written(base.join(wanted.hint("merge"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "groups").mapInArrow(_emit(min_words), RUNS + ", large boolean"))

    fits, large = runs.where("not large").drop("large"), runs.where("large")
    for words in PREFIXES[1:]:
        if large.limit(1).count():
            parts = written(large.select(*_RUN).mapInArrow(_split(words, min_words), RUNS))
            parts = written(parts.join(_shared(parts, max_suffixes).hint("merge"), "anchor").select(*_RUN, "large"))
            fits, large = fits.unionByName(parts.where("not large").drop("large")), parts.where("large")
    trees = fits.repartition("anchor").sortWithinPartitions("anchor")
    repeats = trees.mapInPandas(_subtrees(min_words), "doc_id long, tag long, start long, n long").select("doc_id", "tag", F.array("start").alias("starts"), "n")
    if large.limit(1).count():
        deep = written(large.select(*_RUN).mapInArrow(_whole(min_words), "anchor long, second long, doc_id long, tag long, starts array<long>"))
        nodes = deep.groupBy("anchor", "second").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
        repeats = repeats.unionAll(deep.join(nodes.hint("merge"), ["anchor", "second"]).where("lo < doc_id").select("doc_id", "tag", "starts", F.lit(1).cast("long")))
    repeats = repeats.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("starts", "n")).alias("repeats"))

    cut = base.join(repeats.hint("merge"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "repeats").mapInArrow(_cut(min_words), "doc_id long, tag long, removed long, kept_sha binary, kept_text string")
    cut = cut.dropDuplicates(["doc_id", "tag"]) if with_text else cut.select("doc_id", "tag", "removed", "kept_sha").distinct()
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= min_words)
    out = known.select("doc_id", "tag", "n_words", "sha", "first").join(cut.hint("merge"), ["doc_id", "tag"], "left")
    copied = F.coalesce(copy, F.lit(False))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copied, F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))).otherwise(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        *([F.when(copied, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"), "tag"] if with_text else []),
    )
