"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and distance-weighted votes.

Terms are all words of the labelled rows that are sampled. A term's weight is its TF-IDF times what the sample's labels say
of it: a smooth function of its likelihood ratio between the classes, never 0 (supervised term weighting). With plain
TF-IDF a few telling words are lost among hundreds of rare ones, and neighbours are those of the same topic.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .labelled import held_out, training_labels
from .textbuf import Words, slices, text_buffer

_M = np.uint64
_LETTERS = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalpha():
        _LETTERS[_b] = 0x20
#: Bound of what is learned: labelled rows of each class.
PER_CLASS = 3000
#: The likelihood ratio at which a term weighs half, how fast that changes, and the weight of terms that tell nothing.
EVIDENCE, SLOPE, FLOOR = 30.0, 5.0, 0.02
BLOCK, NEIGHBOURS = 64, 25
#: Share of examples beyond which a term is a dense column, and blocks that a query visits first.
COMMON, FIRST = 0.1, 4
#: Cosines closer than this count as equal.
TIE = 1e-9
#: Counts of terms that are sent in one row.
PIECE = 65_536


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, times, hashes): each text's words, once each with their count; places are into sorted hashes."""
    buf, offs = text_buffer(pc.utf8_lower(pc.fill_null(column, "")))
    buf[:-8] = _LETTERS[buf[:-8]]
    w = Words(buf, offs)
    hashes, at = np.unique(w.hashes(), return_inverse=True)
    cell, times = np.unique(w.rows() * max(1, len(hashes)) + at, return_counts=True)
    return cell // max(1, len(hashes)), cell % max(1, len(hashes)), times, hashes


def _find(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted vocabulary, -1 where missing."""
    at = np.searchsorted(vocabulary, hashes)
    return np.where(np.append(vocabulary, _M(0))[at] == hashes, at, -1) if len(vocabulary) else np.full(len(hashes), -1)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, terms, times): all terms of each sampled row."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows, places, times, hashes = _cells(part["text"])
            bounds = pa.array(np.searchsorted(rows, np.arange(len(part) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(hashes[places].view(np.int64), pa.int64()), pa.array(times.astype(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["y"], *lists], ["doc_id", "y", "terms", "times"])


def _pieces(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for piece in range(0, len(counts), PIECE):
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([counts[piece : piece + PIECE].tobytes()], pa.binary())], ["piece", "counts"])


def _frequencies(vocabulary: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one task's texts, how many have each term of the vocabulary, and last how many there are."""
        counts = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            counts[-1] += len(batch)
            for part in slices(batch, "text"):
                _, places, _, hashes = _cells(part["text"])
                at = _find(vocabulary, hashes)
                np.add.at(counts, at[at >= 0], np.bincount(places, minlength=len(hashes))[at >= 0])
        if counts[-1]:
            yield from _pieces(counts)

    return count


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of equal pieces, added as they come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch["piece"].to_pylist(), batch["counts"]):
            counts = np.frombuffer(counts.as_buffer(), np.int64)
            sums[piece] = sums[piece] + counts if piece in sums else counts
    for piece, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["piece", "counts"])


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places in ranges."""
    which = np.repeat(np.arange(len(start)), size)
    return which, np.arange(len(which)) + np.repeat(start - np.cumsum(size) + size, size)


@dataclass
class Rows:
    """Sparse rows: each has its terms (ascending) and weights between two bounds."""

    bounds: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    width: int

    @classmethod
    def of(cls, x: np.ndarray | Rows) -> Rows:
        if isinstance(x, Rows):
            return x
        rows, terms = np.nonzero(x)
        return cls(np.searchsorted(rows, np.arange(len(x) + 1)), terms, x[rows, terms], x.shape[1])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.bounds)[rows]
        _, at = _spread(self.bounds[rows], size)
        return Rows(np.concatenate([[0], np.cumsum(size)]), self.terms[at], self.weights[at], self.width)

    def order(self, ids: np.ndarray) -> np.ndarray:
        """By heaviest term, so that like rows share blocks."""
        row = np.repeat(np.arange(len(self)), np.diff(self.bounds))
        down = np.lexsort((self.terms, -self.weights, row))
        some = np.diff(self.bounds) > 0
        heavy, weight = np.full(len(self), -1), np.zeros(len(self))
        heavy[some], weight[some] = self.terms[down[self.bounds[:-1][some]]], self.weights[down[self.bounds[:-1][some]]]
        return np.lexsort((ids, -weight, heavy))


def _unit(rows: np.ndarray, terms: np.ndarray, times: np.ndarray, weight: np.ndarray, n: int, other: np.ndarray | float = 0.0) -> Rows:
    """Rows of unit length; `other` adds to squared lengths."""
    weights = (1 + np.log(times)) * weight[terms]
    norm = np.sqrt(np.bincount(rows, weights**2, n) + other)
    return Rows(np.searchsorted(rows, np.arange(n + 1)), terms, weights / norm[rows], len(weight))


def _nearest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, cosines) of each row's k largest; -1 and 0 where fewer are above 0."""
    k = min(k, scores.shape[1])
    near = np.argpartition(-scores, k - 1, 1)[:, :k]
    near = np.take_along_axis(near, np.lexsort((near, -np.take_along_axis(scores, near, 1)), axis=1), 1)
    cosine = np.take_along_axis(scores, near, 1)
    return np.where(cosine > 0, near, -1), cosine.clip(0)


@dataclass
class BlockMaxIndex:
    """Postings of unit vectors in blocks of examples, with each term's largest weight in each block.

    Terms that many examples have are kept as dense columns, and their part of a bound is exact. Of others, `first` gives
    each term's blocks, `start` each block's postings, `maxima` its largest weight.
    """

    ids: np.ndarray
    labels: np.ndarray
    own: np.ndarray
    column: np.ndarray
    dense: np.ndarray
    first: np.ndarray
    start: np.ndarray
    maxima: np.ndarray
    example: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray | Rows) -> BlockMaxIndex:
        vectors = Rows.of(vectors)
        order = vectors.order(ids)
        own = np.empty(len(ids), np.int64)
        own[order] = np.arange(len(ids))
        vectors = vectors.take(order)
        row = np.repeat(np.arange(len(ids)), np.diff(vectors.bounds))
        many = np.flatnonzero(np.bincount(vectors.terms, minlength=vectors.width) > max(COMMON * len(ids), 8))
        column = np.full(vectors.width, -1, np.int32)
        column[many] = np.arange(len(many))
        common = column[vectors.terms] >= 0
        dense = np.zeros((len(many), len(ids)))
        dense[column[vectors.terms[common]], row[common]] = vectors.weights[common]
        row, term, weight = row[~common], vectors.terms[~common].astype(np.int64), vectors.weights[~common]
        by = np.argsort(term, kind="stable")  # rows stay ascending
        row, term, weight = row[by], term[by], weight[by]
        new = np.ones(len(row), bool)
        new[1:] = (term[1:] != term[:-1]) | (row[1:] // BLOCK != row[:-1] // BLOCK)
        start = np.flatnonzero(new)
        maxima = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0)
        first = np.searchsorted(term[start], np.arange(vectors.width + 1)).astype(np.int32)
        return cls(ids[order], labels[order], own, column, dense, first, np.append(start, len(row)).astype(np.int32), maxima, row.astype(np.int32), weight)

    def places(self, ids: pa.Array) -> np.ndarray:
        """Where examples of these ids are, -1 for others and for null."""
        order = np.argsort(self.ids, kind="stable")
        at = np.minimum(np.searchsorted(self.ids[order], ids.fill_null(0).to_numpy()), max(0, len(order) - 1))
        found = (self.ids[order[at]] == ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
        return np.where(found, order[at], -1)

    def cosines(self, queries: Rows, k: int, own: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """(queries x examples), some queries at a time: exact for the k nearest of each and all that tie with them.

        No other is above its exact value. A query's own example, if it has one, is far below 0. Blocks with the
        largest bounds on the cosines in them are visited first; then those others whose bound reaches the query's
        k-th cosine by then.
        """
        own = np.full(len(queries), -1) if own is None else own
        work = np.concatenate([[0], np.cumsum(np.diff(self.first)[queries.terms])])[queries.bounds]
        at = 0
        while at < len(queries):
            to = max(at + 1, min(at + 128, int(np.searchsorted(work, work[at] + (1 << 18), "right")) - 1))
            yield self._visit(queries.take(np.arange(at, to)), k, own[at:to])
            at = to

    def search(self, queries: np.ndarray | Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples of each unit query by exact cosine; -1 and 0 where fewer share a term."""
        place, cosine = (np.concatenate(x) for x in zip(*[_nearest(scores, k) for scores in self.cosines(Rows.of(queries), k)]))
        return place, cosine

    def _visit(self, queries: Rows, k: int, own: np.ndarray) -> np.ndarray:
        n, size = len(queries), len(self.ids)
        blocks = -(-size // BLOCK)
        row = np.repeat(np.arange(n), np.diff(queries.bounds))
        column = self.column[queries.terms]
        x = np.zeros((n, len(self.dense)))
        x[row[column >= 0], column[column >= 0]] = queries.weights[column >= 0]
        scores = x @ self.dense  # exact over common terms, so never more than the cosine
        scores[np.flatnonzero(own >= 0), own[own >= 0]] = -10
        bound = np.maximum.reduceat(scores, np.arange(0, size, BLOCK), axis=1)
        row, term, weight = row[column < 0], queries.terms[column < 0], queries.weights[column < 0]
        which, entry = _spread(self.first[term], self.first[term + 1] - self.first[term])
        cell = row[which] * blocks + self.example[self.start[entry]] // BLOCK
        which_weight = weight[which]
        bound += np.bincount(cell, which_weight * self.maxima[entry], n * blocks).reshape(n, blocks)
        k = min(k, size)
        top = np.zeros(bound.shape, bool)
        np.put_along_axis(top, np.argsort(-bound, 1, kind="stable")[:, :FIRST], True, 1)
        flat = scores.reshape(-1)
        for live in (top, ~top):
            least = np.partition(scores, size - k, 1)[:, size - k, None]
            go = np.flatnonzero((live & (bound >= least - TIE)).ravel()[cell])
            of, posting = _spread(self.start[entry[go]], self.start[entry[go] + 1] - self.start[entry[go]])
            go = go[of]
            flat += np.bincount(row[which[go]] * size + self.example[posting], which_weight[go] * self.weight[posting], n * size)
        return scores


def _packed(bounds: np.ndarray, terms: np.ndarray, times: np.ndarray, weight: np.ndarray):
    """A function that gives the examples' vectors where it is called; only their packed counts travel."""
    size = np.diff(bounds)
    steps = np.diff(terms, prepend=terms[:1]).astype(np.int32)
    steps[bounds[:-1][size > 0]] = terms[bounds[:-1][size > 0]]
    packed = [zlib.compress(x.astype(np.int32).tobytes(), 1) for x in (steps, times)]

    def vectors() -> Rows:
        steps, times = (np.frombuffer(zlib.decompress(x), np.int32) for x in packed)
        sums = np.cumsum(steps, dtype=np.int64)
        terms = (sums - np.repeat(np.append(0, sums)[bounds[:-1]], size)).astype(np.int32)
        return _unit(np.repeat(np.arange(len(size), dtype=np.int32), size), terms, times, weight, len(size))

    return vectors


#: The voter that this process has indexed, by its key.
_VOTERS: dict[str, Voter] = {}


@dataclass
class Voter:
    """Neighbours' votes, each weighted by closeness and by how many labelled rows its class's sample stands for."""

    index: BlockMaxIndex
    share: np.ndarray
    prior: float
    theta: np.ndarray

    @classmethod
    def fit(cls, ids: np.ndarray, y: np.ndarray, vectors: Rows, total: dict[int, int]) -> Voter:
        """Calibrated by logistic regression on the vote that each example gets from the others."""
        share = np.array([total.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])
        weight = share[y]
        self = cls(BlockMaxIndex.build(ids, y, vectors), share, float((weight * y).sum() / weight.sum()), np.array([1.0, 0.0]))
        votes = np.concatenate([self._votes(scores) for scores in self.index.cosines(vectors, NEIGHBOURS, self.index.own)])
        n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
        goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        design, theta, start = self._design(votes), self.theta, self.theta
        for _ in range(40):
            p = 1 / (1 + np.exp(-(design @ theta).clip(-30, 30)))
            hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-2
            theta = theta - np.linalg.solve(hessian, design.T @ (weight * (p - goal)) + 1e-2 * (theta - start))
        if np.isfinite(theta).all() and theta[0] > 0:
            self.theta = theta
        return self

    @staticmethod
    def _design(vote: np.ndarray) -> np.ndarray:
        return np.stack([np.log(vote / (1 - vote)), np.ones(len(vote))], 1)

    def _votes(self, scores: np.ndarray) -> np.ndarray:
        """Of each query's nearest examples; those that tie for the last places share them."""
        size = scores.shape[1]
        k = min(NEIGHBOURS, size)
        last = np.partition(scores, size - k, 1)[:, size - k, None]
        above, tied = scores > last + TIE, np.abs(scores - last) <= TIE
        place = above + tied * ((k - above.sum(1)) / tied.sum(1))[:, None]
        near = np.where(scores > 0, scores / (1.05 - np.minimum(scores, 1)), 0) * place * self.share[self.index.labels]
        prior = 0.1 * self.share.mean()  # far neighbours weigh less than none
        return ((near @ self.index.labels + prior * self.prior) / (near.sum(1) + prior)).clip(1e-6, 1 - 1e-6)

    def score(self, vectors: Rows, ids: pa.Array, evidence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, places and cosines of the nearest examples); a row isn't its own example."""
        found = [(self._votes(scores), *_nearest(scores, evidence)) for scores in self.index.cosines(vectors, NEIGHBOURS, self.index.places(ids))]
        vote, place, cosine = (np.concatenate(x) for x in zip(*found))
        return 1 / (1 + np.exp(-(self._design(vote) @ self.theta).clip(-30, 30))), place, cosine


def _fitted(ids: np.ndarray, y: np.ndarray, vectors, total: dict[int, int]):
    """The voter's numbers, learned in one task from the sample, which is bounded; not on the driver, for its memory."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                voter = Voter.fit(ids, y, vectors(), total)
                yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64())) for x in (voter.share, np.array([voter.prior]), voter.theta)], ["share", "prior", "theta"])

    return fit


def _voter(ids: np.ndarray, y: np.ndarray, vectors, share: list[float], prior: float, theta: list[float]):
    """A function that gives the voter; a worker indexes the examples once."""
    key = uuid.uuid4().hex

    def voter() -> Voter:
        if key not in _VOTERS:
            _VOTERS.clear()
            _VOTERS[key] = Voter(BlockMaxIndex.build(ids, y, vectors()), np.array(share), prior, np.array(theta))
        return _VOTERS[key]

    return voter


def _score(voter_of, vocabulary: np.ndarray, weight: np.ndarray, unseen: float, evidence: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = voter_of()
        for batch in batches:
            for part in slices(batch, "text"):
                rows, places, times, hashes = _cells(part["text"])
                terms = _find(vocabulary, hashes)[places]
                known = terms >= 0
                other = np.bincount(rows[~known], ((1 + np.log(times[~known])) * unseen) ** 2, len(part))
                points, place, cosine = voter.score(_unit(rows[known], terms[known], times[known], weight, len(part), other), part["doc_id"], evidence)
                shown = place >= 0
                bounds = pa.array(np.concatenate([[0], np.cumsum(shown.sum(1))]), pa.int32())
                which = place[shown]
                fields = [pa.array(voter.index.ids[which], pa.int64()), pa.array(voter.index.labels[which].astype(np.int32), pa.int32()), pa.array(cosine[shown], pa.float64())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(points, pa.float64()), pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, ["doc_id", "label", "cosine"]))], ["doc_id", "score", "evidence"])

    return score


def relevance(n0: np.ndarray, n1: np.ndarray, m0: int, m1: int) -> np.ndarray:
    """How much terms tell two classes of m0 and m1 rows apart of which n0 and n1 have them: FLOOR to 1 + FLOOR."""

    def part(k, m):
        p = k / max(m, 1)
        entropy = lambda q: q * np.log(np.where(q > 0, q, 1))
        return (entropy(p) + entropy(1 - p)) * m

    ratio = 2 * (part(n0, m0) + part(n1, m1) - part(n0 + n1, m0 + m1))
    return FLOOR + 1 / (1 + np.exp(((EVIDENCE - ratio) / SLOPE).clip(-30, 30)))


def score_toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = 0.7, per_class: int = PER_CLASS, evidence: int = 5) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, score, predicted, evidence (doc_id, label, cosine of the nearest).

    Terms are words (runs of letters, lower-cased). Those of at most `per_class` labelled rows of each class are all
    kept, with their document frequencies over all of `docs` and the sample's relevance(); a text's other terms add to
    its length as if it alone had them. Rows whose id's crc32 leaves 1 when divided by 3 are held out from all learning.
    The score is the calibrated, distance-weighted vote of the 25 sampled rows nearest by exact cosine of these weights;
    rows that tie for the last places share them, and a sampled row is not its own neighbour. A text that shares no term
    with any sampled row, so a null or empty one too, has no votes and no evidence and gets the calibrated prior. With no
    usable label of one class every score is that of the other; with none, 0.5. Of several texts of one sampled id the
    least counts. Repeated rows give repeated results, null ids are kept, an empty table gives no rows, other columns are
    ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen, total = training_labels(labels, column, per_class)
    chosen = written(chosen)  # at most 2 x per_class rows, so they may be broadcast
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    seen = sample.mapInArrow(_examples, "doc_id long, y int, terms array<long>, times array<int>").toArrow().sort_by("doc_id").combine_chunks()
    classes = set(seen["y"].to_pylist())
    if len(classes) == 2:
        ids, y = seen["doc_id"].to_numpy(), seen["y"].to_numpy()
        bounds = np.append(0, np.cumsum(pc.list_value_length(seen["terms"]).to_numpy()))
        rows = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(bounds))
        times = pc.list_flatten(seen["times"]).to_numpy()
        vocabulary, at = np.unique(pc.list_flatten(seen["terms"]).to_numpy().view(np.uint64), return_inverse=True)
        del seen
        at = at.astype(np.int32)  # hashes ascend within each example, so places do
        told = relevance(*[np.bincount(at[y[rows] == k], minlength=len(vocabulary)) for k in (0, 1)], int((y == 0).sum()), int((y == 1).sum()))
        del rows
        sums = np.zeros(len(vocabulary) + 1, np.int64)
        added = texts.select("text").mapInArrow(_frequencies(vocabulary), "piece long, counts binary").repartition("piece").mapInArrow(_added, "piece long, counts binary")
        for r in added.collect():  # one row for each piece
            part = np.frombuffer(r.counts, np.int64)
            sums[r.piece : r.piece + len(part)] += part
        idf = lambda n: np.log((1 + sums[-1]) / (1 + n)) + 1
        weight = idf(sums[:-1]) * told
        vectors = _packed(bounds, at, times, weight)
        fitted = docs.sparkSession.range(0, 1, 1, 1).mapInArrow(_fitted(ids, y, vectors, total), "share array<double>, prior array<double>, theta array<double>").first()
        voter = _voter(ids, y, vectors, fitted.share, fitted.prior[0], fitted.theta)
        unseen = float(idf(1) * relevance(np.zeros(1), np.zeros(1), 1, 1)[0])
        out = texts.mapInArrow(_score(voter, vocabulary, weight, unseen, evidence), "doc_id long, score double, evidence array<struct<doc_id:long,label:int,cosine:double>>")
    else:
        only = float(classes.pop()) if classes else 0.5
        out = texts.select("doc_id", F.lit(only).alias("score"), F.lit(None).cast("array<struct<doc_id:long,label:int,cosine:double>>").alias("evidence"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
