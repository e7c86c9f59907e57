"""Quality by gated-attention multiple-instance learning: a document is a bag of passages, and only bags have labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .labelled import held_out, training_labels
from .textbuf import Words, mix, slices, text_buffer

_M = np.uint64
#: Words of a passage, and labelled rows of each class to learn from.
PASSAGE, PER_CLASS = 64, 1500
#: Classes of bytes whose shares describe a passage.
_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if 65 <= _b < 91 else 2 if 97 <= _b < 123 else 3 if 48 <= _b < 58 else 4 if _c in ".,;:" else 5 if _c in "!?" else 6 if _c in "#$%&*@^~" else 7 if _c in "|<>{}[]\\/_=+" else 8 if _b < 128 and not _c.isspace() else 9 if _b >= 128 else 10 if _c == "\n" else 0
_KINDS = 11
#: Features: shares of kinds of bytes, then what _features() lists, then a signed hash of words.
SKETCH = 16
N_FEATURES = _KINDS + 10 + SKETCH


def _features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages of each text); a text without words has one passage of zeros."""
    w = Words(buf, offs)
    counts, rows, n = w.counts(), w.rows(), len(w)
    passages = np.maximum(1, -(-counts // PASSAGE))
    base = np.cumsum(passages) - passages
    total = int(passages.sum())
    out = np.zeros((total, N_FEATURES))
    if not n:
        return out, passages
    within = np.arange(n) - w.first[rows]
    of = base[rows] + within // PASSAGE
    size = (w.end - w.start).astype(float)
    words = np.bincount(of, minlength=total).astype(float)
    some = np.maximum(words, 1)

    lead = np.flatnonzero(within % PASSAGE == 0)
    last = np.append(lead[1:], n) - 1
    span = w.end[last] - w.start[lead]
    at = np.repeat(w.start[lead], span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
    kinds = np.bincount(np.repeat(of[lead], span) * _KINDS + _KIND[buf[at]], minlength=total * _KINDS).reshape(total, _KINDS)
    out[:, :_KINDS] = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)

    h = w.hashes()
    same = np.zeros(n)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((h, of))
    new = np.ones(n, bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    initial = _KIND[buf[w.start]]
    final = _KIND[buf[w.end - 1]]
    sums = lambda x: np.bincount(of, x, total) / some
    mean = sums(size)
    for i, x in enumerate((mean / 10, np.sqrt(np.maximum(sums(size**2) - mean**2, 0)) / 10, sums(same), np.bincount(of[order][new], minlength=total) / some, sums(initial == 1), sums((initial > 2) & (initial < 9)), sums((final > 4) & (final < 9)), sums(size <= 3), sums(size >= 12), words / PASSAGE)):
        out[:, _KINDS + i] = x
    z = mix(h + _M(77))
    sign = np.where(z >> _M(63), 1.0, -1.0)
    sketch = np.bincount(of * SKETCH + (z % _M(SKETCH)).astype(np.int64), sign, total * SKETCH).reshape(total, SKETCH)
    out[:, -SKETCH:] = sketch / np.sqrt(some)[:, None] * 0.3
    return out, passages


@dataclass
class GatedAttention:
    """p = sigmoid(c . sum_k a_k h_k + b), h = tanh(W x + w0), a = softmax(u . (tanh(V h) * sigmoid(G h)))."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    prior: float = 0.5

    @staticmethod
    def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, first, 0)

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(bags) - bags
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["w0"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        e = (t * g) @ p["u"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), bags))
        a = e / np.repeat(self._sums(e, first), bags)
        z = self._sums(a[:, None] * h, first)
        logit = z @ p["c"] + p["b"]
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "first": first, "score": 1 / (1 + np.exp(-logit.clip(-30, 30)))}

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy of whole bags by each parameter."""
        p, f = self.p, self.forward(x, bags)
        h, t, g, a, first = f["h"], f["t"], f["g"], f["a"], f["first"]
        d_logit = weight * (f["score"] - y)
        d_z = np.repeat(d_logit, bags)[:, None] * p["c"]
        d_a = (d_z * h).sum(1)
        d_e = a * (d_a - np.repeat(self._sums(a * d_a, first), bags))
        d_tg = d_e[:, None] * p["u"]
        d_t, d_g = d_tg * g * (1 - t**2), d_tg * t * g * (1 - g)
        d_h = (d_z * a[:, None] + d_t @ p["V"].T + d_g @ p["G"].T) * (1 - h**2)
        return {"W": f["x"].T @ d_h, "w0": d_h.sum(0), "V": h.T @ d_t, "G": h.T @ d_g, "u": (t * g).T @ d_e, "c": f["z"].T @ d_logit, "b": d_logit.sum(keepdims=True)}

    @classmethod
    def fit(cls, x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 160, rate: float = 0.02, decay: float = 1e-4) -> GatedAttention:
        """Weighted cross-entropy by Adam over the whole sample, from fixed random starts; the gradients are written out."""
        random = np.random.default_rng(7)
        p = {"W": random.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "w0": np.zeros(hidden), "V": random.normal(0, hidden**-0.5, (hidden, gate)), "G": random.normal(0, hidden**-0.5, (hidden, gate)), "u": random.normal(0, 0.3, gate), "c": random.normal(0, 0.3, hidden), "b": np.zeros(1)}
        self = cls(x.mean(0), np.maximum(x.std(0), 1e-3), p, float((weight * y).sum() / weight.sum()))
        weight = weight / weight.sum()
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        for step in range(1, rounds + 1):
            grads = self.gradients(x, bags, y, weight)
            for k, d in grads.items():
                d = d + decay * p[k]
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * d
                v *= 0.999
                v += 0.001 * d * d
                p[k] = p[k] - rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.p = p
        return self


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x, bags = _features(*text_buffer(part["text"]))
            bounds = pa.array(np.concatenate([[0], np.cumsum(bags)]) * N_FEATURES, pa.int32())
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["y"], pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.float32).ravel(), pa.float32()))], ["doc_id", "y", "x"])


def _score(model: GatedAttention):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                x, bags = _features(*text_buffer(part["text"]))
                f = model.forward(x.astype(np.float32), bags)
                empty = ~x.any(1)[f["first"]]
                points = np.where(empty, model.prior, f["score"])
                top = np.maximum.reduceat(f["a"], f["first"])
                focus = np.flatnonzero(f["a"] == np.repeat(top, bags))
                focus = focus[np.searchsorted(focus, f["first"])] - f["first"]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(points, pa.float64()), pa.array(bags, pa.int64()), pa.array(focus, pa.int64()), pa.array(top, pa.float64())], ["doc_id", "score", "n_passages", "top_passage", "top_attention"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, score, predicted, n_passages, top_passage, top_attention.

    Every passage of 64 words of the whole text is encoded; attention weights, learned from document labels alone, tell
    how much each counts, and the score is the probability of label 1 for the weighted passage. It is fitted on at most
    `per_class` labelled rows of each class, weighted to the classes' shares; rows whose id's crc32 leaves 1 when divided
    by 3 are held out. A text without words, so a null or empty one, gets the share of label 1. With no usable label of
    one class every score is that of the other; with none, 0.5. Of several texts of one sampled id the least counts. Repeated rows give repeated results, null ids are kept,
    an empty table gives no rows, other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen, total = training_labels(labels, column, per_class)
    chosen = written(chosen)  # at most 2 x per_class rows, so they may be broadcast
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = sorted(sample.mapInArrow(_passages, "doc_id long, y int, x array<float>").toLocalIterator(), key=lambda r: r.doc_id)
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) == 2:
        bags = np.array([len(r.x) // N_FEATURES for r in rows])
        x = np.concatenate([np.array(r.x, np.float32) for r in rows]).reshape(-1, N_FEATURES)
        weight = np.array([total[k] / (y == k).sum() for k in (0, 1)])[y]
        scored = texts.mapInArrow(_score(GatedAttention.fit(x, bags, y, weight)), "doc_id long, score double, n_passages long, top_passage long, top_attention double")
    else:
        scored = texts.select("doc_id", F.lit(float(y[0]) if len(y) else 0.5).alias("score"), *[F.lit(None).cast(t).alias(c) for c, t in (("n_passages", "long"), ("top_passage", "long"), ("top_attention", "double"))])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "top_passage", "top_attention")
