"""Benchmark decontamination by the q-gram lemma: few shared q-grams in a diagonal band rule a region out, the rest is aligned."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import mix, slices, text_buffer

_M = np.uint64
#: Code points that are compared in another form: capitals with one small letter as small, white space as a space.
_FOLD = np.arange(0x600, dtype=np.uint32)
for _c in range(0x600):
    if chr(_c).isspace():
        _FOLD[_c] = 0x20
    elif len(chr(_c).lower()) == 1:
        _FOLD[_c] = ord(chr(_c).lower())
#: Characters of benchmark items that are sent to the executors at once; more items take further passes.
BLOCK_CHARS = 8 << 20
#: Characters of items, times candidates, that are aligned at once.
PART_CELLS = 4 << 20


def folded(codes: np.ndarray) -> np.ndarray:
    small = codes < len(_FOLD)
    return np.where(small, _FOLD[np.where(small, codes, 0)], codes)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    h, have, base = codes.astype(np.uint64) + _M(1), 1, 0x9E3779B97F4A7C15
    while have < q:
        step = min(have, q - have)
        h = h[: len(h) - step] * _M(pow(base, step, 1 << 64)) + h[step:]
        have += step
    return h


@dataclass
class ItemIndex:
    """q-grams of the items of one block: where each comes, and what the lemma asks of each item."""

    q: int
    ids: list[int]
    codes: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    shift: int

    @classmethod
    def build(cls, rows: list[tuple[int, str]], q: int, rate: float) -> ItemIndex:
        """Grams that many items share are left out where an item's bound can spare them; the bound falls by as many."""
        ids = [i for i, _ in rows]
        codes = [folded(np.frombuffer(t.encode("utf-32-le"), "<u4")) for _, t in rows]
        n = np.array([len(c) for c in codes])
        edits = np.minimum((n * rate).astype(np.int64), (n - q) // q)
        bound = n + 1 - q - q * edits
        hashes = [mix(_grams(c, q)) for c in codes]
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(codes)), [len(h) for h in hashes])
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        grams, at, times = np.unique(flat[order], return_index=True, return_counts=True)
        spare, dropped = bound - np.maximum(2, bound // 2), set()
        common = np.flatnonzero(times >= 3)
        for g in common[np.lexsort((grams[common], -times[common]))].tolist():
            need = Counter(item[order[at[g] : at[g] + times[g]]].tolist())
            if all(spare[i] >= k for i, k in need.items()):
                dropped.add(int(grams[g]))
                for i, k in need.items():
                    spare[i] -= k
                    bound[i] -= k
        use = ~np.isin(flat, np.array(sorted(dropped), np.uint64))
        order = np.argsort(flat[use], kind="stable")
        flat, item, place = flat[use][order], item[use][order], place[use][order]
        keys, first = np.unique(flat, return_index=True)
        bits = max(16, min(26, int(np.ceil(np.log2(len(keys) + 1))) + 6))
        bitmap = np.zeros(1 << bits, bool)
        bitmap[(keys >> _M(64 - bits)).astype(np.int64)] = True
        return cls(q, ids, codes, edits, bound, keys, np.append(first, len(flat)), item, place, bitmap, 64 - bits)

    def regions(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first diagonal) of the bands that share enough q-grams; bounds are the texts' places in codes."""
        none = np.zeros(0, np.int64)
        if len(codes) < self.q or not len(self.keys):
            return none, none, none
        h = mix(_grams(codes, self.q))
        at = np.flatnonzero(self.bitmap[(h >> _M(self.shift)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[at])
        hit = self.keys[np.minimum(key, len(self.keys) - 1)] == h[at]
        text = np.searchsorted(bounds, at, "right") - 1
        hit &= at + self.q <= bounds[text + 1]
        at, key, text = at[hit], key[hit], text[hit]
        n = self.first[key + 1] - self.first[key]
        post = np.repeat(self.first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        diagonal = np.repeat(at - bounds[text], n) - self.place[post]
        text, item = np.repeat(text, n), self.item[post]
        step = self.edits[item] + 1
        band = diagonal // step + 1  # a band spans two steps of diagonals, so that any `edits` neighbours lie in one
        longest = max(map(len, self.codes))
        width = int((bounds[1:] - bounds[:-1]).max(initial=0)) + 2 * longest + 4
        both = np.concatenate([band, band - 1]) + longest
        found, count = np.unique((np.concatenate([text, text]) * len(self.ids) + np.concatenate([item, item])) * width + both, return_counts=True)
        text, item, band = found // width // len(self.ids), found // width % len(self.ids), found % width - longest - 1
        enough = count >= self.bound[item]
        text, item, band = text[enough], item[enough], band[enough]
        return text, item, band * (self.edits[item] + 1)

    def parts(self, item: np.ndarray) -> Iterator[np.ndarray]:
        """The candidates in parts of items of like length, so that a part's work arrays are bounded."""
        size = np.array([len(c) for c in self.codes])[item] + 64 * (self.edits[item] + 1)
        order = np.argsort(size, kind="stable")
        first = 0
        while first < len(order):
            fits = size[order[first:]] * np.arange(1, len(order) - first + 1) <= PART_CELLS
            yield order[first : first + max(1, int(fits.sum()))]
            first += max(1, int(fits.sum()))

    def align(self, codes: np.ndarray, bounds: np.ndarray, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, edits) in its text of each item's best match in its band; edits is beyond the budget if none is within."""
        m = np.array([len(c) for c in self.codes])[item]
        edits = self.edits[item]
        low = diagonal - edits  # cells are kept by diagonal: cell j of row i is character low + i + j of the text
        width = int((2 * (edits + 1) + 2 * edits).max()) + 1
        pattern = np.zeros((len(item), m.max()), np.uint32)
        for r, i in enumerate(item):
            pattern[r, : m[r]] = self.codes[i]
        size = (bounds[1:] - bounds[:-1])[text]
        cell = np.arange(width)
        far = 1 << 20
        where = low[:, None] + cell  # of the character before which the match starts
        cost = np.where((where >= 0) & (where <= size[:, None]), 0, far)
        start = where.copy()
        best_cost, best_end, best_start = np.full(len(item), far), np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        base = bounds[:-1][text]
        for i in range(int(m.max())):
            j = low[:, None] + i + cell
            inside = (j >= 0) & (j < size[:, None])
            chars = codes[np.where(inside, base[:, None] + j, 0)]
            match = cost + np.where(inside, chars != pattern[:, i : i + 1], far)
            skip = np.concatenate([cost[:, 1:], np.full((len(item), 1), far)], 1) + 1  # the item's character is missing
            take = skip < match
            new = np.where(take, skip, match)
            start = np.where(take, np.concatenate([start[:, 1:], start[:, -1:]], 1), start)
            rest = new - cell  # further characters of the text are inserted
            least = np.minimum.accumulate(rest, 1)
            source = np.maximum.accumulate(np.where(rest == least, cell, 0), 1)
            cost, start = least + cell, np.take_along_axis(start, source, 1)
            cost = np.where(j + 1 <= size[:, None], cost, far)
            last = m == i + 1
            if last.any():
                col = cost[last].argmin(1)
                rows = np.flatnonzero(last)
                best_cost[rows], best_end[rows], best_start[rows] = cost[rows, col], low[rows] + i + 1 + col, start[rows, col]
        return best_start, best_end, best_cost


def _short_items(rows: list[tuple[int, str]], q: int) -> dict[int, dict[bytes, list[int]]]:
    """Items of fewer than q characters, which have no q-gram to count, by length and then by their characters."""
    found: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
    for i, t in rows:
        codes = folded(np.frombuffer(t.encode("utf-32-le"), "<u4")).astype("<u4")
        if len(codes) < q:
            found[len(codes)][codes.tobytes()].append(i)
    return {n: dict(x) for n, x in found.items()}


def _exact(short: dict[int, dict[bytes, list[int]]], codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, 0) where short items stand as they are, without those that overlap an earlier one."""
    for n, items in short.items():
        if len(codes) < n:
            continue
        keys = np.array(sorted(int(_grams(np.frombuffer(c, "<u4"), n)[0]) for c in items), np.uint64)
        at = np.flatnonzero(np.isin(_grams(codes, n), keys))
        text = np.searchsorted(bounds, at, "right") - 1
        ends: dict[tuple[int, int], int] = {}
        for a, t in zip(at.tolist(), text.tolist()):
            if a + n <= bounds[t + 1]:
                for i in items.get(codes[a : a + n].astype("<u4").tobytes(), ()):
                    if ends.get((t, i), -1) <= a:
                        ends[t, i] = a + n
                        yield t, i, a - int(bounds[t]), a - int(bounds[t]) + n, 0


def _search(index: ItemIndex, short: dict[int, dict[bytes, list[int]]]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                buf, offs = text_buffer(part["text"])
                codes = folded(np.frombuffer(buf[:-8].tobytes().decode().encode("utf-32-le"), "<u4"))
                bounds = np.concatenate([[0], np.cumsum((buf[:-8] & 0xC0) != 0x80)])[offs]
                exact = list(_exact(short, codes, bounds))
                text, item, diagonal = index.regions(codes, bounds)
                if not len(text) and not exact:
                    continue
                start, end, edits = np.zeros((3, len(text)), np.int64)
                for some in index.parts(item):
                    start[some], end[some], edits[some] = index.align(codes, bounds, text[some], item[some], diagonal[some])
                good = np.flatnonzero(edits <= index.edits[item])
                good = good[np.lexsort((start[good], edits[good], item[good], text[good]))]
                taken: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                rows = []
                for g in good.tolist():  # the matches of an item in a text, best first, without those that overlap a better one
                    spans = taken[int(text[g]), int(item[g])]
                    if all(end[g] <= a or start[g] >= b for a, b in spans):
                        spans.append((start[g], end[g]))
                        rows.append(g)
                ids = np.array([index.ids[i] for i in item[rows]], np.int64)
                cols = [np.concatenate([c, x]) for c, x in zip((text[rows], ids, start[rows], end[rows], edits[rows]), np.array(exact, np.int64).reshape(-1, 5).T)]
                cols = [part["doc_id"].take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "start", "end", "edits"])

    return search


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Where texts of `docs` (doc_id, text) hold items of `benchmark` (item_id, text): doc_id, item_id, start, end, edits.

    An item of n characters is found where a stretch of the text is within min(n * rate, (n - q) / q) edits of it, both
    rounded down; capitals are compared as small letters and any white space as a space. start and end count characters
    of the text. Of overlapping matches of one item the closest is given. Null texts and ids on either side give
    nothing (a null doc_id is given as null); an item of fewer than q characters is found only as it is, an empty one not at all. Repeated rows
    give repeated results; an empty table gives no rows; other columns are ignored.

    Items are sent to all executors in blocks of about `block_chars` characters, each with a pass over the texts, so
    what is broadcast is bounded however large the benchmark is.
    """
    items = benchmark.where(F.length("text") > 0).where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = total // block_chars + 1, None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in range(blocks):
        rows = sorted((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toLocalIterator())
        index = ItemIndex.build([r for r in rows if len(r[1]) >= q], q, rate)
        found = texts.mapInArrow(_search(index, _short_items(rows, q)), "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.unionAll(found)
    return out
