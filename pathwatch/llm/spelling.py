"""Spelling variants: words one edit apart, found by products of letter-count matrices over adjacent blocks.

One edit changes a word's letter counts by a squared distance of one (a letter more or less) or two (a letter replaced).
Words are blocked by their length, split up by classes of letters: a block is the number of letters of each class, whose
sum is the length. One edit leads to the same block, to one that has a letter more or less in one class, or to one of
equal length in which a letter has changed its class, so only such blocks are multiplied. A product of two blocks gives
all squared distances; pairs of at most two are verified letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All letters that lower-cased runs can have; each is one byte of Latin-1.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Classes of letters, dealt out so that frequent letters of European languages are spread.
CLASSES = 6
DEALT = "etaoinsrhldcumfpgwybvkxjqz" + LETTERS[26:]
#: Words of a block that are multiplied together; a larger block is several such tiles.
TILE = 1024
#: Words that visit a tile in one product.
VISITORS = 4096


def word_counts(docs: DataFrame, min_length: int, min_count: int, typo: int | None = None) -> DataFrame:
    """(word, n) of maximal runs of letters, A-Z lower-cased, of at least `min_length` code points and `min_count` occurrences.

    With `typo`, a run whose crc32 with its doc_id is divisible by it loses a code point that the same number names.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(r"[a-zÀ-ÿ]+"), F.lit(0))).alias("word"))
    runs = runs.where(F.char_length("word") >= min_length)
    if typo:
        h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        cut = F.overlay("word", F.lit(""), (F.col("h") % F.char_length("word") + 1).cast("int"), F.lit(1))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % typo == 0, cut).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= min_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _block(word: Column) -> Column:
    """How many letters of each class a word has."""
    return F.array(*[F.char_length(word) - F.char_length(F.translate(word, DEALT[c::CLASSES], "")) for c in range(CLASSES)])


def _moves() -> list[list[int]]:
    """What must be added to a block to get those it is adjacent to, each pair of blocks once, and itself first."""
    unit = np.eye(CLASSES, dtype=int)
    more = [unit[c] for c in range(CLASSES)]
    changed = [unit[c] - unit[d] for c in range(CLASSES) for d in range(c)]
    return [m.tolist() for m in [unit[0] * 0, *more, *changed]]


class Tile:
    """Words in Latin-1, one after the other with a line feed between, with their letter counts."""

    def __init__(self, packed: bytes, n: np.ndarray):
        self.bytes, self.n = np.frombuffer(packed, np.uint8), n
        gaps = np.flatnonzero(self.bytes == 10)
        self.start, self.end = np.append(0, gaps + 1), np.append(gaps, len(self.bytes))
        self.size = self.end - self.start
        row = np.repeat(np.arange(len(self.size)), self.size)
        letters = self.bytes[self.bytes != 10]
        kind = np.float32 if self.size.max() < 2000 else np.float64  # either holds the products as whole numbers
        self.counts = np.bincount(row * 256 + letters, minlength=len(self.size) * 256).reshape(-1, 256).astype(kind)
        self.norm = (self.counts**2).sum(1)

    def words(self, at: np.ndarray) -> list[str]:
        text = self.bytes.tobytes().decode("latin-1")
        return [text[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist())]


def within_two(home: Tile, other: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of home, of other) whose letter counts have a squared distance of one or two, by one matrix product."""
    used = np.flatnonzero(home.counts.any(0))  # letters that home lacks add to no product
    one = np.ones((len(home.n), 1), home.counts.dtype)
    left = np.concatenate([2 * home.counts[:, used], -home.norm[:, None], -one], 1)
    right = np.concatenate([other.counts[:, used], np.ones((len(other.n), 1), other.counts.dtype), other.norm[:, None]], 1)
    minus = left @ right.T
    at = np.flatnonzero(minus.ravel() >= -2)
    at = at[minus.ravel()[at] <= -1]
    return at // len(other.n), at % len(other.n)


def one_edit(a: Tile, i: np.ndarray, b: Tile, j: np.ndarray) -> np.ndarray:
    """Which pairs differ by one letter that is inserted, deleted or replaced: all others stand in a common start and end."""
    least, most = np.minimum(a.size[i], b.size[j]), np.maximum(a.size[i], b.size[j])
    same = []
    for backward in (False, True):
        total, left = np.zeros(len(i), np.int64), np.flatnonzero(least > 0)
        step = 0
        while len(left):
            x = a.bytes[a.end[i[left]] - 1 - step] if backward else a.bytes[a.start[i[left]] + step]
            y = b.bytes[b.end[j[left]] - 1 - step] if backward else b.bytes[b.start[j[left]] + step]
            left = left[x == y]
            total[left] += 1
            step += 1
            left = left[least[left] > step]
        same.append(total)
    return (same[0] + same[1] >= most - 1) & (most - least <= 1)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: each tile of its own (alone), then all that visit it. Gives (word, near, near_n) both ways."""
    home, waiting, size = None, [], 0

    def compare() -> Iterator[pa.RecordBatch]:
        nonlocal waiting, size
        if waiting:
            other = Tile(b"\n".join(p for p, _ in waiting), np.concatenate([n for _, n in waiting]))
            yield from pairs(other, False)
        waiting, size = [], 0

    def pairs(other: Tile, alone: bool) -> Iterator[pa.RecordBatch]:
        i, j = within_two(home, other)
        if alone:
            i, j = i[i < j], j[i < j]
        good = one_edit(home, i, other, j)
        i, j = i[good], j[good]
        if len(i):
            a, b = home.words(i), other.words(j)
            yield pa.RecordBatch.from_arrays([pa.array(a + b), pa.array(b + a), pa.array(np.concatenate([other.n[j], home.n[i]]))], ["word", "near", "near_n"])

    for batch in batches:
        counts = batch["ns"]
        for alone, packed, first, last in zip(batch["alone"].to_pylist(), batch["packed"].to_pylist(), counts.offsets.to_pylist(), counts.offsets.to_pylist()[1:]):
            n = counts.values.slice(first, last - first).to_numpy()
            if alone:
                yield from compare()
                home = Tile(packed, n)
                yield from pairs(home, True)
                continue
            waiting.append((packed, n))
            size += len(n)
            if size >= VISITORS:
                yield from compare()
    yield from compare()


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n) of all pairs of `words` (word, n; distinct words of LETTERS) that are one edit apart, both ways.

    A block of more than `tile` words is dealt into tiles by hash. A tile is one row, so that what is sent to adjacent
    blocks is rows of many words: each word goes to 22 blocks at most, and to each tile of them.
    """
    blocked = words.withColumn("block", _block(F.col("word")))
    sizes = written(blocked.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    dealt = blocked.join(sizes.hint("merge"), "block").withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    packed = dealt.groupBy("block", "tile").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))  # about `tile` words
    packed = written(packed.select("block", "tile", F.encode(F.array_join("w.word", "\n"), "ISO-8859-1").alias("packed"), F.col("w.n").alias("ns")))

    moves = F.explode(F.array(*[F.array(*map(F.lit, m)) for m in _moves()])).alias("move")
    targets = sizes.select("block", moves).select("block", F.zip_with("block", "move", lambda x, y: x + y).alias("home"))
    targets = written(targets.join(sizes.select(F.col("block").alias("home"), "tiles").hint("merge"), "home"))
    at = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("home_tile")
    visits = packed.join(targets.hint("merge"), "block").select("home", at, "block", "tile", F.lit(False).alias("alone"), "packed", "ns")
    visits = visits.where((F.col("home") != F.col("block")) | (F.col("home_tile") < F.col("tile")))
    homes = packed.select(F.col("block").alias("home"), F.col("tile").alias("home_tile"), "block", "tile", F.lit(True).alias("alone"), "packed", "ns")
    met = homes.unionAll(visits).repartition("home", "home_tile").sortWithinPartitions("home", "home_tile", F.desc("alone"), "block", "tile")
    return met.select("alone", "packed", "ns").mapInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow from each word of `forms` (word, form), whose chains all end.

    Every round doubles how far a word looks, so a chain of n forms takes about log2(n) rounds.
    """
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        now = new.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10, typo: int | None = None, tile: int = TILE) -> DataFrame:
    """Per word of `docs` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are maximal runs of Latin letters (A-Z lower-cased, U+00C0 to U+00FF as they are) of at least `min_length` code
    points and `min_count` occurrences (n) in all texts. Two words are near if one letter is inserted, deleted or replaced
    between them. form is the near word of largest n (ties: the smallest), if that n is at least `factor` times the word's
    own, else null; root is the last form that follows from the word, itself without one. `typo` plants misspellings, for
    measuring: see word_counts(). Null and empty texts have no words; a null doc_id counts as an empty text in a
    misspelling's hash; repeated rows count again. An empty table gives no rows; other columns are ignored.
    """
    words = written(word_counts(docs, min_length, min_count, typo))
    best = F.min(F.struct((-F.col("near_n")).alias("_n"), F.col("near"))).alias("best")
    met = written(near_words(words, tile).groupBy("word").agg(F.count("*").alias("n_near"), best))
    facts = words.join(met.hint("merge"), "word", "left")
    chosen = -F.col("best._n") >= factor * F.col("n")
    facts = written(facts.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best._n")).alias("form_n")))
    ends = roots(facts.where("form is not null"))
    return facts.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
