import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("pathwatch.llm")
from pathwatch.llm import decomposition, resampling, spelling  # noqa: E402
from pathwatch.llm.decomposition import binary_pieces, decompose, write_buckets  # noqa: E402
from pathwatch.llm.resampling import NgramTable, bucket_counts, bucket_gains, ngram_spans, resample, xxhash64  # noqa: E402
from pathwatch.llm.spelling import spelling_variants  # noqa: E402
from pathwatch.llm.textbuf import text_buffer  # noqa: E402

from .test_operators import EDGES, frame, prose  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_by_hand(words):
    """Words one edit apart, from every word's own edits."""
    letters, near = {c for w in words for c in w}, defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            edits = {w[:i] + c + w[i:] for c in letters} | {w[:i] + c + w[i + 1 :] for c in letters if i < len(w)} | {w[:i] + w[i + 1 :]}
            near[w] |= (edits & words) - {w}
    return near


def variants_by_hand(rows, min_length=7, min_count=2, factor=10, typo=None):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if typo and h % typo == 0 else run] += 1
    n = {w: c for w, c in n.items() if c >= min_count and len(w) >= min_length}
    near, form = near_by_hand(set(n)), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), c, len(near[w]), n[form[w]] if form[w] else 0) for w, c in n.items())


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def misspelt(seed, n):
    """Words of few letters, so that many are near, in Zipf-like numbers; anagrams, chains and accents among them."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcé", k=r.randint(6, 9))) for _ in range(150)]
    text = [w for k, w in enumerate(words) for _ in range(1 + 300 // (k + 1))]
    text += ["chained"] * 4000 + ["chaine"] * 1 + ["chainer"] * 300 + ["chaiter"] * 25 + ["chbiter"] * 2 + ["ÜBERMUT", "Übermut", "übermut", "überMUT"] * 3
    r.shuffle(text)
    return [(i, r.choice([" ", ", ", "\n", "7"]).join(text[k : k + n])) for i, k in enumerate(range(0, len(text), n))]


@pytest.mark.parametrize(("tile", "visitors", "typo"), [(3, 5, None), (1024, 4096, 31), (50, 10, 3)])
def test_spelling_variants(spark, monkeypatch, tile, visitors, typo):
    monkeypatch.setattr(spelling, "VISITORS", visitors)
    rows = misspelt(3, 90) + EDGES + [(906, "wörter×wörter÷ " * 5), (907, "y" * 9000 + " " + "y" * 9001), (907, "y" * 9000 + " " + "y" * 9001)]
    got = found(spelling_variants(frame(spark, rows), typo=typo, tile=tile))
    want = variants_by_hand(rows, typo=typo)
    assert got == want and len(got) > 100
    if not typo:
        roots = {w: root for w, _, root, *_ in got}
        assert roots["chbiter"] == roots["chaiter"] == roots["chained"] == "chained"
        assert {n for w, *_, n, _ in got if w.startswith("yyy")} == {1}


def test_spelling_variants_of_nothing(spark):
    assert spelling_variants(frame(spark, [])).count() == 0
    assert spelling_variants(frame(spark, [(1, None), (2, ""), (3, "short words only")])).count() == 0
    one = spelling_variants(frame(spark, [(1, "singular singular")])).collect()
    assert [tuple(r) for r in one] == [("singular", None, "singular", 2, 0, None)]


def test_blocks_reach_every_edit():
    """Each pair of words one edit apart lies in blocks that a move joins, in one direction or the other."""
    r = random.Random(8)
    block = lambda w: tuple(sum(c in spelling.DEALT[k :: spelling.CLASSES] for c in w) for k in range(spelling.CLASSES))
    moves = set(map(tuple, spelling._moves()))
    assert sorted(spelling.DEALT) == sorted(spelling.LETTERS)
    for _ in range(3000):
        w = "".join(r.choices(spelling.LETTERS, k=8))
        i, c = r.randrange(8), r.choice(spelling.LETTERS)
        for v in (w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]):
            step = tuple(int(x) for x in np.subtract(block(v), block(w)))
            assert step in moves or tuple(-x for x in step) in moves


@pytest.mark.parametrize("seed", [0, 2024])
def test_xxhash64_equals_the_library(seed):
    import xxhash

    r = random.Random(5)
    spans = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(0, 140), 1000]]
    buf = np.frombuffer(b"".join(spans) + bytes(8), np.uint8)
    size = np.array(list(map(len, spans)))
    assert xxhash64(buf, np.cumsum(size) - size, size, seed).tolist() == [xxhash.xxh64_intdigest(s, seed) for s in spans]


@pytest.mark.parametrize("clash", [False, True])
def test_table_tells_spans_apart_by_their_bytes(monkeypatch, clash):
    """With every key equal, probing and the comparison of bytes alone must tell n-grams apart."""
    if clash:
        monkeypatch.setattr(resampling, "xxhash64", lambda buf, start, size: np.full(len(start), 7, np.uint64))
    import pyarrow as pa

    texts = ["the cat the cat sat", "", "on The-mat", "a" * 40 + " " + "a" * 41, "éé the", None]
    buf, start, size, row, words = ngram_spans(*text_buffer(pa.array(texts)), 2)
    table = NgramTable(buf, start, size, 97)
    grams = [bytes(buf[a : a + n]).decode() for a, n in zip(start, size)]
    assert words.tolist() == [5, 0, 3, 2, 2, 0] and Counter(row.tolist()) == {0: 9, 2: 5, 3: 3, 4: 3}
    assert len({*table.slot.tolist()}) == len(set(grams)) and len({*zip(table.slot.tolist(), grams)}) == len(set(grams))
    assert "the mat" in grams and "sat on" not in grams
    counts = Counter(grams)
    assert all(table.count[s] == counts[g] and table.bucket[s] == zlib.crc32(g.encode()) % 97 for s, g in zip(table.slot, grams))


def resampled_by_hand(rows, target, percent, min_words, most, buckets, seed=2024):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    total = [sum(c.values()) + buckets for c in (s, t)]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total[0] / ((s[b] + 1) * total[1])))
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    can = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(can[: percent * len(can) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize(("most", "percent", "buckets"), [(1, 10, 10_000), (3, 50, 101), (2, 100, 10_000)])
def test_resampling(spark, monkeypatch, most, percent, buckets):
    monkeypatch.setattr(resampling, "BATCH_BYTES", 1500)
    rows = [(i, prose(i % 90, 15 + i % 30)) for i in range(150)] + EDGES + [(7, "Mixed-case WORDS, and 4 digits; " * 9)] * 3
    target = [prose(i, 30) for i in range(5)] + [None, ""]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = resample(frame(spark, rows), table, percent, 20, most, buckets).collect()
    assert sorted(repr(tuple(r)) for r in got) == resampled_by_hand(rows, target, percent, 20, most, buckets)


def test_resampling_leans_to_the_target(spark):
    rows = [(i, prose(i, 40)) for i in range(300)] + [(1000 + i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta"], k=40))) for i in range(30)]
    target = spark.createDataFrame([("alpha beta gamma delta " * 5000,)], "text string")
    got = resample(frame(spark, rows), target).collect()
    drawn = [r.doc_id for r in got if r.rank]
    assert len(drawn) == 33 and sum(i >= 1000 for i in drawn) >= 29


def test_resampling_of_nothing(spark):
    empty, some = frame(spark, []), frame(spark, [(1, "a b"), (None, None)])
    assert resample(empty, some).count() == 0
    assert [(r.doc_id, r.n_features, r.rank) for r in resample(some, empty).orderBy("doc_id").collect()] == [(None, 0, None), (1, 2, None)]
    assert bucket_counts(empty).count() == 0 and bucket_gains(bucket_counts(empty), bucket_counts(empty), 5).tolist() == [0] * 5


@pytest.mark.parametrize("tokens", [1, 2, 64, 4096])
def test_binary_pieces(tokens):
    counts = np.array([1, 2, 3, 63, 64, 65, 127, 5000, 8192, 1])
    doc, start, length = binary_pieces(counts, tokens)
    want = []
    for d, n in enumerate(counts.tolist()):
        at = 0
        while at < n:
            size = tokens
            while size > n - at:
                size //= 2
            want.append((d, at, size))
            at += size
    assert list(zip(doc.tolist(), start.tolist(), length.tolist())) == want


def test_decomposition(spark, monkeypatch):
    from tokenizers import Tokenizer

    from pathwatch.llm.tokens import vocabulary

    monkeypatch.setattr(decomposition, "TEXTS", 3)
    rows = [(i, prose(i, 30 * i)) for i in range(12)] + EDGES
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    got = decompose(frame(spark, rows), 256, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    by_bucket = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_bucket] == sorted(r.length for r in got)
    assert Counter((r.doc_id, r.start) for r in got).most_common(1)[0][1] == 2  # the repeated row
    for i, texts in ids.items():
        pieces = sorted({(r.start, tuple(r.ids)) for r in got if r.doc_id == i})
        assert [x for _, p in pieces for x in p] == texts[0].tolist() and [s for s, _ in pieces] == np.cumsum([0, *(len(p) for _, p in pieces)])[:-1].tolist()
    for r in got:
        assert r.length == len(r.ids) <= 256 and r.length & (r.length - 1) == 0 and r.doc_tokens == len(ids[r.doc_id][0])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert decompose(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        decompose(frame(spark, rows), 1000)


def test_buckets_hold_equal_lengths(spark, tmp_path):
    rows = [(i, prose(i, 30 * i)) for i in range(12)] + EDGES
    write_buckets(frame(spark, rows), str(tmp_path / "buckets"), 256)
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.where("size(ids) <> bucket or length <> bucket").count() == 0
    want = decompose(frame(spark, rows), 256).select("doc_id", "start", "length", "ids_crc32").collect()
    assert Counter(back.select("doc_id", "start", "length", "ids_crc32").collect()) == Counter(want)
    assert spark.read.parquet(str(tmp_path / "buckets")).where("bucket = 64").select("ids").inputFiles()
