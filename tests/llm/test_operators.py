import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("pathwatch.llm")
from pathwatch.llm import common, packing, tokens  # noqa: E402
from pathwatch.llm.common import connected_components  # noqa: E402
from pathwatch.llm.decontamination import find_leaks  # noqa: E402
from pathwatch.llm.embedding_dedup import near_duplicate_vectors  # noqa: E402
from pathwatch.llm.labelled import held_out  # noqa: E402
from pathwatch.llm.license_scan import scan_licenses  # noqa: E402
from pathwatch.llm.minhash_dedup import near_duplicates, signatures  # noqa: E402
from pathwatch.llm.orc_tokens import read_tokens, tokenize_to_orc, write_tokens  # noqa: E402
from pathwatch.llm.quality import GatedAttention, score_quality  # noqa: E402
from pathwatch.llm.sharding import shard, write_shards  # noqa: E402
from pathwatch.llm.substring_dedup import dedup_substrings  # noqa: E402
from pathwatch.llm.toxicity import BlockMaxIndex, score_toxicity  # noqa: E402

WORDS = [f"w{i:x}" for i in range(4000)]
SCHEMA = "doc_id long, text string, _tag string, hash int, label string, n long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


def frame(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "l", 5) for i, t in rows], SCHEMA)


EDGES = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "Ünï cödé " * 30), (905, "again " * 3000), (905, "again " * 3000), (None, "no id here " * 40)]


@pytest.fixture(scope="module")
def corpus():
    p = prose(1, 60)
    rows = [(i, prose(100 + i, 120)) for i in range(12)]
    rows += [(20, p + " " + prose(2, 40)), (21, prose(3, 30) + "\n" + p), (22, p.replace(" ", "  ")), (23, prose(100, 120)), (24, prose(101, 120).replace("w1", "v1", 2))]
    rows += [(25, "ab cd " * 90 + prose(5, 20)), (26, prose(6, 70) + " cd" + " ab cd" * 60)]
    return rows + EDGES


@pytest.mark.parametrize("max_suffixes", [1, 60, 16_384])
def test_substring_dedup(spark, corpus, max_suffixes):
    got = sorted(map(repr, (tuple(r)[:4] for r in dedup_substrings(frame(spark, corpus), max_suffixes=max_suffixes).collect())))
    first, want = {}, []
    split = [(i, (t or "").encode().split()) for i, t in corpus]
    for i, w in split:
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    for i, w in split:
        gone = set()
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    assert got == sorted(map(repr, want))
    assert dedup_substrings(frame(spark, [])).count() == 0
    near = prose(300, 60).split()  # a shared prefix, but no window in common
    apart = [(1, " ".join(near)), (2, " ".join(w if j % 30 else "other" for j, w in enumerate(near)))]
    assert [r.n_removed for r in dedup_substrings(frame(spark, apart), max_suffixes=max_suffixes).collect()] == [0, 0]


@pytest.mark.parametrize("counted", [False, True])
def test_near_duplicates(spark, corpus, counted):
    rows = corpus + [(30 + k, " ".join(w if random.Random(k * 1000 + j).random() > 0.004 * k else f"z{k}" for j, w in enumerate(prose(7, 200).split()))) for k in range(8)]
    line = prose(70, 8) + " "
    rows += [(60, prose(71, 20) + " " + line * 2 + prose(72, 20)), (61, prose(71, 20) + " " + line * 9 + prose(72, 20)), (62, prose(73, 90) + " " + line * 40), (63, prose(74, 90) + " " + line * 40)]
    got = near_duplicates(frame(spark, rows), counted=counted).collect()

    def bag(t):
        w = (t or "").encode().lower().split()
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        return {(g, k) for g, n in grams.items() for k in range(n.bit_length() if counted else 1)}

    root = {i: i for i, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    named = [(i, bag(t)) for i, t in rows if i is not None]
    links = 0
    for a, (i, s) in enumerate(named):
        for j, u in named[:a]:
            if s and u and len(s & u) / len(s | u) >= 0.8:
                links += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert links > 5 and find(62) != find(63) and (find(60) == find(61)) == (not counted)
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter((i, find(i) if i is not None else None) for i, _ in rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)
    assert near_duplicates(frame(spark, [])).count() == 0


def test_one_id_on_several_texts_keeps_all_their_links(spark):
    a, b, c = prose(80, 120), prose(81, 120), prose(82, 120)
    near = lambda t, k: " ".join(f"z{k}" if j == 60 else w for j, w in enumerate(t.split()))
    rows = [(5, a), (5, b), (1, near(a, 1)), (2, near(b, 2)), (9, c), (8, c), (7, near(c, 3)), (7, a), (6, None), (6, near(b, 4)), (30, prose(83, 120)), (30, ""), (30, prose(83, 120))]
    for seed in range(4):
        turned = random.Random(seed).sample(rows, len(rows))
        got = near_duplicates(frame(spark, turned)).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.class_id) for r in got if r.doc_id not in (6, 30)} == {(i, 1) for i in (5, 1, 2, 9, 8, 7)}
        assert {(r.class_id, r.kept) for r in got if r.doc_id == 6} == {(1, False), (6, True)}  # the null text is its own class
        assert {(r.class_id, r.kept) for r in got if r.doc_id == 30} == {(30, True)}
        assert {r.copy_of for r in got if r.doc_id in (8, 9)} == {8}


def test_a_bucket_of_many_components(spark):
    """Documents that share a band's signature without being linked, in groups that are: no link between any two may be lost."""
    base = prose(90, 200).split()
    rows = []
    for g in range(12):
        r = random.Random(g)
        own = [w if r.random() > 0.045 else f"g{g}" for w in base]
        rows += [(100 * g + k, " ".join(w if random.Random(1000 * g + 10 * k + j).random() > 0.004 else f"k{k}" for j, w in enumerate(own))) for k in range(6)]
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows), bands=60, rows=3).collect()}
    bags = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in bags}
    find = lambda x: x if root[x] == x else find(root[x])
    for i in bags:
        for j in bags:
            if i < j and len(bags[i] & bags[j]) / len(bags[i] | bags[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in bags} and 4 < len(set(got.values())) < len(rows)


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    element = r.integers(0, 2**63, 60).astype(np.uint64)
    a, b = r.uniform(0.1, 3, 60), r.uniform(0.1, 3, 60)
    sig = signatures(np.concatenate([element, element]), np.repeat([0, 1], 60), 3, 4000, np.concatenate([a, b]))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04 and not sig[2].any()


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for e in edges for x in e}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_tokenizers_own(name, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(name))
    t.encode_special_tokens = True
    e = tokens.Encoder(tokens.vocabulary(name))
    r = random.Random(12)
    latin = [chr(c) for c in range(1, 256)]
    letters = [chr(c) for c in range(256, 0x3000) if chr(c).isalnum()] + list("\u1c89\ua7da\u0301\u0308\u2028\u3000\u00a0\u2019😀ßΣςİı")
    texts = [t or "" for _, t in corpus] + ["<|endoftext|> it's\r\n　x  'LL 12,3 ", "İstanbul ΑΣ é \x1c", "a\n b\t c"]
    texts += [f"{a}{c}{b}" for c in latin for a, b in (("", ""), ("a", "b"), (" ", " "), ("A", "\u0301"))]
    texts += ["".join(r.choices(latin + [" ", " ", "'", "s"], k=r.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(r.choices(letters + [" ", "a", "E", "1"], k=r.randint(1, 20))) for _ in range(1500)]
    for text in texts:
        assert e.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_added_tokens_in_texts_get_their_ids(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> B's<|endoftext|>", "<|startoftext|>Ünï <|ENDOFTEXT|>", "<|endoftext|>", "plain"]
    for name, run in [("byte_bpe_50k.json", packing.pack_sequences), ("word_bpe_49k.json", tokenize_to_orc)]:
        t = Tokenizer.from_file(tokens.vocabulary(name))
        want = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in enumerate(texts)}
        assert {r.doc_id: r.ids_crc32 for r in run(frame(spark, list(enumerate(texts)))).collect()} == want


def slow_fit(lengths, capacity):
    """Vector best fit, bin by bin and constraint by constraint."""
    sizes = [[n / capacity[0], 1 / capacity[1], n * n / capacity[2]] for n in lengths]
    demand = [sum(x) for x in zip(*sizes)]
    bins, place = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = []
        for b, left in enumerate(bins):
            after = [x - y for x, y in zip(left, sizes[i])]
            if min(after) >= -1e-12:
                fits.append((sum(d / max(demand) * x * x for d, x in zip(demand, after)), b, after))
        if fits:
            _, b, bins[b] = min(fits, key=lambda f: f[:2])
        else:
            b = len(bins)
            bins.append([1 - y for y in sizes[i]])
        place[i] = b
    return [frozenset(i for i in place if place[i] == b) for b in range(len(bins))]


@pytest.mark.parametrize("capacity", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 4000), (100, 4, 5000)])
def test_vector_best_fit_equals_a_slow_packer(capacity):
    r = np.random.default_rng(21)
    lengths = np.minimum(r.integers(1, 101, 300), np.where(r.random(300) < 0.5, 100, 20))
    lengths = lengths[lengths**2 <= capacity[2]]
    bins = packing.vector_best_fit(lengths, capacity)
    got = {frozenset(np.flatnonzero(bins == b).tolist()) for b in set(bins.tolist())}
    assert got == set(slow_fit(lengths.tolist(), capacity))
    for b in got:
        n = lengths[list(b)]
        assert n.sum() <= capacity[0] and len(n) <= capacity[1] and (n**2).sum() <= capacity[2]


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    rows = corpus + [(50, prose(9, 3000))] + [(51, "the same row")] * 40
    got = packing.pack_sequences(frame(spark, rows), tokens=256).collect()
    t = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    bound = packing.lower_bound(spark.createDataFrame(got), 256).first()
    assert bound.sequences == len(by) <= 1.02 * bound.at_least + 1
    assert packing.pack_sequences(frame(spark, [])).count() == 0


def test_orc_tokens(spark, corpus, tmp_path):
    e = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    got = tokenize_to_orc(frame(spark, corpus)).collect()
    ids = [(i, e.encode(t or "") + b"\2\0\0\0") for i, t in corpus]
    want = Counter((i, len(b) // 4, zlib.crc32(b)) for i, b in ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:k]) for k in range(len(order))]
    assert [r.doc_id for r in order] == sorted((i for i, _ in corpus), key=lambda i: (i is not None, i or 0))
    path = str(tmp_path / "orc")
    write_tokens(frame(spark, corpus), path)
    assert np.array(read_tokens(spark, path).where("doc_id = 20").first().ids, "<u4").tobytes() == dict(ids)[20]
    assert tokenize_to_orc(frame(spark, [])).count() == 0


def test_shards(spark, corpus, tmp_path):
    df = frame(spark, corpus)
    for limit in (10**9, 3000):
        got = shard(df, limit).collect()
        assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in corpus)
        size = Counter()
        for r in got:
            size[r.shard] += r.n_bytes
        assert all(size[r.shard] == r.shard_bytes and (r.shard_bytes <= limit or r.depth == 60) for r in got)
    assert {r.shard for r in shard(df, 10**9).collect()} == {"all"}
    write_shards(df.where("doc_id < 50 or doc_id is null").withColumn("shard", F.lit("x")), str(tmp_path / "s"), 3000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == df.where("doc_id < 50 or doc_id is null").count() and back.where("doc_id is null").count() == 1
    assert shard(frame(spark, [])).count() == 0


def test_rows_without_an_id_and_repeated_ids_are_split(spark, tmp_path):
    nulls = frame(spark, [(None, prose(i, 200)) for i in range(20)])
    got = shard(nulls, 3000).collect()
    assert len(got) == 20 and max(r.shard_bytes for r in got) <= 3000 and len({r.shard for r in got}) > 5
    same = frame(spark, [(7, prose(1, 200))] * 20 + [(None, "equal text " * 90)] * 20 + [(8, "long " * 2000), (None, None)])
    got = {(r.doc_id, r.n_bytes > 5000): r for r in shard(same, 3000).collect()}
    assert got[7, False].depth == got[8, True].depth == 60 and got[7, False].shard_rows == 20
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small tasks aren't run as one
    write_shards(same, str(tmp_path / "s"), 3000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(back.select("doc_id", "text").collect()) == Counter(same.select("doc_id", "text").collect())
    files = back.where("doc_id = 7").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 20
    write_shards(frame(spark, []), str(tmp_path / "none"), 3000)


def test_embeddings(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 24))
    x[150:200] = x[:50] + 0.05 * r.standard_normal((50, 24))
    x[200:260] = x[0] + 0.1 * r.standard_normal((60, 24))
    rows = [(i, v.tolist(), i % 2 if i < 150 else (i - 150) % 2 if i < 200 else 0) for i, v in enumerate(x)]
    rows += [(300, rows[4][1], 0), (301, None, 0), (302, [0.0] * 24, 0), (303, [float("nan")] * 24, 0), (304, rows[0][1], None), (305, [1.0, 2.0, 3.0], 0), (306, [None] * 24, 1), (307, [1.0, 2.0, 3.01], 0), (308, [], 0), (309, [float("inf")] * 24, 0), (None, rows[0][1], 0)]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "'x' AS digest", "2 AS weight", "3 AS vector")
    got = {g.vec_id: g for g in near_duplicate_vectors(frame_).collect()}
    good = [g for g in rows if g[0] is not None and g[0] <= 300]
    u = np.array([g[1] for g in good])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.array([g[2] for g in good])
    link = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(301))
    assert 0.95 * link.sum() <= found <= link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(301))
    assert got[300].n_links >= 1 and got[300].component_id == got[4].component_id
    assert [(got[i].n_links, got[i].component_id) for i in (305, 307)] == [(1, 305), (1, 305)]
    for i in (301, 302, 303, 304, 306, 308, 309):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def planted_pairs(n, low, high, dims=64):
    """n pairs (i, n + i) of unit vectors with cosines between low and high."""
    r = np.random.default_rng(8)
    a, b = r.standard_normal((2, n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = r.uniform(low, high, (n, 1))
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])


@pytest.mark.parametrize("n", [60, 700, 3000])
def test_embeddings_at_the_bound(spark, n):
    x = planted_pairs(n, 0.9301, 0.9305)
    vectors = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert near_duplicate_vectors(vectors).where("n_links > 0").count() / (2 * n) > (0.97 if n < 100 else 0.99)


def test_embeddings_of_a_bucket_of_several_blocks(spark):
    """2,600 vectors around one point, some of whose pairs are links: every bucket is compared in pairs of blocks."""
    r = np.random.default_rng(9)
    x = r.standard_normal(48) + 0.33 * r.standard_normal((2600, 48))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.93
    np.fill_diagonal(link, False)
    vectors = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {g.vec_id: g.n_links for g in near_duplicate_vectors(vectors).collect()}
    assert 0.001 < link.mean() < 0.5
    assert 0.99 * link.sum() <= sum(got.values()) <= link.sum() and all(got[i] <= link[i].sum() for i in got)


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks(spark, corpus):
    items = [(1, prose(500, 30)), (2, prose(501, 25)), (3, "Ünï c"), (None, prose(502, 20)), (4, None), (5, prose(503, 40)), (6, ""), (7, "zq q")]
    edited = list(items[0][1])
    for k in range(5, 100, 25):
        edited[k] = "#"
    rows = corpus + [(60, prose(8, 50) + " " + items[0][1].upper() + " end"), (61, "".join(edited)), (62, items[1][1][:60]), (63, items[5][1].replace(" ", "\n") + prose(4, 9)), (63, items[1][1] + " x " + items[1][1]), (64, "zq qzq qq")]
    got = Counter((r.doc_id, r.item_id) for r in find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_chars=200).collect())
    want = Counter()
    for i, t in rows:
        for b, s in items:
            if b is not None and s:
                budget = max(0, min(len(s) // 10, (len(s) - 8) // 8))
                if t and edit_distance_inside(s.lower(), re.sub(r"\s", " ", t.lower())) <= budget:
                    want[i, b] += 1
    want[63, 2] = want[64, 7] = 2
    want[904, 3] = 30
    assert got == want
    assert find_leaks(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert find_leaks(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_licenses(spark, corpus):
    rows = corpus + [(70, "x Released under the MIT License. Under the MIT license!"), (71, "This work is licensed under the GNU General, Public License, version 3."), (72, "Licensed under CC BY-NC 4.0"), (73, "the license is public")]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    assert len(scan_licenses(frame(spark, rows)).collect()) == len(rows)
    assert (got[70].n_base, got[70].first_word, got[70].last_word, got[70].base_labels) == (2, 2, 6, "mit")
    assert (got[71].base_labels, got[71].labels, got[71].n_base) == ("", "gpl-3", 0) and got[71].score == 1.0
    assert got[72].labels == "cc-by-nc" and got[73].labels == "" and got[73].score == 0
    assert (got[900].n_words, got[900].first_word) == (0, None) and got[905].n_words == 3000
    assert scan_licenses(frame(spark, [])).count() == 0


def labelled(n):
    r = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        bad, junk = i % 3 == 0, i % 4 == 0
        w = prose(2000 + i, 90).split()
        for _ in range(4 if bad else 0):
            w[r.randrange(90)] = r.choice(["moronic", "loathsome", "trashy"])
        docs.append((i, " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)))
        labels.append((i, int(not junk), int(bad)))
    return docs, labels


@pytest.mark.parametrize(("score", "column", "cut"), [(score_toxicity, 2, 0.7), (score_quality, 1, 0.5)])
def test_learned_scores(spark, score, column, cut):
    docs, labels = labelled(600)
    table = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = score(frame(spark, docs + EDGES), table).collect()
    assert len(got) == len(docs) + len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    truth = {x[0]: x[column] for x in labels}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.97
    # Labels of held-out rows must not matter.
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in labels]
    again = score(frame(spark, docs + EDGES), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    first = {r.doc_id: r.score for r in got}
    assert all(math.isclose(r.score, first[r.doc_id], abs_tol=1e-6) for r in again)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score(frame(spark, docs[:3]), none).collect()} == {0.5}
    assert score(frame(spark, []), table).count() == 0


def test_attention_and_gradients_equal_slow_ones():
    r = np.random.default_rng(6)
    bags = np.array([1, 4, 2, 6])
    x, y, weight = r.standard_normal((13, 5)), np.array([1, 0, 0, 1]), np.array([0.1, 0.2, 0.3, 0.4])
    shapes = {"W": (5, 4), "w0": (4,), "V": (4, 3), "G": (4, 3), "u": (3,), "c": (4,), "b": (1,)}
    model = GatedAttention(x.mean(0), x.std(0), {k: r.standard_normal(v) for k, v in shapes.items()})

    def scores():
        p, out, first = model.p, [], 0
        for n in bags:
            h = [np.tanh((row - model.mean) / model.scale @ p["W"] + p["w0"]) for row in x[first : first + n]]
            e = [math.exp((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["G"])))) @ p["u"]) for v in h]
            z = sum(w / sum(e) * v for w, v in zip(e, h))
            out.append(float(1 / (1 + np.exp(-(z @ p["c"] + p["b"])))[0]))
            first += n
        return out

    f = model.forward(x, bags)
    assert np.allclose(f["score"], scores()) and np.allclose(np.add.reduceat(f["a"], f["first"]), 1)
    loss = lambda: -sum(w * (t * math.log(s) + (1 - t) * math.log(1 - s)) for w, t, s in zip(weight, y, scores()))
    for k, grad in model.gradients(x, bags, y, weight).items():
        for i in np.ndindex(grad.shape):
            kept, sides = model.p[k][i], []
            for step in (1e-5, -1e-5):
                model.p[k][i] = kept + step
                sides.append(loss())
            model.p[k][i] = kept
            assert math.isclose((sides[0] - sides[1]) / 2e-5, grad[i], abs_tol=1e-7)


def test_scopes_remove_what_was_written(spark):
    with common.scope(spark):
        path = common.scratch(spark, kept=True)
        inner = common.written(spark.range(3))
        kept = common.written(inner.where("id > 0"), path)
    assert kept.count() == 2
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(inner.inputFiles()[0]).count()


def test_block_max_search_is_exact():
    r = np.random.default_rng(2)
    x = r.random((500, 40)) * (r.random((500, 40)) < 0.15)
    x /= np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    index = BlockMaxIndex.build(np.arange(500), np.zeros(500, int), x)
    place, cosine = index.search(x[:100], 10)
    want = -np.sort(-(x[:100] @ x.T), 1)[:, :10]
    assert np.allclose(cosine, np.maximum(want, 0)) and (index.ids[place[:, 0]] >= 0).all()


def g2(n0, n1, m0, m1):
    """Likelihood ratio of a term that n0 of m0 rows and n1 of m1 rows have."""
    part = lambda k, m: sum(x * math.log(x / m) for x in (k, m - k) if x)
    return 2 * (part(n0, m0) + part(n1, m1) - part(n0 + n1, m0 + m1))


@pytest.mark.parametrize("told", [False, True])
def test_toxicity_equals_a_slow_search(spark, told):
    """Terms, weights, cosines, votes and calibration, with and without words that tell the classes apart."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 10))) for _ in range(300)]
    docs = [(i, " ".join(r.choices(words, k=60) + ["grim"] * (told and i % 2 and i % 10 > 1))) for i in range(150)]
    sampled = [i for i, _ in docs[:120] if zlib.crc32(str(i).encode()) % 3 != 1]
    docs += [(200, docs[sampled[0]][1]), (201, docs[sampled[1]][1] + " zzyzx zzyzx"), (202, "zzyzx")]
    table = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in score_toxicity(frame(spark, docs), table).collect()}
    bags = {i: Counter(text.split()) for i, text in docs}
    df = Counter(t for b in bags.values() for t in b)
    have = [Counter(t for i in sampled if i % 2 == k for t in bags[i]) for k in (0, 1)]
    m = [sum(i % 2 == k for i in sampled) for k in (0, 1)]
    weight = lambda t: (math.log((1 + len(docs)) / (1 + (df[t] if t in have[0] | have[1] else 1))) + 1) * (0.02 + 1 / (1 + math.exp((30 - g2(have[0][t], have[1][t], *m)) / 5)))
    vec = {i: {t: (1 + math.log(n)) * weight(t) for t, n in b.items()} for i, b in bags.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    logit = lambda p: math.log(p / (1 - p))
    votes = []
    for i, v in vec.items():
        near = sorted(((sum(v.get(t, 0) * x for t, x in vec[j].items()) / norm[i] / norm[j], j) for j in sampled if j != i), reverse=True)
        assert np.allclose([e.cosine for e in got[i].evidence], [c for c, _ in near[:5] if c > 0])
        assert all(e.doc_id != i and e.label == e.doc_id % 2 for e in got[i].evidence)
        if near[24][0] - near[25][0] > 1e-9 or not near[0][0]:
            near = [(c / (1.05 - c), j % 2) for c, j in near[:25]]
            votes.append((logit((sum(x * y for x, y in near) + 0.1 * m[1] / sum(m)) / (sum(x for x, _ in near) + 0.1)), logit(got[i].score)))
    x, y = np.array(votes).T
    slope, cut = np.polyfit(x, y, 1)
    assert len(votes) > 100 and slope > 0 and np.allclose(slope * x + cut, y, atol=1e-6)
    assert got[200].evidence[0].doc_id == sampled[0] and math.isclose(got[200].evidence[0].cosine, 1)
    assert got[201].evidence[0].doc_id == sampled[1] and got[202].evidence == []


def test_ties_for_the_last_place_share_it(spark):
    """Thirty equal examples of either label: each vote counts as much, whatever their ids."""
    docs = [(i, "alpha beta gamma") for i in range(60)] + [(900, "alpha beta gamma")]
    table = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, toxic int")
    turned = spark.createDataFrame([(59 - i, int(i < 30)) for i in range(60)], "doc_id long, toxic int")
    one, other = ({r.doc_id: r.score for r in score_toxicity(frame(spark, docs), t).collect()} for t in (table, turned))
    sampled = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    part = sum(i < 30 for i in sampled) / len(sampled)
    assert abs(one[900] - part) < 0.1 and abs(other[900] - (1 - part)) < 0.1


def test_held_out(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
