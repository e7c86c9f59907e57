from collections import Counter

import pytest

pytest.importorskip("pathwatch.llm")
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(t):
    """Word shingles, once more each time that the number of their occurrences doubles."""
    w = (t or "").encode().lower().split()
    grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    return {(g, k) for g, n in grams.items() for k in range(n.bit_length())}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF)
        assert out.columns == columns
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))

    from pathwatch.llm.toxicity import score_toxicity

    toxic = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert set(rows[1]) == set(rows[0]) - toxic

    root = {i: i for i in rows[1]}
    find = lambda x: x if root[x] == x else find(root[x])
    sets = [(i, shingles(t)) for i, t in rows[1].items()]
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and len(s & u) / len(s | u) >= 0.8 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert set(rows[2]) == {i for i in root if find(i) == i}

    first, want = {}, {}
    for i, t in sorted(rows[2].items()):
        w = t.encode().split()
        gone = set()
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone |= set(range(j, j + 50))
        want[i] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else t
    assert rows[3] == want

    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, t in rows[3].items() if any(b in t for b in bench)}
    assert leaked and not leaked & set(rows[4]) and len(set(rows[3]) - leaked - set(rows[4])) <= 1

    packed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect()
    assert {r.doc_id for r in packed} == set(rows[4])
    assert max(Counter({s: sum(r.length for r in packed if r.sequence_id == s) for s in {r.sequence_id for r in packed}}).values()) <= 1024


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, stage):
    """Rows without an id or a text, repeated rows, an empty table, and columns that stages and operators name themselves."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:]).limit(5)
    odd = odd.unionByName(docs.limit(3)).unionByName(docs.limit(4).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6))
    odd = odd.unionByName(docs.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(2 * 10**6)))
    extra = {"_tag": F.lit("t"), "_kept": F.lit("k"), "kept": F.lit(True), "digest": F.lit("d"), "tag": F.lit(1), "score": F.lit(2.0), "hash": F.lit(3), "label": F.lit("l")}
    rows = docs.unionByName(odd).withColumns(extra)
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, rows, SF)
    empty = run(spark, rows.limit(0), SF)
    assert empty.count() == 0
    if name == "packing":
        pieces = Counter((r.doc_id, r.start) for r in out.collect())
        assert sum(n for (_, start), n in pieces.items() if start == 0) == rows.count()
        return
    assert out.columns == empty.columns == rows.columns
    got = out.collect()
    assert {(r._tag, r._kept, r.kept, r.digest, r.tag, r.score, r.hash, r.label) for r in got} == {("t", "k", True, "d", 1, 2.0, 3, "l")}
    assert sum(r.doc_id is None for r in got) == 5 and sum(r.doc_id is not None and 10**6 <= r.doc_id for r in got) == 5
    assert Counter(got) <= Counter(rows.collect()) or name == "substring_dedup"
