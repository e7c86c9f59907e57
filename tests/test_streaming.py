import json
import random
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from pathwatch.config import RuleConfig
from pathwatch.operators import rules
from pathwatch.schemas import FILE_ACCESS, LOGINS
from pathwatch.streaming import streams

START = 1_700_000_000


def drain(df, mode):
    name = "q" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stateless_rule_equals_batch(spark, tmp_path):
    rows = [(f"l{i}", START + i, "a", "s", "g", True, i % 2 == 0, False if i % 3 else None, None) for i in range(12)]
    df = spark.createDataFrame(rows, LOGINS)
    df.write.json(str(tmp_path / "in"))
    live = streams.identity(spark.readStream.schema(LOGINS).json(str(tmp_path / "in")), RuleConfig())
    assert {r.id for r in drain(live, "append").collect()} == {r.id for r in rules.identity(df, RuleConfig()).collect()}


def test_bulk_access_reaches_the_batch_peak(spark, tmp_path):
    rows = [(f"r{i}", START + i * 5, "a", "s", "x", f"f{i % 9}", None, None) for i in range(40)]
    df = spark.createDataFrame(rows, FILE_ACCESS)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    config = RuleConfig(window_seconds=30, distinct_file_threshold=3)
    live = drain(streams.bulk_access(spark.readStream.schema(FILE_ACCESS).json(str(tmp_path / "in")), config), "update")
    want = rules.window_peaks(df, 30, 3).first()
    assert live.where("state <> 'closed'").agg(F.max("distinct_files")).first()[0] == want.peak
    assert live.where("state = 'open'").count() == 1
    later = spark.createDataFrame([("z", START + 9000, "b", "s", "x", "f", None, None)], FILE_ACCESS)
    df.unionAll(later).coalesce(1).write.json(str(tmp_path / "later"))
    live = drain(streams.bulk_access(spark.readStream.schema(FILE_ACCESS).json(str(tmp_path / "later")), config), "update")
    assert [(r.actor, r.distinct_files, r.at) for r in live.where("state = 'closed'").collect()] == [("a", want.peak, START + 39 * 5)]


def test_watch_ingests_each_file_once(spark, tmp_path):
    source, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    source.mkdir()
    schema = "id string, at long"

    def land(name, rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("id", "at"), r))) for r in rows) + "\n")
        streams.watch(spark, str(source), schema, out, ckpt, once_only=True).awaitTermination()

    land("a.json", [("1", START), ("2", START), ("2", START)])
    land("b.json", [("2", START), ("3", START), ("1", START + 1)])
    for _ in range(2):  # a batch that is run again adds nothing
        assert sorted((r.id, r.at) for r in streams.ingested(spark, out, schema).collect()) == [("1", START), ("2", START), ("3", START)]
        assert [(r.id, r.at) for r in streams.ingested(spark, out, schema, conflicts=True).collect()] == [("1", START + 1)]
        streams.ingest(spark.createDataFrame([("2", START), ("1", START + 1)], schema), out)


def test_overlapping_windows_keep_ids_once(spark, tmp_path):
    df = spark.createDataFrame([("1", START), ("1", START), ("2", START + 1)], "id string, at long")
    df.write.json(str(tmp_path / "in"))
    assert drain(streams.once(spark.readStream.schema("id string, at long").json(str(tmp_path / "in"))), "append").count() == 2


def with_rows(spark, tmp_path, name, rows, schema):
    """A stream of one file for each list of rows, read one a batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / name))
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))


@pytest.mark.parametrize("batched", [True, False])
def test_silence_and_return(spark, tmp_path, batched):
    """The same rows however they are batched."""
    batches = [[("a", START), ("b", START)], [("b", START + 200)], [("b", START + 400)], [("b", START + 600), ("a", START + 601)], [("b", START + 800)]]
    batches = batches if batched else [[r for b in batches for r in b]]
    events = with_rows(spark, tmp_path, "events", batches, "source string, at long")
    expected = with_rows(spark, tmp_path, "expected", [[("c", START), ("a", START)]], "source string, at long")
    ticks = with_rows(spark, tmp_path, "ticks", [[(START + at,)] for at in ((0, 200, 400, 600, 1000) if batched else (1000,))], "at long")
    got = {tuple(r) for r in drain(streams.silent_sources(events, expected, ticks, 300), "update").collect()}
    assert got == {("a", START, "silent", START + 300), ("a", START + 601, "resumed", START + 601), ("a", START + 601, "silent", START + 901), ("c", 0, "silent", 300)}


def test_polling_goes_on_after_failures(spark, tmp_path):
    source, path, journal, stop, turns = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "journal"), threading.Event(), []
    spark.createDataFrame([("1", START), ("2", START)], "id string, at long").write.json(source)

    def store(df, to):
        turns.append(1)
        if len(turns) == 1:
            raise RuntimeError("token=secret must not be kept")
        if len(turns) == 2:
            df.select("missing").collect()
        streams.ingest(df, to)
        stop.set()

    streams.keep_watching(spark, source, "id string, at long", path, str(tmp_path / "ck"), journal, 0.01, stop, store)
    rows = spark.read.parquet(journal).collect()
    assert sorted(r.error_type for r in rows)[0] == "RuntimeError" and len(rows) == 2 and "secret" not in repr(rows)
    assert streams.ingested(spark, path, "id string").count() == 2


def test_pauses_double_after_failures_and_are_reset():
    class Stop:
        pauses = []

        def is_set(self):
            return len(self.pauses) == 6

        def wait(self, pause):
            self.pauses.append(pause)

    kinds, outcomes = [], iter([KeyError("x"), OSError("y"), OSError("y"), None, ValueError("z"), None])

    def poll():
        if (e := next(outcomes)) is not None:
            raise e

    streams.supervised(poll, kinds.append, 1.0, Stop(), 4.0)
    assert Stop.pauses == [2.0, 4.0, 4.0, 1.0, 2.0, 1.0] and kinds == ["KeyError", "OSError", "OSError", "ValueError"]


def test_logins_before_crossings(spark, tmp_path):
    logins = with_rows(spark, tmp_path, "logins", [[("a", "s", "l1", START), ("a", "s", "l2", START + 500), ("b", "s", "l3", START)]], "actor string, session string, id string, at long")
    crossings = with_rows(spark, tmp_path, "crossings", [[("a", "s", "x", 9, START + 550), ("b", "t", "x", 9, START)]], "actor string, session string, asset_id string, distinct_files long, at long")
    got = drain(streams.correlate(logins, crossings, 100), "append").collect()
    assert [(r.login_id, r.at, r.distinct_files) for r in got] == [("l2", START + 550, 9)]


def test_bulk_access_in_batches_with_late_rows(spark, tmp_path):
    """The peak of several batches, rows out of order among them, is the batch peak."""
    r = random.Random(2)
    rows = [(f"r{i:03}", START + r.randrange(400), "a", "s", "x", f"f{r.randrange(25)}", None, None) for i in range(120)]
    order = sorted(rows, key=lambda x: x[1] + r.randrange(60))
    live = with_rows(spark, tmp_path, "in", [order[k : k + 30] for k in range(0, 120, 30)], FILE_ACCESS)
    got = drain(streams.bulk_access(live, RuleConfig(window_seconds=60, distinct_file_threshold=3)), "update")
    want = rules.window_peaks(spark.createDataFrame(rows, FILE_ACCESS), 60, 3).first()
    assert got.where("state <> 'closed'").agg(F.max("distinct_files")).first()[0] == want.peak


def test_few_reads_need_no_frame(monkeypatch):
    """A key's reads are counted without a data frame, and as the definition says."""
    import random

    from pathwatch.streaming import streams

    monkeypatch.setattr(streams, "pd", None)
    rng, windows = random.Random(5), streams.BulkWindows(10, 3)
    for _ in range(200):
        reads = sorted((rng.randrange(60), str(i), rng.choice(["a", "b", "c", "d", None])) for i in range(rng.randrange(1, 40)))
        counts = [(len({f for a, _, f in reads[: i + 1] if a >= at - 10}), at) for i, (at, _, _) in enumerate(reads)]
        best = max(n for n, _ in counts)
        assert windows._most(reads) == (best, next(at for n, at in counts if n == best))
