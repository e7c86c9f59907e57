"""The detections on streams: ingest with duplicates and conflicts, supervised polls, rules on arrival, bulk access with state, silence."""

from __future__ import annotations

import builtins
import re
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..config import RuleConfig
from ..operators import clean, posture, rules


def timed(events: DataFrame, lateness: str, column: str = "at") -> DataFrame:
    """Events with `ts` for the watermark; what comes later than `lateness` after newer ones is late."""
    return events.withColumn("ts", F.timestamp_seconds(column)).withWatermark("ts", lateness)


def once(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A log polled in overlapping windows: each id once within the watermark."""
    return timed(events, lateness).dropDuplicatesWithinWatermark(["id"])


def identity(logins: DataFrame, config: RuleConfig) -> DataFrame:
    """AS-002 on arrival; it needs no state."""
    return rules.identity(logins, config)


def sensitive_transfers(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """DLP-001 on arrival: each observation once within the watermark, then posture's own test."""
    return posture.sensitive_only(timed(events, lateness).dropDuplicatesWithinWatermark(["source", "event_id"]))


def ingest(batch: DataFrame, path: str) -> None:
    """One micro-batch into the events at `path`: new ids are appended, repeats ignored, conflicts kept beside, marked.

    Rows are stored with their body's hash, so that history is compared by id and hash alone. One append writes all, and
    what it wrote counts as a repeat afterwards: a batch that is run again adds nothing.
    """
    spark = batch.sparkSession
    once = clean.deduplicated(batch)
    once = once.withColumn("_body", clean.body_hash(once))
    old = _read(spark, path, "id string, _body string")
    new = once.join(old, ["id", "_body"], "left_anti")
    known = old.select("id").distinct().withColumn("conflict", F.lit(True))
    new.join(known.hint("merge"), "id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False))).write.mode("append").partitionBy("conflict").parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the first batch finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ingested(spark: SparkSession, path: str, schema: str, conflicts: bool = False) -> DataFrame:
    """The events that ingest() stored at `path`, or those whose id was stored before with other content."""
    rows = _read(spark, path, f"{schema}, conflict boolean")
    return rows.where(F.col("conflict") if conflicts else ~F.col("conflict")).drop("conflict")


def watch(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, once_only: bool = False):
    """Follow files at `source`; a file is read once, so unchanged exports cost nothing. once_only stops at the end."""
    stream = spark.readStream.schema(schema).json(source)
    writer = stream.writeStream.foreachBatch(lambda df, _: ingest(df, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once_only else writer.trigger(processingTime="60 seconds")).start()


class Failures(StreamingQueryListener):
    """Keeps the kinds of errors that ended queries; their messages, which may quote data, aren't kept."""

    def __init__(self):
        self.kinds: Counter = Counter()

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.kinds[event.errorClassOnException or event.exception.split(":")[0].split(".")[-1]] += 1


_READ = StructType([StructField("at", LongType()), StructField("id", StringType()), StructField("file_id", StringType())])
_PEAK = StructType([StructField("peak", LongType()), StructField("last", LongType())])


class BulkWindows(StatefulProcessor):
    """AS-003 with state: reads of the trailing window of one (actor, session, asset), and the highest count so far.

    A crossing is `open`, a higher peak updates it, and it is `closed` once the watermark has passed the last read by a window.
    """

    def __init__(self, window_seconds: int, threshold: int):
        self.window, self.threshold = window_seconds, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reads = handle.getListState("reads", _READ)
        self.best = handle.getValueState("best", _PEAK)

    def _most(self, reads: list[tuple]) -> tuple[int, int]:
        """The highest count of files in a window of sorted reads, and when it is first reached: a small loop, as most keys have few reads.

        As in rules.window_counts(): a file enters where it wasn't read within the window, and leaves when no read renews it.
        """
        entered, leaves, previous = [], [], {}
        for at, _, file in reads:
            renewed = file in previous and at - previous[file] <= self.window
            if file in previous and not renewed:
                leaves.append(previous[file] + self.window)
            entered.append((entered[-1] if entered else 0) + (not renewed))
            previous[file] = at
        leaves = sorted([*leaves, *(at + self.window for at in previous.values())])
        most, when, left = 0, 0, 0
        for (at, _, _), n in zip(reads, entered):
            while left < len(leaves) and leaves[left] < at:
                left += 1
            if n - left > most:
                most, when = n - left, at
        return most, when

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), i, f) for frame in rows for at, i, f in zip(frame["at"], frame["id"], frame["file_id"])]
        best = self.best.get()  # a key without it has neither reads nor timers; each call is a message to Spark
        old = [(r[0], r[1], r[2]) for r in self.reads.get()] if best else []
        reads = sorted([*new, *old], key=lambda r: (r[0], r[1] is None, r[1]))
        before = best[0] if best else 0
        top, top_at = self._most(reads)
        peak, peak_at = (top, top_at) if top > before else (before, None)
        last = max(reads[-1][0], best[1] if best else 0)
        # A late row may fall in windows that end up to a window before the newest read.
        self.reads.put([r for r in reads if r[0] >= last - 2 * self.window])
        self.best.update((peak, last))
        for timer in self.handle.listTimers() if best else ():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.window) * 1000)
        if peak_at is not None and peak >= self.threshold:
            state = "open" if before < self.threshold else "update"
            yield pd.DataFrame({"actor": [key[0]], "session": [key[1]], "asset_id": [key[2]], "state": [state], "distinct_files": [peak], "at": [peak_at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = self.best.get()
        self.reads.clear()
        self.best.clear()
        if best and best[0] >= self.threshold:
            yield pd.DataFrame({"actor": [key[0]], "session": [key[1]], "asset_id": [key[2]], "state": ["closed"], "distinct_files": [best[0]], "at": [best[1]]})

    def close(self) -> None: ...


def bulk_access(reads: DataFrame, config: RuleConfig, lateness: str = "10 minutes") -> DataFrame:
    """(actor, session, asset_id, state, distinct_files, at) in update mode; needs the RocksDB state store."""
    keyed = timed(reads.select("actor", "session", "asset_id", "file_id", "id", "at"), lateness).groupBy("actor", "session", "asset_id")
    processor = BulkWindows(config.window_seconds, config.distinct_file_threshold)
    return keyed.transformWithStateInPandas(processor, "actor string, session string, asset_id string, state string, distinct_files long, at long", "Update", "EventTime")


def correlate(logins: DataFrame, crossings: DataFrame, lookback: int, lateness: str = "10 minutes") -> DataFrame:
    """Logins and bulk crossings of one actor and session at most `lookback` seconds apart, both sides bounded by watermarks."""
    a = timed(logins.select(F.col("actor").alias("l_actor"), F.col("session").alias("l_session"), F.col("id").alias("login_id"), F.col("at").alias("login_at")), lateness, "login_at").withColumnRenamed("ts", "l_ts")
    b = timed(crossings, lateness)
    within = (F.col("l_ts") <= F.col("ts")) & (F.col("l_ts") >= F.col("ts") - F.expr(f"INTERVAL {lookback} SECONDS"))
    return a.join(b, (F.col("l_actor") == F.col("actor")) & (F.col("l_session") == F.col("session")) & within).select("actor", "session", "login_id", "login_at", "at", "distinct_files")


class Silence(StatefulProcessor):
    """Tells when a source falls silent and when it resumes, by event time, so that the same input gives the same rows.

    Rows are of kind event, expected (a source that must be seen, whenever that was said) or tick. A source is silent once
    a later event of its own or the watermark is more than `after` seconds past its last event; ticks move the watermark
    when nothing else comes.
    """

    def __init__(self, after: int):
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType()), StructField("silent", BooleanType())]))

    def _row(self, source: str, last: int, state: str, at: int) -> pd.DataFrame:
        return pd.DataFrame({"source": [source], "last_seen": [last], "state": [state], "at": [at]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        last, silent = self.last.get() or (0, False)
        out = []
        for at in sorted({int(at) for frame in rows for at in frame["at"][frame["kind"] == "event"] if at > last}):
            if last and not silent and at - last > self.after:  # the gap lies between rows of this batch
                out.append(self._row(key[0], last, "silent", last + self.after))
                silent = True
            if silent:
                out.append(self._row(key[0], at, "resumed", at))
            last, silent = at, False
        self.last.update((last, silent))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not silent:
            self.handle.registerTimer((last + self.after) * 1000 + 1)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.update((last, True))
        yield self._row(key[0], last, "silent", last + self.after)

    def close(self) -> None: ...


def silent_sources(events: DataFrame, expected: DataFrame, ticks: DataFrame, after: int = 300, lateness: str = "0 seconds") -> DataFrame:
    """(source, last_seen, state, at) in update mode: sources that fall silent or resume; last_seen is 0 if never seen.

    events: (source, at); expected: (source, at: when it was said); ticks: (at). All are streams; an event later than
    `lateness` behind the newest row is late. Needs the RocksDB state store.
    """
    rows = events.select("source", "at", F.lit("event").alias("kind")).where("source is not null")
    rows = rows.unionByName(expected.select("source", "at", F.lit("expected").alias("kind")))
    rows = rows.unionByName(ticks.select(F.lit(None).cast("string").alias("source"), "at", F.lit("tick").alias("kind")))
    return timed(rows, lateness).groupBy("source").transformWithStateInPandas(Silence(after), "source string, last_seen long, state string, at long", "Update", "EventTime")


_BUILT_IN_ERROR = re.compile(r"^(?:\w+\.)*([A-Z]\w*)(?::|$)", re.MULTILINE)


def failure_kind(error: BaseException) -> str:
    """The kind of an error, never its text: the Python class that ended a query's own function, else Spark's condition or the class."""
    if isinstance(error, PySparkException):
        named = [n for n in _BUILT_IN_ERROR.findall(str(error)) if isinstance(getattr(builtins, n, None), type) and issubclass(getattr(builtins, n), BaseException)]
        return named[-1] if named else error.getCondition() or type(error).__name__
    return type(error).__name__


def record_failure(spark: SparkSession, path: str, kind: str) -> None:
    """A row (action, error_type, at) in the journal of polls at `path`."""
    rows = spark.createDataFrame([("poll_failed", kind, int(time.time()))], "action string, error_type string, at long")
    rows.coalesce(1).write.mode("append").parquet(path)


def supervised(poll: Callable[[], None], record: Callable[[str], None], interval: float = 60.0, stop: threading.Event | None = None, longest: float = 3600.0) -> None:
    """Poll until `stop` is set. A failure is recorded by its kind alone and doubles the pause, up to `longest`; a success resets it."""
    stop, pause = stop or threading.Event(), interval
    while not stop.is_set():
        try:
            poll()
            pause = interval
        except Exception as error:  # whatever it is, polling goes on
            record(failure_kind(error))
            pause = min(2 * pause, longest)
        stop.wait(pause)


def keep_watching(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, journal: str, interval: float = 60.0, stop: threading.Event | None = None, store: Callable[[DataFrame, str], None] = ingest) -> None:
    """watch() as polls under supervision. Each poll takes up at the checkpoint, so what a failed one left is read again."""

    def poll() -> None:
        stream = spark.readStream.schema(schema).json(source)
        stream.writeStream.foreachBatch(lambda df, _: store(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    supervised(poll, lambda kind: record_failure(spark, journal, kind), interval, stop)
