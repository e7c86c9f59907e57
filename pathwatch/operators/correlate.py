"""Cases over multi-source control events of many organizations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import is_false, is_true

LOGIN_KINDS = ["vpn_login", "idp_login"]
WHO = ["organization", "actor"]
EVIDENCE = 32


def _summaries(rule: str, n_keys: int, schema: pa.Schema):
    """One row for each key from rows sorted by key and id (keys, id, text of the id in JSON, place, at).

    A key's ids go through one SHA-256 as they come, and of their places only the first EVIDENCE are held, so a key's
    evidence is never in memory as a whole. Rows of equal id are one, at their least place and time.
    """

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, state = None, None

        def end_id() -> None:
            if state and state["id"] is not None:
                state["hash"].update((b"," if state["n"] else b"") + state["json"].encode())
                state["n"] += 1
                state["first"].append((*state["place"], state["id"]))
                if len(state["first"]) > 64 * EVIDENCE:
                    state["first"] = nsmallest(EVIDENCE, state["first"])

        def end_key() -> None:
            end_id()
            if state:
                state["hash"].update(b"]]")
                shown = [i for _, _, i in nsmallest(EVIDENCE, state["first"])]
                out.append((*now, state["hash"].hexdigest()[:24], shown, state["n"], state["lo"], state["hi"]))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(n_keys + 4)]
            for *key, i, text, place, at in zip(*columns):
                if key != now:
                    end_key()
                    now, state = key, {"hash": hashlib.sha256(f'["{rule}",['.encode()), "n": 0, "id": None, "first": [], "lo": at, "hi": at}
                if i != state["id"]:
                    end_id()
                    state |= {"id": i, "json": text, "place": (place, at)}
                state["place"] = min(state["place"], (place, at))
                state["lo"], state["hi"] = min(state["lo"], at), max(state["hi"], at)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        end_key()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return summarize


def case(rows: DataFrame, keys: list[str], rule: str, priority: str) -> DataFrame:
    """One case per key from evidence rows (keys: texts; id, at, place): distinct ids in order of place and time, the first 32 shown.

    The id digests all ids in sorted order, as case_id() does for an array of them. Rows are sorted by key and id, and each
    key's ids pass by one at a time: no array of a key's evidence is built, however much there is. Rows without an id or a
    time are no evidence.
    """
    text = F.expr("substring(to_json(array(id)), 2, length(to_json(array(id))) - 2)")
    rows = rows.where("id is not null and at is not null").select(*keys, "id", text.alias("json"), F.col("place").cast("int").alias("place"), F.col("at").cast("long").alias("at"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "id")
    named = [(k, pa.string()) for k in keys] + [("id", pa.string()), ("evidence_ids", pa.list_(pa.string())), ("evidence_count", pa.int64()), ("first_at", pa.int64()), ("last_at", pa.int64())]
    kinds = ", ".join(f"{k} string" for k in keys) + ", id string, evidence_ids array<string>, evidence_count long, first_at long, last_at long"
    found = rows.mapInArrow(_summaries(rule, len(keys), pa.schema(named)), kinds)
    return found.select(
        "id",
        F.lit(rule).alias("rule"),
        F.lit(priority).alias("priority"),
        *WHO,
        "evidence_ids",
        "evidence_count",
        (F.col("evidence_count") > EVIDENCE).alias("evidence_truncated"),
        "first_at",
        "last_at",
        *[F.lit(False).alias(c) for c in ("leak_confirmed", "intrusion_confirmed", "automatic_action")],
    )


def _outside(c: Column) -> Column:
    return c.isin("confidential", "restricted")


def sensitive_egress(events: DataFrame, now: int) -> DataFrame:
    """AN-SENSITIVE-EGRESS: confidential or restricted data to a personal or unknown target in the last day."""
    rows = events.where((F.col("at") >= now - 86400) & (F.col("kind") == "egress") & _outside(F.col("data_class")) & F.col("target_type").isin("personal", "unknown") & (F.col("result") != "blocked"))
    return case(rows.withColumn("place", F.lit(0)), WHO, "AN-SENSITIVE-EGRESS", "P1")


def low_and_slow(events: DataFrame, now: int, least: int = 3, spread: int = 600) -> DataFrame:
    """AN-LOW-SLOW: repeated transfers of classified data out of the organization in the last day."""
    rows = events.where((F.col("at") >= now - 86400) & (F.col("kind") == "egress") & (F.col("target_type") != "organization") & (F.col("result") != "blocked") & F.col("data_class").isin("internal", "confidential", "restricted"))
    out = case(rows.withColumn("place", F.lit(0)), WHO, "AN-LOW-SLOW", "P2")
    return out.where((F.col("evidence_count") >= least) & (F.col("last_at") - F.col("first_at") >= spread))


def failures_before(events: DataFrame, window: int = 600, least: int = 5) -> DataFrame:
    """(organization, actor, login_id, login_at, source, failures): successes with so many failures before, at one source.

    A range frame over seconds counts them in one sort of each (organization, actor, source), without a self join.
    """
    rows = events.where(F.col("kind").isin(LOGIN_KINDS) & F.col("result").isin("success", "failure"))
    frame = Window.partitionBy(*WHO, "source").orderBy("at").rangeBetween(-window, -1)
    counted = rows.withColumn("failures", F.count_if(F.col("result") == "failure").over(frame))
    return counted.where((F.col("result") == "success") & (F.col("failures") >= least)).select(*WHO, "source", F.col("id").alias("login_id"), F.col("at").alias("login_at"), "failures")


def login_after_failures(events: DataFrame, window: int = 600, least: int = 5) -> DataFrame:
    """AN-LOGIN-AFTER-FAILURES: one case for each such login, with the failures as evidence."""
    hits = failures_before(events, window, least)
    failed = events.where(F.col("kind").isin(LOGIN_KINDS) & (F.col("result") == "failure")).select(*WHO, "source", "id", "at")
    delta = F.col("login_at") - F.col("at")
    rows = failed.join(hits, [*WHO, "source"]).where((delta > 0) & (delta <= window)).select(*WHO, "login_id", "id", "at", F.lit(0).alias("place"))
    rows = rows.unionByName(hits.select(*WHO, "login_id", F.col("login_id").alias("id"), F.col("login_at").alias("at"), F.lit(1).alias("place")))
    return case(rows, [*WHO, "login_id"], "AN-LOGIN-AFTER-FAILURES", "P2")


def privilege_data_path(events: DataFrame, risky_assets: DataFrame, window: int = 3600) -> DataFrame:
    """AN-VPN-PRIVILEGE-DATA-PATH: a privileged login without its safeguards on a risky asset, then sensitive reads in its session."""
    bad = is_true("privileged") & (is_false("mfa") | is_false("device_trusted"))
    logins = events.where(F.col("kind").isin(LOGIN_KINDS) & (F.col("result") == "success") & bad & F.col("session").isNotNull())
    logins = logins.join(risky_assets.select("organization", "asset").distinct(), ["organization", "asset"], "left_semi").select(*WHO, "session", F.col("id").alias("login_id"), F.col("at").alias("login_at"))
    delta = F.col("at") - F.col("login_at")
    read = (F.col("kind") == "file_read") & (F.col("result") == "success")
    egress = (F.col("kind") == "egress") & (F.col("result") != "blocked") & (F.col("target_type") != "organization")
    after = events.where((read | egress) & _outside(F.col("data_class"))).select(*WHO, "session", "id", "at", read.alias("read"))
    rows = logins.join(after, [*WHO, "session"]).where((delta >= 0) & (delta <= window))
    first = rows.where("read").groupBy(*WHO, "login_id").agg(F.min("at").alias("first_read"))
    rows = rows.join(first, [*WHO, "login_id"]).where(F.col("read") | (F.col("at") >= F.col("first_read"))).select(*WHO, "login_id", "id", "at", F.when(F.col("read"), 1).otherwise(2).alias("place"))
    starts = logins.join(first, [*WHO, "login_id"], "left_semi").select(*WHO, "login_id", F.col("login_id").alias("id"), F.col("login_at").alias("at"), F.lit(0).alias("place"))
    return case(rows.unionByName(starts), [*WHO, "login_id"], "AN-VPN-PRIVILEGE-DATA-PATH", "P1")


def _median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(s)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def baseline_limits(baselines: DataFrame) -> DataFrame:
    """(organization, actor, until, median, mad, threshold)."""
    m = baselines.withColumn("median", _median(F.col("samples")))
    m = m.withColumn("mad", _median(F.transform("samples", lambda x: F.abs(x - F.col("median")))))
    return m.select(*WHO, "until", "median", "mad", F.greatest(F.col("median") * 3, F.col("median") + 6 * F.greatest("mad", F.lit(1024.0)), F.lit(1048576.0)).alias("threshold"))


def baseline_deviation(events: DataFrame, baselines: DataFrame, now: int) -> DataFrame:
    """AN-BASELINE-DEVIATION: bytes sent in the last day beyond what a frozen baseline allows.

    A baseline that reaches into that day is an error; baselines are checked before events are read.
    """
    if baselines.where(F.col("until") >= now - 86400).limit(1).count():
        raise ValueError("a baseline must end before the period it is compared with")
    rows = events.where((F.col("at") >= now - 86400) & (F.col("kind") == "egress") & (F.col("result") == "success"))
    over = rows.groupBy(*WHO).agg(F.sum("bytes").alias("amount")).join(baseline_limits(baselines), WHO).where(F.col("amount") > F.col("threshold"))
    return case(rows.join(over, WHO, "left_semi").withColumn("place", F.lit(0)), WHO, "AN-BASELINE-DEVIATION", "P2")


def analyze(events: DataFrame, risky_assets: DataFrame, baselines: DataFrame, now: int) -> DataFrame:
    """All cases over deduplicated events; see clean.deduplicated()."""
    parts = [sensitive_egress(events, now), low_and_slow(events, now), login_after_failures(events), privilege_data_path(events, risky_assets), baseline_deviation(events, baselines, now)]
    return reduce(DataFrame.unionByName, parts)


def stale_sources(events: DataFrame, expected: DataFrame, now: int, after: int = 300) -> DataFrame:
    """(source, last_seen) of expected sources that were last seen too long ago, or never (0)."""
    seen = events.groupBy("source").agg(F.max("at").alias("last_seen"))
    rows = expected.select("source").distinct().join(seen, "source", "left").select("source", F.coalesce("last_seen", F.lit(0)).alias("last_seen"))
    return rows.where(now - F.col("last_seen") > after)
