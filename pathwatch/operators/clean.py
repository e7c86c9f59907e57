"""Duplicates, conflicting ids, latest rows, future rows and unregistered assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CONTROL_IDENTIFIER, IDENTIFIER, SHA256, canonical, reasons
from ..schemas import CHANNELS, DATA_CLASSES, EVENT_KINDS, KINDS, OPERATIONS, OUTCOMES, PATCH_STATES, RESULTS, TARGET_TYPES, TENANTS


def body_hash(df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    return F.sha2(canonical(**{c: F.col(c) for c in df.columns if c not in skip and not c.startswith("_")}), 256)


def without_repeats(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events once for each id and content, first in order of _source and _row; (source, n) of what was dropped)."""
    w = Window.partitionBy("id", "_body").orderBy("_source", "_row")
    marked = events.withColumn("_body", body_hash(events)).withColumn("_n", F.row_number().over(w))
    return marked.where("_n = 1").drop("_n"), marked.where("_n > 1").groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"))


def renamed_conflicts(events: DataFrame) -> DataFrame:
    """Events of without_repeats(): of one id with several contents the first keeps it, the others get one of their own.

    No row is lost: either may be the evidence that matters. A new id that is taken already means the same row again.
    """
    w = Window.partitionBy("id").orderBy("_source", "_row")
    new = F.concat(F.substring("id", 1, 40), F.lit(":"), F.substring("_body", 1, 16))
    marked = events.withColumn("_n", F.row_number().over(w)).withColumn("id", F.when(F.col("_n") == 1, F.col("id")).otherwise(new)).withColumn("renamed", F.col("_n") > 1)
    once = Window.partitionBy("id").orderBy("renamed", "_source", "_row")
    return marked.withColumn("_m", F.row_number().over(once)).where("_m = 1").drop("_n", "_m")


def conflicting_ids(events: DataFrame) -> DataFrame:
    """(id, bodies) of ids with several contents; strict callers stop if there are any."""
    body = body_hash(events)
    return events.select("id", body.alias("b")).groupBy("id").agg(F.count_distinct("b").alias("bodies")).where("bodies > 1")


def deduplicated(events: DataFrame) -> DataFrame:
    """Events once each; a conflicting id is an error when rows are read."""
    w = Window.partitionBy("id")
    body = events.withColumn("_body", body_hash(events))
    same = F.min("_body").over(w) == F.max("_body").over(w)
    checked = body.withColumn("id", F.when(same, F.col("id")).otherwise(F.raise_error(F.lit("one event id has several contents"))))
    return checked.dropDuplicates(["id"]).drop("_body")


def latest_assets(assets: DataFrame) -> DataFrame:
    """One row for each asset: the one observed last; of equal times the one read last."""
    w = Window.partitionBy("id").orderBy(F.desc("observed_at"), F.desc("_source"), F.desc("_row"))
    return assets.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def split_future(rows: DataFrame, now: int, column: str = "at", ahead: int = 300) -> tuple[DataFrame, DataFrame]:
    """(rows up to five minutes ahead, later ones counted by their own source)."""
    late = F.col(column) > now + ahead
    return rows.where(~late), rows.where(late).groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"))


def referenced_assets(logins: DataFrame, reads: DataFrame) -> DataFrame:
    return logins.select(F.col("gateway_id").alias("id")).unionAll(reads.select(F.col("asset_id").alias("id"))).distinct()


def shadow_assets(assets: DataFrame, logins: DataFrame, reads: DataFrame) -> DataFrame:
    """Ids that events name and the ledger doesn't."""
    return referenced_assets(logins, reads).join(assets.select("id"), "id", "left_anti")


def with_shadows(assets: DataFrame, logins: DataFrame, reads: DataFrame, stamp: int) -> DataFrame:
    """Assets and the unregistered ones, all facts of which are unknown."""
    new = shadow_assets(assets, logins, reads).select("id", F.lit("unknown").alias("kind"), F.lit("unknown").alias("patch_state"), F.lit(stamp).cast("long").alias("observed_at"))
    return assets.unionByName(new, allowMissingColumns=True)


def registered_only(events: DataFrame, assets: DataFrame, column: str) -> DataFrame:
    return events.join(assets.select(F.col("id").alias(column)).distinct(), column, "left_semi").select(events.columns)


def as_of(assets: DataFrame, logins: DataFrame, reads: DataFrame) -> DataFrame:
    """One row (as_of, first_at, last_at): the newest of events and observations, and the range of events."""
    e = logins.select("at").unionAll(reads.select("at")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    a = assets.agg(F.max("observed_at").alias("seen"))
    return e.crossJoin(a).select(F.greatest("last_at", "seen").alias("as_of"), "first_at", "last_at")  # one row each


#: What rows of each record are ordered by.
ORDERS = {"asset": ["id"], "event": ["at", "id"], "provenance": ["label", "sha256"]}


def in_order(rows: DataFrame, record: str) -> DataFrame:
    """Rows of a record in its canonical order."""
    return rows.orderBy(*ORDERS[record])


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (snapshot_id): equal for equal rows in any order, by a sum of row hashes, so nothing is gathered."""
    h = body_hash(df)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.concat(F.lit("S-"), F.substring(F.sha2(F.concat_ws(",", F.count("*"), *[part(i) for i in range(8)]), 256), 1, 24)).alias("snapshot_id"))


def asset_problems(assets: DataFrame, as_of: int) -> DataFrame:
    """Assets with the array `problems` of what is wrong with each; valid rows have none."""
    v = F.col("vulnerability")
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    repeated = F.count("*").over(Window.partitionBy("id")) > 1
    return assets.withColumn("problems", reasons((bad(F.col("id").rlike(IDENTIFIER)), "bad_id"), (repeated, "repeated_id"), (bad(F.col("kind").isin(KINDS)), "bad_kind"), (bad(F.col("patch_state").isin(PATCH_STATES)), "bad_patch_state"), (bad(F.col("observed_at") <= as_of + 300), "bad_observed_at"), (v.isNotNull() & bad(v["reference"].rlike(IDENTIFIER)), "bad_reference"), (v["cvss"].isNotNull() & (F.isnan(v["cvss"]) | ~v["cvss"].between(0, 10)), "bad_cvss")))


def event_problems(events: DataFrame, assets: DataFrame, asset_column: str, as_of: int) -> DataFrame:
    """Logins or reads with their `problems`; an event of an unregistered asset has one."""
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    opaque = lambda c: F.col(c).rlike(r"^[^\x00-\x1f]{1,256}$")
    known = assets.select(F.col("id").alias(asset_column)).distinct().withColumn("_known", F.lit(True))
    size = [(F.col("bytes_read").isNotNull() & ~F.col("bytes_read").between(0, 10**12), "bad_bytes_read"), (bad(opaque("file_id")), "bad_file_id")] if "bytes_read" in events.columns else []
    marked = events.join(known, asset_column, "left")
    tests = [(bad(F.col("id").rlike(IDENTIFIER)), "bad_id"), (bad(opaque("actor")), "bad_actor"), (bad(opaque("session")), "bad_session"), (F.col("_known").isNull(), "unregistered_asset"), (bad(F.col("at") <= as_of + 300), "bad_at"), *size]
    return marked.withColumn("problems", reasons(*tests)).select(*events.columns, "problems")


def control_event_problems(events: DataFrame, now: int) -> DataFrame:
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    tests = [(bad(F.col("id").rlike(CONTROL_IDENTIFIER)), "bad_id"), (bad(F.col("kind").isin(EVENT_KINDS)), "bad_kind"), (bad(F.col("result").isin(RESULTS)), "bad_result"), (bad(F.col("at").between(now - 30 * 86400, now + 60)), "bad_at"), (bad((F.octet_length("actor") <= 512) & (F.col("actor") != "")), "bad_actor"), (F.col("channel").isNotNull() & ~F.col("channel").isin(CHANNELS), "bad_channel"), (F.col("target_type").isNotNull() & ~F.col("target_type").isin(TARGET_TYPES), "bad_target_type"), (F.col("data_class").isNotNull() & ~F.col("data_class").isin(DATA_CLASSES), "bad_data_class"), (F.col("bytes").isNotNull() & ~F.col("bytes").between(0, 2**53 - 1), "bad_bytes")]
    return events.withColumn("problems", reasons(*tests))


def dlp_problems(events: DataFrame, now: int) -> DataFrame:
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    tests = [(bad(F.col("event_id").rlike(IDENTIFIER)), "bad_event_id"), (bad(F.col("source").rlike(IDENTIFIER)), "bad_source"), (bad(F.length("actor").between(1, 200)), "bad_actor"), (bad(F.col("at").between(now - 30 * 86400, now + 60)), "bad_at"), (bad(F.col("operation").isin(OPERATIONS)), "bad_operation"), (bad(F.col("tenant").isin(TENANTS)), "bad_tenant"), (bad(F.col("data_class").isin(DATA_CLASSES)), "bad_data_class"), (bad(F.col("outcome").isin(OUTCOMES)), "bad_outcome"), (F.col("bytes").isNotNull() & ~F.col("bytes").between(0, 2**40), "bad_bytes")]
    return events.withColumn("problems", reasons(*tests))


def provenance_problems(rows: DataFrame) -> DataFrame:
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    tests = [(bad(F.col("label").rlike(r"^[^/\\\x00-\x1f]{1,120}$")), "bad_label"), (bad(F.col("sha256").rlike(SHA256)), "bad_sha256"), (bad((F.col("rows_read") >= 0) & (F.col("rows_imported") >= 0) & (F.col("rows_imported") <= F.col("rows_read"))), "bad_counts")]
    return rows.withColumn("problems", reasons(*tests))


def baseline_problems(rows: DataFrame) -> DataFrame:
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    repeated = F.count("*").over(Window.partitionBy("organization", "actor")) > 1
    tests = [(bad(F.length("actor").between(1, 512)), "bad_actor"), (repeated, "repeated_actor"), (bad(F.size("samples").between(14, 365)), "bad_sample_count"), (bad(F.forall("samples", lambda x: x.isNotNull() & x.between(0, 2**53 - 1))), "bad_sample")]
    return rows.withColumn("problems", reasons(*tests))


def new_events(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events to append, ids already stored with equal content, ids stored with other content)."""
    batch = deduplicated(incoming)
    old = stored.select("id", body_hash(stored).alias("_old"))
    joined = batch.withColumn("_body", body_hash(batch)).join(old, "id", "left")
    fresh = joined.where("_old is null").drop("_old", "_body")
    return fresh, joined.where("_old = _body").select("id"), joined.where("_old <> _body").select("id")
