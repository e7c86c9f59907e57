"""Identity-provider log: landed JSON lines to logins, and their union with what files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s

GATEWAY = "okta-idp"


def _text(path: str):
    return F.try_variant_get("v", path, "string")


def session_logins(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logins with _source and _row, one row n of other lines) of JSON lines (_source, _row, line).

    Only session starts with a zoned time, an opaque actor and session, and a result of SUCCESS or FAILURE are logins.
    An id that isn't an identifier is replaced by a hash of the line.
    """
    v = lines.withColumn("v", F.try_parse_json("line"))
    opaque = lambda c: F.coalesce(c.rlike(r"^[^\x00-\x1f]{1,256}$"), F.lit(False))
    rows = v.select("_source", "_row", "line", _text("$.eventType").alias("type"), _text("$.uuid").alias("uuid"), s.epoch(_text("$.published")).alias("at"), _text("$.actor.alternateId").alias("actor"), _text("$.authenticationContext.externalSessionId").alias("session"), _text("$.outcome.result").alias("result"))
    good = F.coalesce(F.col("type") == "user.session.start", F.lit(False)) & F.col("at").isNotNull() & opaque(F.col("actor")) & opaque(F.col("session")) & F.coalesce(F.col("result").isin("SUCCESS", "FAILURE"), F.lit(False))
    own = F.when(F.col("uuid").rlike(s.IDENTIFIER), F.col("uuid")).otherwise(s.content_id("okta", F.col("line")))
    unknown = [F.lit(None).cast("boolean").alias(c) for c in ("privileged", "device_trusted", "approved")]
    logins = rows.where(good).select(own.alias("id"), "at", "actor", "session", F.lit(GATEWAY).alias("gateway_id"), (F.col("result") == "SUCCESS").alias("success"), *unknown, "_source", "_row")
    return logins, rows.agg(F.count_if(~good).alias("n"))


def merged(files: DataFrame, idp: DataFrame, now: int) -> DataFrame:
    """Logins of files and of the provider's overlapping windows: future ones dropped, repeats once, conflicts renamed.

    Rows of files come first, so they keep their ids.
    """
    from ..operators import clean

    both = files.withColumn("_source", F.concat(F.lit("0:"), "_source")).unionByName(idp.withColumn("_source", F.concat(F.lit("1:"), "_source")))
    kept, _ = clean.split_future(both, now)
    once, _ = clean.without_repeats(kept)
    return clean.renamed_conflicts(once)
