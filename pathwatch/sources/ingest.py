"""Raw logs to typed rows: scans, row checks with reasons, quality counts, and the snapshot they make."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..schemas import ASSETS
from ..tables import written
from . import records
from .profiles import ENUMS, PREFIX, Profile

#: Bytes of a JSON line, and seconds that a row's time may lie ahead.
LINE_BYTES, AHEAD = 256 * 1024, 300


@dataclass
class Parsed:
    """rows: typed rows with _source and _row; skipped: (source, reason, n); unknown: (source, column, n); read: (source, n)."""

    rows: DataFrame
    skipped: DataFrame
    unknown: DataFrame
    read: DataFrame
    record: str


def raw_lines(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """(_source, _row, line) of text files in the profile's encoding, a byte-order mark and `skip_rows` lines removed."""
    if profile.encoding in ("utf-8", "utf-8-sig") and not profile.skip_rows:
        df = spark.read.text(path).select(F.col("_metadata.file_name").alias("_source"), F.col("value").alias("line"))
        return df.select("_source", F.monotonically_increasing_id().alias("_row"), F.ltrim(F.col("line"), F.lit("\ufeff")).alias("line"))
    return records.decoded(spark, path, profile.encoding, profile.skip_rows)


def scan(spark: SparkSession, path: str, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(rows with _source, _row, _v: a map of fields, or a variant of JSON; skipped (source, reason, n)). Blank lines don't count.

    Each delimited file has its own header, and columns are matched by name.
    """
    if profile.format == "csv":
        rows = records.delimited(spark, path, profile.encoding, profile.delimiter, profile.skip_rows)
        return rows, spark.createDataFrame([], "source string, reason string, n long")
    lines = raw_lines(spark, path, profile).where(F.trim("line") != "")
    v = F.try_parse_json("line")
    reason = F.when(F.octet_length("line") > LINE_BYTES, "line_too_long").when(v.isNull(), "not_json").when(~F.startswith(F.ltrim("line"), F.lit("{")), "not_an_object")
    marked = lines.select("_source", F.col("_row").cast("long").alias("_row"), v.alias("_v"), reason.alias("reason"))
    skipped = marked.where("reason is not null").groupBy(F.col("_source").alias("source"), "reason").agg(F.count("*").alias("n"))
    return marked.where("reason is null").drop("reason"), skipped


def _lookup(profile: Profile):
    def column(name: str) -> Column:
        if profile.format == "csv":
            return F.col("_v")[name]
        path = "$" + "".join(f"['{p}']" for p in name.split("."))
        return F.try_variant_get("_v", path, "string")

    return column


def parse(rows: DataFrame, profile: Profile) -> Parsed:
    """Typed rows of scanned ones. A row is skipped for the first required target it lacks, in the profile's order.

    The log is read once, here: its checked rows are written, and all that is returned comes from them. Else each count would
    cut the records anew, and the test on the reason, pushed below the values, would hold each of them several times over, in
    code too large for the JVM to compile.
    """
    lookup = _lookup(profile)
    targets = profile.targets
    derive = "derive" in profile.map["id"]
    own = [t for t in targets if not (t == "id" and derive)]
    trimmed = rows.select("_source", "_row", *[s.text(profile.raw_value(t, lookup)).alias(f"_text_{t}") for t in own], *[profile.raw_value(t, lookup).alias(f"_raw_{t}") for t in own if targets[t][0] == "id"])
    typed = trimmed.select("_source", "_row", *[profile.value(t, F.col(f"_text_{t}")).alias(t) for t in own], *[f"_raw_{t}" for t in own if targets[t][0] == "id"])
    reason = F.when(F.lit(False), F.lit(""))
    for t in own:
        kind, needed = targets[t]
        if needed or t == "id":
            reason = reason.when(F.col(t).isNull(), f"missing_{t}")
        if kind == "opaque":
            reason = reason.when((F.length(t) > 256) | F.col(t).rlike(r"[\x00-\x1f]"), f"bad_{t}")
        if kind == "enum":
            reason = reason.when(~F.col(t).isin(ENUMS[t]), f"bad_{t}")
    marked = written(typed.withColumn("_reason", reason))
    good = marked.where("_reason is null").drop("_reason")
    if derive:
        body = s.canonical(**{t: F.col(t) for t in targets if t != "id"})
        good = good.withColumn("id", s.content_id(PREFIX[profile.record], body))
    skipped = marked.where("_reason is not null").groupBy(F.col("_source").alias("source"), F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))
    optional = [t for t, (_, needed) in targets.items() if not needed and t != "id"]
    nulls = F.explode(F.array_compact(F.array(*[F.when(F.col(t).isNull(), F.lit(t)) for t in optional])))
    unknown = good.select(F.col("_source").alias("source"), nulls.alias("column")).groupBy("source", "column").agg(F.count("*").alias("n"))
    read = marked.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"))
    return Parsed(good, skipped, unknown, read, profile.record)


def identifier_collisions(rows: DataFrame, target: str) -> DataFrame:
    """(id, names): identifiers that more than one source name maps to; not empty means the import must stop."""
    return rows.groupBy(F.col(target).alias("id")).agg(F.count_distinct(f"_raw_{target}").alias("names")).where("names > 1")


def normalized_identifiers(rows: DataFrame, target: str) -> DataFrame:
    """One row: how many rows had a name that isn't its identifier."""
    return rows.agg(F.count_if(F.col(target) != s.text(F.col(f"_raw_{target}"))).alias("n"))


def nested_vulnerability(rows: DataFrame) -> DataFrame:
    """Assets with the vulnerability as a struct; null unless a reference is there."""
    v = F.when(F.col("vulnerability_reference").isNotNull(), F.struct(F.col("vulnerability_reference").alias("reference"), F.col("vulnerability_cvss").alias("cvss"), F.col("vulnerability_known_exploited").alias("known_exploited")))
    return rows.withColumn("vulnerability", v).drop("vulnerability_reference", "vulnerability_cvss", "vulnerability_known_exploited")


def provenance(spark: SparkSession, path: str, parsed: Parsed, connector: str = "file-import") -> DataFrame:
    """(label, sha256, rows_read, rows_imported, connector, verified) of each file. verified is set by this job, not by data."""
    files = records.file_digests(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("label"), "sha256")
    kept = parsed.rows.groupBy(F.col("_source").alias("label")).agg(F.count("*").alias("rows_imported"))
    out = files.join(parsed.read.select(F.col("source").alias("label"), F.col("n").alias("rows_read")).hint("merge"), "label", "left").join(kept.hint("merge"), "label", "left")
    return out.select("label", "sha256", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_read", "rows_imported")], F.lit(connector).alias("connector"), F.lit(True).alias("verified"))


def quality(parsed: list[Parsed]) -> DataFrame:
    """(source, record, rows_read, rows_imported, rows_skipped) of each source."""
    out = None
    for p in parsed:
        kept = p.rows.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("rows_imported"))
        one = p.read.withColumnRenamed("n", "rows_read").join(kept.hint("merge"), "source", "left").select("source", F.lit(p.record).alias("record"), "rows_read", F.coalesce("rows_imported", F.lit(0)).alias("rows_imported"))
        one = one.withColumn("rows_skipped", F.col("rows_read") - F.col("rows_imported"))
        out = one if out is None else out.unionByName(one)
    return out


def warnings(quality_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(warning) of a whole import; facts is one row (shadows, conflicts, future_rows, first_at, last_at, as_of)."""
    total = quality_rows.agg(F.sum("rows_read").alias("read"), F.sum("rows_skipped").alias("skipped"), F.collect_set("record").alias("records"))
    row = total.crossJoin(facts)  # one row each
    tests = [(~F.array_contains("records", k), f"no_{k}_source") for k in ("asset", "login", "file_access")]
    tests += [(F.col("shadows") > 0, "unregistered_assets"), (F.col("conflicts") > 0, "conflicting_ids"), (F.col("skipped") > 0.05 * F.greatest("read", F.lit(1)), "many_rows_skipped"), (F.col("last_at") - F.col("first_at") < 3600, "short_time_span"), (F.col("as_of") - F.col("last_at") > 86400, "newest_event_is_old"), (F.col("future_rows") > 0, "future_rows"), (F.lit(True), "authenticity_not_verified")]
    return row.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in tests]))).alias("warning"))


def empty_assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ASSETS)
