"""JSON documents whose keys are fixed: snapshots, scenarios, requests and policies. Extra keys are errors, not ignored."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BOUNDS, RuleConfig
from ..functions.scalars import IDENTIFIER, reasons

ASSET_JSON = "id string, kind string, patch_state string, observed_at string, internet_exposed boolean, privileged_path boolean, sensitive_path boolean, vulnerability struct<reference:string,cvss:double,known_exploited:boolean>"
EVENT_JSON = "id string, type string, at string, actor string, session string, gateway_id string, success boolean, privileged boolean, device_trusted boolean, approved boolean, asset_id string, file_id string, sensitive boolean, bytes_read long"
SNAPSHOT_KEYS = (["schema_version", "as_of", "assets", "events"], ["source_mode", "provenance"])
LABEL_KEYS = (["malicious_event_ids", "malicious_asset_ids", "expect_rules"], [])
REQUEST_KEYS = (["event_id", "action", "destination", "text", "data_class"], ["tool"])
GRANT_KEYS = (["action", "destination", "data_classes"], ["tool"])
RULES = ["AS-002", "AS-003", "AS-004"]


def key_problems(body: Column, required: list[str], optional: list[str]) -> Column:
    """What is wrong with a JSON object's keys: not an object (a repeated key, NaN or cut text included), missing or unknown ones."""
    keys = F.json_object_keys(body)
    broken = F.try_parse_json(body).isNull() | keys.isNull()
    known = F.array(*[F.lit(k) for k in required + optional])
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys)) > 0
    unknown = F.size(F.array_except(keys, known)) > 0
    return reasons((broken, "not_an_object"), (~broken & missing, "missing_keys"), (~broken & unknown, "unknown_keys"))


def read_documents(spark: SparkSession, path: str, keys: tuple[list[str], list[str]]) -> DataFrame:
    """(source, body, problems) of whole JSON files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("body"))
    return files.withColumn("problems", key_problems(F.col("body"), *keys))


def strict(rows: DataFrame) -> DataFrame:
    """The rows, or an error when one with problems is read."""
    bad = F.size("problems") > 0
    return rows.withColumn("problems", F.when(bad, F.raise_error(F.concat(F.lit("invalid document: "), F.array_join("problems", ",")))).otherwise(F.col("problems")))


def snapshot_assets(documents: DataFrame) -> DataFrame:
    return documents.select("source", F.explode(F.from_json(F.get_json_object("body", "$.assets"), f"array<struct<{_fields(ASSET_JSON)}>>")).alias("a")).select("source", "a.*")


def snapshot_events(documents: DataFrame, kind: str) -> DataFrame:
    """Events of one type: login or file_access."""
    rows = documents.select("source", F.explode(F.from_json(F.get_json_object("body", "$.events"), f"array<struct<{_fields(EVENT_JSON)}>>")).alias("e")).select("source", "e.*")
    return rows.where(F.col("type") == kind).drop("type")


def _fields(ddl: str) -> str:
    """`name type` pairs as struct fields; commas inside nested types stay."""
    return ", ".join(p.strip().replace(" ", ":", 1) for p in ddl.split(", "))


def label_problems(labels: DataFrame) -> DataFrame:
    """Scenario labels (malicious_event_ids, malicious_asset_ids, expect_rules) with `problems`."""
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    ids = lambda c: bad(F.forall(c, lambda x: x.rlike(IDENTIFIER)))
    return labels.withColumn("problems", reasons((ids("malicious_event_ids"), "bad_event_ids"), (ids("malicious_asset_ids"), "bad_asset_ids"), (bad(F.forall("expect_rules", lambda r: r.isin(RULES))), "unknown_rules")))


def finding(found: DataFrame, finding_id: str) -> DataFrame:
    """The finding of one id in the current set."""
    return found.where(F.col("id") == finding_id)


def setting_problems(body: Column) -> Column:
    """What is wrong with rule settings as JSON text, as RuleConfig.load() refuses them: keys, types, bounds, and the one relation.

    Values are never clamped; a whole number is no Boolean and no fraction. Null counts as no object.
    """
    def problems(v: Column, keys: Column) -> Column:
        get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
        kind = lambda name: F.schema_of_variant(get(name, "variant"))
        known = [f.name for f in fields(RuleConfig)]
        tests = [(F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0, "unknown_settings")]
        for name, (low, high) in BOUNDS.items():
            fraction = name == "cvss_priority_threshold"
            number = kind(name).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)" if fraction else r"^BIGINT$")
            good = F.coalesce(number & get(name, "double").between(low, high), F.lit(False))
            tests.append((F.array_contains(keys, name) & ~good, f"bad_{name}"))
        conditions = F.coalesce((kind("identity_conditions") == "STRING") & get("identity_conditions", "string").isin("any", "both"), F.lit(False))
        tests.append((F.array_contains(keys, "identity_conditions") & ~conditions, "bad_identity_conditions"))
        files = lambda name: F.coalesce(get(name, "double"), F.lit(float(getattr(RuleConfig, name))))
        tests.append((files("sensitive_file_minimum") > files("distinct_file_threshold"), "minimum_exceeds_threshold"))
        return F.when(F.coalesce(keys.isNull(), F.lit(True)), F.array(F.lit("not_an_object"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in tests])))

    # The one element's fields are bound, so that the text is parsed once, not for each test.
    parsed = F.array(F.struct(F.try_parse_json(body).alias("v"), F.json_object_keys(body).alias("keys")))
    return F.get(F.transform(parsed, lambda x: problems(x.v, x["keys"])), F.lit(0))
