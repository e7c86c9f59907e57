"""Registered queries over the import path: scans, profiles, row checks, provenance and the scalar functions they use."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..config import RuleConfig
from ..functions import scalars as s
from ..operators import clean, posture, rules
from ..sources import idp, ingest, records, sinks, strict
from ..sources.profiles import Profile, built_in
from . import adapters as t
from . import landing
from .registry import _twice, joined, query, table

KEY = b"a key for tests and comparison only"
_INNER, _OUTER = (bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


def hmac_sql(message: str) -> str:
    """HMAC-SHA256 of a blob under KEY, for the comparison engine."""
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || {message})))"


def pick(c: Column, n: int, *values: object) -> Column:
    """The value at the remainder of c by n."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        out = out.when(c % n == i, F.lit(v))
    return out


def _stamp(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


# --- scans

_NOTES = "CASE s_suppkey % 4 WHEN 0 THEN concat('a;\"b\"', chr(10), s_name) WHEN 1 THEN NULL WHEN 2 THEN '保守' ELSE s_name END"


@query("src01_csv_scan", f"SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, {_NOTES} AS note FROM supplier")
def src01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.expr(_NOTES.replace("chr(10)", "'\\n'").replace('\\"', '"')).alias("note"))
    profile = Profile.load({"profile_version": 1, "name": "notes", "format": "csv", "record": "file_access", "delimiter": ";", "map": {"at": {"field": "x"}, "actor": {"field": "x"}, "session": {"field": "x"}, "asset_id": {"field": "x"}, "file_id": {"field": "x"}}})
    found, _ = ingest.scan(spark, landing.csv(rows, ";"), profile)
    return found.select(*[F.col("_v")[c].alias(c) for c in ("s_suppkey", "s_name", "note")])


@F.pandas_udf(BinaryType())
def _cp932(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t.encode("cp932"))


def _quoted(*columns: str) -> Column:
    """A record of fields in double quotes."""
    return F.concat_ws("|", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def _mixed_files(spark: SparkSession, sf_dir: str) -> str:
    """Suppliers as files of a hundred keys at most, in Shift_JIS below a line of their own: files of even numbers have their
    columns in another order, and one more."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.expr(_NOTES.replace("chr(10)", "'\\n'").replace('\\"', '"')).alias("note"), F.lit("ソ|表").alias("more"))
    numbered = rows.withColumn("f", F.expr("s_suppkey div 100"))
    even = F.col("f") % 2 == 0
    line = F.when(even, _quoted("note", "more", "s_suppkey", "s_name")).otherwise(_quoted("s_suppkey", "s_name", "note"))
    head = F.when(even, F.lit("note|more|s_suppkey|s_name")).otherwise(F.lit("s_suppkey|s_name|note"))
    files = numbered.groupBy("f").agg(F.concat_ws("\n", F.lit('一覧 "'), F.first(head), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))  # a hundred rows a file
    path = landing.folder(spark)
    files.select("f", _cp932("text").cast("string").alias("value")).write.partitionBy("f").text(path)
    return f"{path}/f=*"


@query("src17_files_of_other_headers", f"SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, {_NOTES} AS note, CASE WHEN s_suppkey // 100 % 2 = 0 THEN 'ソ|表' END AS more FROM supplier")
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose columns differ in order and number, in another encoding, with line breaks and delimiters in quotes."""
    found = records.delimited(spark, _mixed_files(spark, sf_dir), "cp932", "|", 1)
    return found.select(*[F.col("_v")[c].alias(c) for c in ("s_suppkey", "s_name", "note", "more")])


@query("src18_file_digests", "SELECT concat('f=', CAST(s_suppkey // 100 AS VARCHAR)) AS folder, sha256(string_agg(concat(s_suppkey, ',', s_name), chr(10) ORDER BY s_suppkey) || chr(10)) AS sha256 FROM supplier GROUP BY 1")
def src18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files of lines that are never one value."""
    rows = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 100").alias("f"), F.struct("s_suppkey", F.concat_ws(",", "s_suppkey", "s_name").alias("line")).alias("x"))
    texts = rows.groupBy("f").agg(F.array_join(F.array_sort(F.collect_list("x"))["line"], "\n").alias("value"))  # a hundred rows a file
    path = landing.folder(spark)
    texts.write.partitionBy("f").text(path)
    return records.file_digests(spark, f"{path}/f=*", 0).select(F.element_at(F.split("file", "/"), -2).alias("folder"), "sha256")


_LINES = "case event_id % 2000 when 3 then 'long' else case event_id % 10 when 0 then 'broken' when 1 then 'list' when 2 then 'blank' else 'good' end end"


def _jsonl(spark: SparkSession, sf_dir: str) -> str:
    kind = F.expr(_LINES)
    line = F.when(kind == "long", F.concat(F.lit('{"pad": "'), F.repeat(F.lit("x"), ingest.LINE_BYTES), F.lit('"}'))).when(kind == "broken", '{"cut": ').when(kind == "list", "[1, 2]").when(kind == "blank", "  ").otherwise(F.to_json(F.struct(F.struct("user_id").alias("u"), "event_id")))
    return landing.lines(t.events(spark, sf_dir), line)


_FILE_PROFILE = built_in("generic-file-access-jsonl")


@query("src02_jsonl_scan", t.with_tables("ev", sql=f"SELECT CASE kind WHEN 'long' THEN 'line_too_long' WHEN 'broken' THEN 'not_json' WHEN 'list' THEN 'not_an_object' ELSE 'read' END AS reason, count(*) AS n FROM (SELECT {_LINES} AS kind FROM ev) WHERE kind <> 'blank' GROUP BY 1"))
def src02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, skipped = ingest.scan(spark, _jsonl(spark, sf_dir), _FILE_PROFILE)
    return skipped.groupBy("reason").agg(F.sum("n").alias("n")).unionAll(rows.agg(F.lit("read").alias("reason"), F.count("*").alias("n")))


@query("fn07_dotted_paths", t.with_tables("ev", sql=f"SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS missing FROM ev WHERE {_LINES} = 'good'"))
def fn07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ingest.scan(spark, _jsonl(spark, sf_dir), _FILE_PROFILE)
    look = ingest._lookup(_FILE_PROFILE)
    return rows.select(look("event_id").cast("long").alias("event_id"), look("u.user_id").alias("user_id"), look("u.none.deeper").alias("missing"))


_BODIES = "CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'missing_keys' WHEN 2 THEN 'unknown_keys' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'not_an_object' ELSE 'not_an_object' END"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot document for each supplier: good, or with one of five faults."""
    a = t.assets(spark, sf_dir).select(F.struct("id", "kind", "patch_state", F.col("observed_at").cast("string").alias("observed_at"), "internet_exposed", "privileged_path", "sensitive_path", "vulnerability").alias("a"), F.substring("id", 4, 20).cast("long").alias("k"))
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("2024-01-01T00:00:00Z").alias("as_of"), F.array("a").alias("assets"), F.array().alias("events")), {"ignoreNullFields": "false"})
    k = F.col("k") % 6
    return a.select("k", F.when(k == 1, F.regexp_replace(body, '"schema_version":1,', "")).when(k == 2, F.regexp_replace(body, r"^\{", '{"extra":1,')).when(k == 3, F.regexp_replace(body, r"^\{", '{"as_of":"x",')).when(k == 4, F.regexp_replace(body, '"schema_version":1', '"schema_version":NaN')).when(k == 5, F.substring(body, 1, 40)).otherwise(body).alias("body"))


@query("src03_snapshot_documents", f"SELECT s_suppkey, {_BODIES} AS problems FROM supplier")
def src03(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing.lines(_snapshots(spark, sf_dir), F.to_json(F.struct("k", "body")))
    docs = spark.read.schema("k long, body string").json(path)
    return joined(docs.select(F.col("k").alias("s_suppkey"), strict.key_problems(F.col("body"), *strict.SNAPSHOT_KEYS).alias("problems")))


@query("val12_strict_assets", t.with_tables("assets", sql="SELECT id, kind, patch_state, internet_exposed, reference, cvss FROM assets WHERE CAST(substr(id, 4) AS BIGINT) % 6 = 0"))
def val12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _snapshots(spark, sf_dir).withColumn("source", F.col("k").cast("string")).withColumn("problems", strict.key_problems(F.col("body"), *strict.SNAPSHOT_KEYS))
    rows = strict.snapshot_assets(strict.strict(docs.where(F.size("problems") == 0)))
    return rows.select("id", "kind", "patch_state", "internet_exposed", "vulnerability.reference", "vulnerability.cvss")


# --- profiles


def _typed(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def _parsed(spark: SparkSession, path: str, profile: Profile) -> ingest.Parsed:
    return ingest.parse(ingest.scan(spark, path, profile)[0], profile)


def _asset_log(spark: SparkSession, sf_dir: str) -> str:
    k = F.col("s_suppkey")
    at = F.lit(t.AS_OF) - k * 3600
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("as-"), k.cast("string")).alias("asset_id"),
        pick(k, 6, "vpn", "Firewall", "fileserver", "saas", "PC", "toaster").alias("type"),
        F.when(k % 17 == 0, None).when(k % 2 == 0, _stamp(at)).otherwise(F.concat(_stamp(at), F.lit("Z"))).alias("observed_at"),
        pick(k, 5, "pending", "適用済", "N/A", "??").alias("patch"),
        pick(k, 4, "YES", "公開", "no", "maybe").alias("exposed"),
        pick(k, 3, "あり", "なし").alias("admin_path"),
        pick(k, 2, "1", "0").alias("sensitive_path"),
        F.when(k % 7 > 0, F.concat(F.lit("CVE-2025-"), k.cast("string"))).alias("advisory"),
        pick(k, 4, "7.5", "11", "abc", "1e400").alias("cvss"),
        pick(k, 3, "1", "no", "x").alias("kev"),
    )
    return landing.csv(rows)


_ASSET_SQL = f"""SELECT concat('as-', CAST(s_suppkey AS VARCHAR)) AS id, CASE s_suppkey % 6 WHEN 0 THEN 'vpn' WHEN 1 THEN 'vpn' WHEN 2 THEN 'server' WHEN 3 THEN 'saas' WHEN 4 THEN 'endpoint' ELSE 'unknown' END AS kind,
    {t.AS_OF} - s_suppkey * 3600 - CASE s_suppkey % 2 WHEN 0 THEN 32400 ELSE 0 END AS observed_at,
    CASE s_suppkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'applied' WHEN 2 THEN 'not_applicable' ELSE 'unknown' END AS patch_state,
    CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS internet_exposed, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS privileged_path, s_suppkey % 2 = 0 AS sensitive_path,
    CASE WHEN s_suppkey % 7 > 0 THEN concat('CVE-2025-', CAST(s_suppkey AS VARCHAR)) END AS reference, CASE WHEN s_suppkey % 7 > 0 AND s_suppkey % 4 = 0 THEN 7.5 END::DOUBLE AS cvss, CASE WHEN s_suppkey % 7 > 0 THEN CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS known_exploited
    FROM supplier WHERE s_suppkey % 17 <> 0"""


@query("src04_asset_profile", _ASSET_SQL)
def src04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.nested_vulnerability(_parsed(spark, _asset_log(spark, sf_dir), built_in("generic-asset-csv")).rows)
    v = F.col("vulnerability")
    return _typed(rows).withColumns({c: v[c] for c in ("reference", "cvss", "known_exploited")}).drop("vulnerability")


@query("fn26_nested_vulnerability", "SELECT concat('as-', CAST(s_suppkey AS VARCHAR)) AS id, s_suppkey % 7 > 0 AS present FROM supplier WHERE s_suppkey % 17 <> 0")
def fn26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.nested_vulnerability(_parsed(spark, _asset_log(spark, sf_dir), built_in("generic-asset-csv")).rows)
    return rows.select("id", F.col("vulnerability").isNotNull().alias("present"))


def _auth_log(spark: SparkSession, sf_dir: str) -> str:
    e = t.events(spark, sf_dir).where("event_type in ('signup', 'error')")
    k = F.col("k")
    rows = e.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("event_id"),
        F.when(k % 2 == 0, _stamp(F.col("at"))).otherwise(F.concat(_stamp(F.col("at")), F.lit("+00:00"))).alias("timestamp"),
        F.when(k % 13 > 0, F.concat(F.lit(" u"), F.col("user_id").cast("string"))).alias("user"),
        F.concat(F.lit("s"), k.cast("string")).alias("session_id"),
        F.when(k % 3 == 0, "VPN gate #1").otherwise("vpn-2").alias("gateway"),
        pick(k, 5, "Success", "成功", "REJECT", "denied", "huh").alias("result"),
        pick(k, 4, "Admin", "保守", "user").alias("account_type"),
        pick(k, 3, "managed", "非管理端末", "x").alias("device_state"),
        pick(k, 4, "see chg-12", "none", "-", "maybe").alias("change_ticket"),
    )
    return landing.csv(rows)


_AUTH = "ev WHERE event_type IN ('signup', 'error')"
_AUTH_SQL = f"""SELECT concat('ev-', CAST(event_id AS VARCHAR)) AS id, at - CASE k % 2 WHEN 0 THEN 32400 ELSE 0 END AS at, concat('u', CAST(user_id AS VARCHAR)) AS actor, concat('s', CAST(k AS VARCHAR)) AS session,
    CASE WHEN k % 3 = 0 THEN concat('VPN-gate-1:', substr(sha256('VPN gate #1'), 1, 16)) ELSE 'vpn-2' END AS gateway_id, k % 5 < 2 AS success, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS privileged,
    CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS device_trusted, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS approved FROM {_AUTH} AND k % 5 < 4 AND k % 13 > 0"""


@query("src05_auth_profile", t.with_tables("ev", sql=_AUTH_SQL))
def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(_parsed(spark, _auth_log(spark, sf_dir), built_in("generic-auth-csv")).rows)


@query("val02_skipped_rows", t.with_tables("ev", sql=f"SELECT CASE WHEN k % 13 = 0 THEN 'missing_actor' ELSE 'missing_success' END AS reason, count(*) AS n FROM {_AUTH} AND (k % 13 = 0 OR k % 5 = 4) GROUP BY 1"))
def val02(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = _parsed(spark, _auth_log(spark, sf_dir), built_in("generic-auth-csv")).skipped
    return skipped.groupBy("reason").agg(F.sum("n").alias("n"))


@query("agg01_import_counters", t.with_tables("ev", sql=f"SELECT 'read' AS counter, count(*) AS n FROM {_AUTH} UNION ALL SELECT 'imported', count(*) FILTER (WHERE k % 13 > 0 AND k % 5 < 4) FROM {_AUTH} UNION ALL SELECT 'skipped', count(*) FILTER (WHERE k % 13 = 0 OR k % 5 = 4) FROM {_AUTH} UNION ALL SELECT 'unknown_privileged', count(*) FILTER (WHERE k % 13 > 0 AND k % 5 < 4 AND k % 4 = 3) FROM {_AUTH} UNION ALL SELECT 'normalized_gateway_id', count(*) FILTER (WHERE k % 13 > 0 AND k % 5 < 4 AND k % 3 = 0) FROM {_AUTH}"))
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, _auth_log(spark, sf_dir), built_in("generic-auth-csv"))
    q = ingest.quality([p]).agg(F.sum("rows_read").alias("read"), F.sum("rows_imported").alias("imported"), F.sum("rows_skipped").alias("skipped"))
    rows = q.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in ("read", "imported", "skipped")])).alias("x")).select("x.*")
    unknown = p.unknown.where("column = 'privileged'").agg(F.lit("unknown_privileged").alias("counter"), F.sum("n").alias("n"))
    changed = ingest.normalized_identifiers(p.rows, "gateway_id").select(F.lit("normalized_gateway_id").alias("counter"), "n")
    return rows.unionAll(unknown).unionAll(changed)


@query("agg02_import_warnings", t.with_tables("ev", sql=f"SELECT unnest(['no_asset_source', 'no_file_access_source', 'unregistered_assets', 'many_rows_skipped', 'newest_event_is_old', 'authenticity_not_verified']) AS warning FROM (SELECT count(*) AS n FROM {_AUTH} AND (k % 13 = 0 OR k % 5 = 4)) x WHERE n > 0"))
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, _auth_log(spark, sf_dir), built_in("generic-auth-csv"))
    facts = p.rows.agg(F.count_distinct("gateway_id").alias("shadows"), F.lit(0).alias("conflicts"), F.lit(0).alias("future_rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), (F.max("at") + 86401).alias("as_of"))
    return ingest.warnings(ingest.quality([p]), facts)


@query("cln05_identifier_collisions", t.with_tables("ev", sql=f"SELECT CASE WHEN k % 3 = 0 THEN concat('VPN-gate-1:', substr(sha256('VPN gate #1'), 1, 16)) ELSE 'vpn-2' END AS id, 2 AS names FROM {_AUTH} AND k % 5 < 4 AND k % 13 > 0 AND k % 3 > 0 GROUP BY ALL"))
def cln05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, _auth_log(spark, sf_dir), built_in("generic-auth-csv")).rows
    other = F.when((F.col("gateway_id") == "vpn-2") & (F.substring("id", 4, 20).cast("long") % 2 == 0), "VPN-2 ").otherwise(F.col("_raw_gateway_id"))
    return ingest.identifier_collisions(rows.withColumn("_raw_gateway_id", other), "gateway_id")


def _access_log(spark: SparkSession, sf_dir: str) -> str:
    e = t.events(spark, sf_dir).where("event_type in ('view', 'click')")
    k = F.col("k")
    line = F.to_json(F.struct((F.col("at") * 1000 + 999).alias("ts"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id")).alias("user"), F.concat(F.lit("s"), k.cast("string")).alias("session"), F.concat(F.lit("host-"), (k % 3).cast("string")).alias("host"), F.when(k % 11 > 0, F.concat(F.lit("/data/f"), k.cast("string"))).alias("path"), pick(k, 3, "Confidential", "公開").alias("label"), F.floor(F.col("value") * 100).alias("bytes")))
    return landing.lines(e, line)


_ACCESS = "SELECT concat('u', CAST(user_id AS VARCHAR)) AS actor, concat('host-', CAST(k % 3 AS VARCHAR)) AS asset_id, at, CAST(floor(value * 100) AS BIGINT) AS bytes_read, concat('/data/f', CAST(k AS VARCHAR)) AS file_id, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sensitive, concat('s', CAST(k AS VARCHAR)) AS session FROM ev WHERE event_type IN ('view', 'click') AND k % 11 > 0"
_ACCESS_ID = "concat('fa-', substr(sha256(CAST(to_json(struct_pack(actor := actor, asset_id := asset_id, at := at, bytes_read := bytes_read, file_id := file_id, sensitive := sensitive, session := session)) AS VARCHAR)), 1, 24))"


@query("src06_file_access_profile", t.with_tables("ev", sql=f"SELECT * FROM ({_ACCESS})"))
def src06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(_parsed(spark, _access_log(spark, sf_dir), _FILE_PROFILE).rows).drop("id")


@query("fn09_content_ids", t.with_tables("ev", sql=f"SELECT {_ACCESS_ID} AS id, count(*) AS n FROM ({_ACCESS}) GROUP BY 1"))
def fn09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, _access_log(spark, sf_dir), _FILE_PROFILE).rows.groupBy("id").agg(F.count("*").alias("n"))


@query("fn12_canonical_json", "SELECT p_partkey, CAST(to_json(struct_pack(a := p_brand, b := CASE WHEN p_partkey % 3 > 0 THEN p_size END, c := p_name || ' é/\"', d := p_partkey % 2 = 0)) AS VARCHAR) AS body FROM part")
def fn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", s.canonical(d=k % 2 == 0, a=F.col("p_brand"), c=F.concat("p_name", F.lit(' é/"')), b=F.when(k % 3 > 0, F.col("p_size"))).alias("body"))


@query("src10_provenance", t.with_tables("ev", sql="SELECT CAST(count(*) AS BIGINT) AS rows_read, count(*) FILTER (WHERE k % 11 > 0) AS rows_imported, 64 AS digest_length, 'file-import' AS connector, true AS verified FROM ev WHERE event_type IN ('view', 'click')"))
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _access_log(spark, sf_dir)
    p = ingest.provenance(spark, f"{path}/part-*", _parsed(spark, path, _FILE_PROFILE))
    return p.groupBy("connector").agg(F.sum("rows_read").alias("rows_read"), F.sum("rows_imported").alias("rows_imported"), F.max(F.length("sha256")).alias("digest_length"), F.bool_and("verified").alias("verified"))


def _provider_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, line) of an identity provider's log."""
    k, n = F.col("k"), F.col("event_id").cast("string")
    uuid = F.when(k % 7 == 0, F.concat(F.lit("no identifier "), n)).otherwise(F.concat(F.lit("uuid-"), n))
    at = F.concat(F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 9 > 0, F.lit(".250Z")).otherwise(""))
    line = F.concat(F.lit('{"uuid":"'), uuid, F.lit('","eventType":"'), pick(k, 5, "user.session.start", "user.session.start", "user.session.start", "user.session.start", "user.session.end"), F.lit('","published":"'), at, F.lit('","actor":{"alternateId":"u'), F.col("user_id").cast("string"), F.lit('"},"authenticationContext":{"externalSessionId":"s'), k.cast("string"), F.lit('"},"outcome":{"result":"'), pick(k, 3, "SUCCESS", "FAILURE", "ALLOW"), F.lit('"}}'))
    return t.events(spark, sf_dir).where("event_type in ('signup', 'error')").select("k", line.alias("line"))


_PROVIDER = f"SELECT *, concat('{{\"uuid\":\"', CASE WHEN k % 7 = 0 THEN 'no identifier ' ELSE 'uuid-' END, CAST(event_id AS VARCHAR), '\",\"eventType\":\"', CASE k % 5 WHEN 4 THEN 'user.session.end' ELSE 'user.session.start' END, '\",\"published\":\"', strftime(make_timestamp(at * 1000000), '%Y-%m-%dT%H:%M:%S'), CASE WHEN k % 9 > 0 THEN '.250Z' ELSE '' END, '\",\"actor\":{{\"alternateId\":\"u', CAST(user_id AS VARCHAR), '\"}},\"authenticationContext\":{{\"externalSessionId\":\"s', CAST(k AS VARCHAR), '\"}},\"outcome\":{{\"result\":\"', CASE k % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILURE' ELSE 'ALLOW' END, '\"}}}}') AS line FROM {_AUTH}"


@query("src07_provider_profile", t.with_tables("ev", sql=f"SELECT CASE WHEN k % 7 = 0 THEN concat('no-identifier-', CAST(event_id AS VARCHAR), ':', substr(sha256(concat('no identifier ', CAST(event_id AS VARCHAR))), 1, 16)) ELSE concat('uuid-', CAST(event_id AS VARCHAR)) END AS id, at, concat('u', CAST(user_id AS VARCHAR)) AS actor, concat('s', CAST(k AS VARCHAR)) AS session, 'okta-idp' AS gateway_id, k % 3 = 0 AS success FROM {_AUTH} AND k % 3 < 2 AND k % 9 > 0"))
def src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing.lines(_provider_log(spark, sf_dir), F.col("line"))
    return _typed(_parsed(spark, path, built_in("okta-system-log-jsonl")).rows).drop("privileged", "device_trusted", "approved")


@query("src08_windows_profile", t.with_tables("ev", sql=f"SELECT at - 32400 AS at, concat('u', CAST(user_id AS VARCHAR)) AS actor, concat('0x', CAST(k AS VARCHAR)) AS session, concat('WS-', CAST(k % 4 AS VARCHAR)) AS gateway_id, k % 3 = 0 AS success FROM {_AUTH} AND k % 3 < 2"))
def src08(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = t.events(spark, sf_dir).where("event_type in ('signup', 'error')").select(_stamp(F.col("at")).alias("TimeCreated"), pick(k, 3, "4624", "4625", "4634").alias("EventID"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("TargetUserName"), F.concat(F.lit("0x"), k.cast("string")).alias("TargetLogonId"), F.concat(F.lit("WS-"), (k % 4).cast("string")).alias("WorkstationName"))
    return _typed(_parsed(spark, landing.csv(rows), built_in("windows-security-logon-csv")).rows).select("at", "actor", "session", "gateway_id", "success")


@query("src09_own_profile", "SELECT concat('o-', CAST(o_orderkey AS VARCHAR)) AS id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS at, concat('c', CAST(o_custkey AS VARCHAR)) AS actor, 'batch' AS session, 'lake' AS asset_id, CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE concat('f', CAST(o_orderkey AS VARCHAR)) END AS file_id, CASE WHEN contains(o_orderpriority, 'URGENT') THEN true WHEN contains(o_orderpriority, 'LOW') THEN false END AS sensitive, CASE WHEN o_orderkey % 5 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS bytes_read FROM orders")
def src09(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = Profile.load({"profile_version": 1, "name": "orders", "format": "csv", "record": "file_access", "delimiter": "|", "map": {"id": {"field": "key"}, "at": {"field": "ts", "time": "epoch_seconds"}, "actor": {"field": "who"}, "session": {"const": "batch"}, "asset_id": {"const": "lake"}, "file_id": {"field": "file", "default": "none"}, "sensitive": {"field": "priority", "true_contains": ["urgent"], "false_contains": ["low"]}, "bytes_read": {"field": "bytes"}}})
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("o-"), k.cast("string")).alias("key"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("who"), F.when(k % 4 > 0, F.concat(F.lit("f"), k.cast("string"))).alias("file"), F.col("o_orderpriority").alias("priority"), F.when(k % 5 > 0, F.col("o_totalprice")).otherwise(-1.0).alias("bytes"))
    return _typed(_parsed(spark, landing.csv(rows, "|"), profile).rows)


@query("src11_provider_logins", t.with_tables("ev", more={"log": _PROVIDER}, sql="SELECT CASE WHEN k % 7 = 0 THEN concat('okta-', substr(sha256(line), 1, 24)) ELSE concat('uuid-', CAST(event_id AS VARCHAR)) END AS id, at, concat('u', CAST(user_id AS VARCHAR)) AS actor, concat('s', CAST(k AS VARCHAR)) AS session, k % 3 = 0 AS success FROM log WHERE k % 5 < 4 AND k % 9 > 0 AND k % 3 < 2"))
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _provider_log(spark, sf_dir).select(F.lit("a").alias("_source"), F.lit(0).cast("long").alias("_row"), "line")
    return idp.session_logins(lines)[0].select("id", "at", "actor", "session", "success")


@query("src12_merged_logins", t.with_tables("logins", more={"both_": "SELECT id, at, actor, 0 AS r FROM logins UNION ALL SELECT id, at + CASE WHEN CAST(substr(id, 4) AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END, actor, 1 FROM logins WHERE CAST(substr(id, 4) AS BIGINT) % 3 = 0"}, sql="SELECT concat(id, CASE WHEN r = 1 THEN ':' ELSE '' END) AS id_head, at FROM both_ WHERE at <= 1705500000 + 300 QUALIFY row_number() OVER (PARTITION BY id, at ORDER BY r) = 1"))
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t.logins(spark, sf_dir).withColumn("_source", F.lit("file")).withColumn("_row", F.col("at"))
    n = F.substring("id", 4, 20).cast("long")
    again = files.where(n % 3 == 0).withColumn("at", F.col("at") + F.when(n % 10 == 0, 1).otherwise(0)).withColumn("_source", F.lit("idp"))
    out = idp.merged(files, again, 1_705_500_000)
    return out.select(F.regexp_replace("id", ":[0-9a-f]{16}$", ":").alias("id_head"), "at")


@query("src13_device_status", "SELECT concat('d-', p_brand) AS id, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE concat('7.', CAST(p_size AS VARCHAR)) END AS version, CAST(NULL AS BOOLEAN) AS internet_exposed FROM part WHERE p_brand = 'Brand#2' AND p_partkey % 3 > 0 AND p_partkey % 4 > 0")
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    status = table(spark, sf_dir, "part").where("p_brand = 'Brand#2'").select(F.when(k % 3 > 0, "success").otherwise("error").alias("status"), F.when(k % 4 > 0, "GET").otherwise("POST").alias("http_method"), F.when(k % 5 == 0, "vBuild7").otherwise(F.concat(F.lit("v7."), F.col("p_size").cast("string"))).alias("version"))
    return posture.device_inventory(status, "d-Brand#2").select("id", "version", "internet_exposed")


@query("src14_exploited_feed", t.with_tables("advisories", sql="SELECT cve, count(*) AS n FROM advisories GROUP BY cve"))
def src14(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = t.advisories(spark, sf_dir).select(F.lit("2024-01-01").alias("dateReleased"), F.array(F.struct(F.col("cve").alias("cveID"))).alias("vulnerabilities"))
    path = landing.lines(feed, F.to_json(F.struct("*")))
    raw = spark.read.schema("dateReleased string, vulnerabilities array<struct<cveID:string>>").json(path)
    return posture.kev_entries(raw).groupBy("cve").agg(F.count("*").alias("n"))


# --- sinks


@query("snk01_snapshot_files", t.with_tables("reads", "logins", sql="SELECT 'reads' AS frame, id, at FROM reads UNION ALL SELECT 'logins', id, at FROM logins"))
def snk01(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing.folder(spark)
    sinks.write_snapshot({"reads": t.file_access(spark, sf_dir), "logins": t.logins(spark, sf_dir)}, path, "json")
    back = [spark.read.schema("id string, at long").json(f"{path}/{name}").select(F.lit(name).alias("frame"), "id", "at") for name in ("reads", "logins")]
    return back[0].unionAll(back[1])


_BODY = "CAST(to_json(struct_pack(actor := actor, asset_id := asset_id, at := at, bytes_read := bytes_read, file_id := file_id, id := id, sensitive := sensitive, session := session)) AS VARCHAR)"
_SUMS = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS UBIGINT)) AS VARCHAR)" for i in range(8))


@query("snk05_snapshot_id", t.with_tables("reads", sql=f"SELECT concat('S-', substr(sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {_SUMS})), 1, 24)) AS snapshot_id FROM (SELECT sha256({_BODY}) AS h FROM reads)"))
def snk05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.fingerprint(t.file_access(spark, sf_dir))


# --- scalar functions

_TEXTS = "case o_orderkey % 6 when 0 then null when 1 then '' when 2 then ' \t ' when 3 then concat('  ', o_orderpriority) when 4 then concat(o_orderpriority, ' ') else o_orderpriority end"


@query("fn01_text", f"SELECT o_orderkey, nullif(trim({_TEXTS}, ' ' || chr(9)), '') AS value FROM orders")
def fn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", s.text(F.expr(_TEXTS)).alias("value"))


@query("fn03_times", t.with_tables("ev", sql="SELECT event_id, at AS zoned, CAST(NULL AS BIGINT) AS naive, at - 32400 AS declared, at AS seconds, at AS millis, at - 7200 AS pattern FROM ev"))
def fn03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = t.events(spark, sf_dir), F.col("at")
    iso = F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss")
    return e.select("event_id", s.epoch(F.concat(iso, F.lit(".75Z"))).alias("zoned"), s.epoch(iso).alias("naive"), s.epoch(iso, zone="+09:00").alias("declared"), s.epoch(at.cast("string"), "epoch_seconds").alias("seconds"), s.epoch((at * 1000 + 1).cast("string"), "epoch_millis").alias("millis"), s.epoch(F.date_format(F.timestamp_seconds(at), "dd/MM/yyyy HH:mm:ss '+0200'"), "%d/%m/%Y %H:%M:%S %z").alias("pattern"))


@query("fn27_inventory_times", t.with_tables("ev", sql="SELECT event_id, CASE WHEN k % 2 = 0 THEN at END AS at FROM ev"))
def fn27(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.concat(F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("k") % 2 == 0, "+00:00").otherwise(""))
    return t.events(spark, sf_dir).select("event_id", s.epoch(iso).alias("at"))


_NUMBERS = "case o_orderkey % 6 when 0 then 'nan' when 1 then '1e400' when 2 then ' 3.5 ' when 3 then 'x1' when 4 then '-2' else cast(o_orderkey as varchar(20)) end"


@query("fn04_finite_numbers", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 3.5 WHEN 4 THEN -2.0 WHEN 5 THEN CAST(o_orderkey AS DOUBLE) END::DOUBLE AS value FROM orders")
def fn04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", s.finite(F.expr(_NUMBERS.replace("varchar(20)", "string"))).alias("value"))


@query("fn05_bounded_numbers", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 3 WHEN 5 THEN CASE WHEN o_orderkey <= 1000 THEN o_orderkey END END AS whole, CASE o_orderkey % 6 WHEN 2 THEN 3.5 WHEN 5 THEN CASE WHEN o_orderkey <= 10 THEN CAST(o_orderkey AS DOUBLE) END END::DOUBLE AS number FROM orders")
def fn05(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr(_NUMBERS.replace("varchar(20)", "string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.bounded_long(n, 0, 1000).alias("whole"), s.bounded_double(n, 0, 10).alias("number"))


@query("fn06_mapped_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS mapped, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS unmapped FROM orders")
def fn06(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"f": "done", "O": "open"}
    return table(spark, sf_dir, "orders").select("o_orderkey", s.mapped(F.col("o_orderstatus"), words, "other").alias("mapped"), s.mapped(F.col("o_orderstatus"), words).alias("unmapped"))


@query("fn10_pseudonyms", f"SELECT c_custkey, concat('actor-', substr({hmac_sql(chr(39) + 'actor' + chr(39) + '::BLOB || unhex(' + chr(39) + '00' + chr(39) + ') || encode(c_name)')}, 1, 24)) AS pseudonym FROM customer")
def fn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", s.pseudonym(F.col("c_name"), KEY, "actor").alias("pseudonym"))


@query("fn11_opaque_tokens", f"SELECT c_custkey, {hmac_sql('encode(concat(' + chr(39) + 'org' + chr(39) + ', CAST(c_custkey % 3 AS VARCHAR), ' + chr(39) + ':actor' + chr(39) + ')) || unhex(' + chr(39) + '00' + chr(39) + ') || encode(c_name)')} AS token FROM customer")
def fn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat(F.lit("org"), (F.col("c_custkey") % 3).cast("string"), F.lit(":actor"))
    return table(spark, sf_dir, "customer").select("c_custkey", s.opaque_token(KEY, kind, F.col("c_name")).alias("token"))


@query("fn15_versions", "SELECT p_partkey, CASE WHEN p_partkey % 23 > 0 THEN concat_ws('.', CAST(p_size AS VARCHAR), CAST(p_partkey % 10 AS VARCHAR), '0', '0', '0', '0') END AS version, CASE WHEN p_partkey % 23 > 0 THEN p_size < 9 OR (p_size = 9 AND p_partkey % 10 < 5) END AS older FROM part")
def fn15(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = s.version(F.col("version"))
    return t.inventory(spark, sf_dir).select(F.substring("id", 3, 20).cast("long").alias("p_partkey"), F.array_join(v, ".").alias("version"), (v < s.version(F.lit("9.5"))).alias("older"))


# --- validation and cleaning


@query("val04_transfer_problems", t.with_tables("dlp", sql="SELECT event_id, concat_ws(',', CASE WHEN NOT (at BETWEEN 915148800 - 2592000 AND 915148800 + 60) THEN 'bad_at' END, CASE WHEN tenant = 'unknown' THEN 'bad_tenant' END, CASE WHEN bytes < 2000 THEN 'bad_bytes' END) AS problems FROM dlp"))
def val04(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = t.dlp(spark, sf_dir).withColumn("tenant", F.when(F.col("tenant") != "unknown", F.col("tenant"))).withColumn("bytes", F.when(F.col("bytes") < 2000, -F.col("bytes")).otherwise(F.col("bytes")))
    return joined(clean.dlp_problems(odd, 915_148_800).select("event_id", "problems"))


@query("val05_future_rows", t.with_tables("reads", sql="SELECT 'kept' AS part, count(*) FILTER (WHERE at <= 1705500300) AS n FROM reads UNION ALL SELECT concat('src', CAST(CAST(substr(id, 4) AS BIGINT) % 3 AS VARCHAR)), count(*) FROM reads WHERE at > 1705500300 GROUP BY 1"))
def val05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.file_access(spark, sf_dir).withColumn("_source", F.concat(F.lit("src"), (F.substring("id", 4, 20).cast("long") % 3).cast("string")))
    kept, late = clean.split_future(rows, 1_705_500_000)
    return kept.agg(F.lit("kept").alias("part"), F.count("*").alias("n")).unionAll(late.select("source", "n"))


@query("val06_provenance_problems", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'bad_label' END, CASE WHEN o_orderkey % 7 = 0 THEN 'bad_sha256' END, CASE WHEN o_orderkey % 4 > o_orderkey % 3 THEN 'bad_counts' END) AS problems FROM orders")
def val06(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 == 0, "a/b.csv").otherwise("a b.csv").alias("label"), F.when(k % 7 == 0, "00FF").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"), (k % 3).alias("rows_read"), (k % 4).alias("rows_imported"))
    return joined(clean.provenance_problems(rows).select("o_orderkey", "problems"))


_SETTINGS = '{"cvss_priority_threshold":6.5,"distinct_file_threshold":50,"identity_conditions":"both","login_lookback_seconds":1800,"sensitive_file_minimum":1,"stale_asset_hours":24,"window_seconds":300}'


@query("fn14_config_digest", t.with_tables("assets", sql=f"SELECT id AS asset_id, substr(sha256('{_SETTINGS}'), 1, 16) AS rule_config_digest, CASE WHEN internet_exposed IS TRUE AND (known_exploited IS TRUE OR (privileged_path IS TRUE AND sensitive_path IS TRUE)) THEN 'P1' WHEN internet_exposed IS TRUE OR coalesce(cvss, 0) >= 6.5 THEN 'P2' ELSE 'P3' END AS priority FROM assets WHERE patch_state = 'pending'"))
def fn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = RuleConfig.load({"cvss_priority_threshold": 6.5, "distinct_file_threshold": 50, "identity_conditions": "both"})
    return rules.exposure(t.assets(spark, sf_dir), config).select("asset_id", "rule_config_digest", "priority")


_SETTING_ROWS = """concat('{"window_seconds": ', case when p_partkey % 7 = 0 then '"300"' when p_partkey % 11 = 0 then 'true' when p_partkey % 5 = 0 then '300.0' else cast(p_size as varchar(9)) end,
 ', "distinct_file_threshold": ', p_size, ', "sensitive_file_minimum": ', p_partkey % 60, ', "cvss_priority_threshold": ', p_partkey % 13, '.5', case when p_partkey % 17 = 0 then ', "extra": 1' else '' end, ', "identity_conditions": ', case when p_partkey % 3 = 0 then '"some"' else '"both"' end, '}')"""


@query("val07_setting_problems", "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 17 = 0 THEN 'unknown_settings' END, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 5 = 0 OR p_size < 10 THEN 'bad_window_seconds' END, CASE WHEN p_size < 2 THEN 'bad_distinct_file_threshold' END, CASE WHEN p_partkey % 13 > 9 THEN 'bad_cvss_priority_threshold' END, CASE WHEN p_partkey % 3 = 0 THEN 'bad_identity_conditions' END, CASE WHEN p_partkey % 60 > p_size THEN 'minimum_exceeds_threshold' END) AS problems FROM part")
def val07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule settings as JSON documents, checked by type, bound and relation."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SETTING_ROWS.replace("varchar(9)", "string")).alias("body"))
    return joined(rows.select("p_partkey", strict.setting_problems(F.col("body")).alias("problems")))


@query("val08_label_problems", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'bad_event_ids' END, CASE WHEN o_orderkey % 4 = 0 THEN 'bad_asset_ids' END, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown_rules' END) AS problems FROM orders")
def val08(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    one = lambda bad, worse, fine: F.array(F.lit(fine), F.when(bad, F.lit(worse)).otherwise(F.lit(fine)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", one(k % 3 == 0, "-x", "ev-1").alias("malicious_event_ids"), F.when(k % 4 > 0, F.array(F.lit("as-1"))).alias("malicious_asset_ids"), one(k % 5 == 0, "AS-009", "AS-002").alias("expect_rules"))
    return joined(strict.label_problems(rows).select("o_orderkey", "problems"))


@query("val11_baseline_problems", "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'bad_actor' END, CASE WHEN c_custkey % 5 = 0 THEN 'repeated_actor' END, CASE WHEN c_custkey % 20 < 14 THEN 'bad_sample_count' END, CASE WHEN c_custkey % 20 >= 3 AND c_custkey % 3 = 0 THEN 'bad_sample' END) AS problems FROM customer")
def val11(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    samples = F.when(k % 20 > 0, F.transform(F.sequence(F.lit(1), F.greatest((k % 20).cast("int"), F.lit(1))), lambda i: F.when((i == 3) & (k % 3 == 0), F.lit(-1)).otherwise(i.cast("long")))).otherwise(F.array().cast("array<long>"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("org").alias("organization"), F.when(k % 5 > 0, F.col("c_name")).otherwise("").alias("actor"), samples.alias("samples"))
    return joined(clean.baseline_problems(rows).select("c_custkey", "problems"))


@query("cln03_conflicting_ids", t.with_tables("reads", sql="SELECT id, 2 AS bodies FROM reads WHERE CAST(substr(id, 4) AS BIGINT) % 30 = 0"))
def cln03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.conflicting_ids(_twice(spark, sf_dir))


def _stored(reads: DataFrame) -> DataFrame:
    n = F.substring("id", 4, 20).cast("long")
    return reads.where(n % 3 > 0).withColumn("file_id", F.when(n % 3 == 2, F.concat("file_id", F.lit("x"))).otherwise(F.col("file_id")))


_NEW = "CASE CAST(substr(id, 4) AS BIGINT) % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'repeat' ELSE 'conflict' END"


@query("cln07_new_events", t.with_tables("reads", sql=f"SELECT {_NEW} AS outcome, id FROM reads"))
def cln07(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = t.file_access(spark, sf_dir)
    fresh, repeats, conflicts = clean.new_events(reads.unionAll(reads.where("at % 2 = 0")), _stored(reads))
    return fresh.select(F.lit("fresh").alias("outcome"), "id").unionAll(repeats.select(F.lit("repeat"), "id")).unionAll(conflicts.select(F.lit("conflict"), "id"))


@query("srt01_canonical_order", t.with_tables("reads", "assets", sql="SELECT 'event' AS record, id FROM (SELECT * FROM reads ORDER BY at, id LIMIT 1000) UNION ALL SELECT 'asset', id FROM (SELECT * FROM assets ORDER BY id LIMIT 1000)"))
def srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand of each record, which shows the order."""
    first = [clean.in_order(df, record).limit(1000).select(F.lit(record).alias("record"), "id") for df, record in ((t.file_access(spark, sf_dir), "event"), (t.assets(spark, sf_dir), "asset"))]
    return first[0].unionAll(first[1])


@query("flt05_finding_by_id", t.with_tables("assets", sql="SELECT concat('asset:', id) AS id, kind FROM assets WHERE id = 'as-7'"))
def flt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.finding(t.assets(spark, sf_dir).select(F.concat(F.lit("asset:"), "id").alias("id"), "kind"), "asset:as-7")


@query("join01_with_shadows", t.with_tables("reads", "logins", "assets", sql=f"SELECT id, kind, patch_state, observed_at FROM assets UNION ALL SELECT DISTINCT id, 'unknown', 'unknown', {t.AS_OF} FROM (SELECT concat(gateway_id, 'x') AS id FROM logins UNION ALL SELECT asset_id FROM reads) WHERE id NOT IN (SELECT id FROM assets)"))
def shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = t.logins(spark, sf_dir).withColumn("gateway_id", F.concat("gateway_id", F.lit("x")))
    return clean.with_shadows(t.assets(spark, sf_dir), logins, t.file_access(spark, sf_dir), t.AS_OF).select("id", "kind", "patch_state", "observed_at")
