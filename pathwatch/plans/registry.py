"""Every registered query over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RuleConfig
from ..functions import scalars as s
from ..operators import audit, clean, content, correlate, evaluate, posture, rules
from . import adapters as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CONFIG = RuleConfig(window_seconds=t.WINDOW, distinct_file_threshold=t.THRESHOLD, login_lookback_seconds=t.LOOKBACK)
DIGEST = CONFIG.digest


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = re.sub(r"\bat\b", '"at"', sql)  # a reserved word there
        return f

    return add


def joined(df: DataFrame) -> DataFrame:
    """Arrays of strings as comma-joined text, for comparison by value."""
    return df.select(*[F.array_join(c, ",").alias(c) if k.startswith("array<string") else F.col(c) for c, k in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fid(rule: str, evidence: str) -> str:
    return f"concat('F-', substr(sha256(concat('[\"{rule}\",', CAST(to_json({evidence}) AS VARCHAR), ']')), 1, 14))"


FINDING = ["id", "rule", "rule_config_digest", "priority", "kind", "evidence_ids"]

# --- asset and login rules


@query(
    "det01_exposure",
    t.with_tables(
        "assets",
        sql=f"""SELECT {_fid('AS-001', "list_value(concat('asset:', id))")} AS id, id AS asset_id,
        CASE WHEN internet_exposed IS TRUE AND (known_exploited IS TRUE OR (privileged_path IS TRUE AND sensitive_path IS TRUE)) THEN 'P1'
             WHEN internet_exposed IS TRUE OR coalesce(cvss, 0) >= 7 THEN 'P2' ELSE 'P3' END AS priority,
        cvss, reference, '{DIGEST}' AS rule_config_digest,
        concat_ws(',', 'patch_not_applied', CASE WHEN reference IS NULL THEN 'no_vulnerability_reference' END,
          CASE WHEN internet_exposed IS TRUE THEN 'internet_exposed' END, CASE WHEN known_exploited IS TRUE THEN 'known_exploited' END,
          CASE WHEN privileged_path IS TRUE AND sensitive_path IS TRUE THEN 'path_to_privilege_and_data' END,
          CASE WHEN internet_exposed IS TRUE AND (known_exploited IS TRUE OR (privileged_path IS TRUE AND sensitive_path IS TRUE)) AND cvss < 7 THEN 'exposure_outweighs_cvss' END) AS reasons
        FROM assets WHERE patch_state = 'pending'""",
    ),
)
def det01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(rules.exposure(t.assets(spark, sf_dir), CONFIG).select("id", "asset_id", "priority", "cvss", "reference", "rule_config_digest", "reasons"))


@query(
    "det02_asset_coverage",
    t.with_tables("assets", sql=f"SELECT {_fid('AS-005', 'list_value(concat(' + chr(39) + 'asset:' + chr(39) + ', id))')} AS id, id AS asset_id, 'P2' AS priority FROM assets WHERE internet_exposed IS NULL OR privileged_path IS NULL OR sensitive_path IS NULL OR patch_state = 'unknown' OR {t.AS_OF} - observed_at > 86400"),
)
def det02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.asset_coverage(t.assets(spark, sf_dir), t.AS_OF, CONFIG).select("id", "asset_id", "priority")


_SUSPICIOUS = "privileged IS TRUE AND (device_trusted IS FALSE OR approved IS FALSE)"


@query("det03_identity", t.with_tables("logins", sql=f"SELECT {_fid('AS-002', 'list_value(id)')} AS id, actor, gateway_id, at, id AS evidence_ids FROM logins WHERE success AND {_SUSPICIOUS}"))
def det03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(rules.identity(t.logins(spark, sf_dir), CONFIG).select("id", "actor", "gateway_id", "at", "evidence_ids"))


#: Peaks by a self join with count(distinct), then the reads inside.
_BULK = {
    "counts": f"SELECT a.actor, a.session, a.asset_id, a.at, a.id, count(DISTINCT b.file_id) AS n FROM reads a JOIN reads b ON a.actor = b.actor AND a.session = b.session AND a.asset_id = b.asset_id AND b.at >= a.at - {t.WINDOW} AND (b.at, b.id) <= (a.at, a.id) GROUP BY ALL",
    "peaks": f"SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY actor, session, asset_id ORDER BY n DESC, at, id) = 1 AND n >= {t.THRESHOLD}",
    "bulk": f"SELECT p.actor, p.session, p.asset_id, p.at, p.n AS distinct_files, count(DISTINCT CASE WHEN r.sensitive IS TRUE THEN r.file_id END) AS sensitive_files, list(r.id ORDER BY r.at, r.id) AS e, min(r.at) AS window_start FROM peaks p JOIN reads r ON p.actor = r.actor AND p.session = r.session AND p.asset_id = r.asset_id AND r.at >= p.at - {t.WINDOW} AND (r.at, r.id) <= (p.at, p.id) GROUP BY ALL",
}
_LATEST = {
    "latest": f"SELECT b.*, l.id AS login_id, l.at AS login_at, l.gateway_id, l.privileged, l.device_trusted, l.approved FROM bulk b JOIN logins l ON b.actor = l.actor AND b.session = l.session AND l.success AND b.window_start - l.at BETWEEN 0 AND {t.LOOKBACK} QUALIFY row_number() OVER (PARTITION BY b.actor, b.session, b.asset_id ORDER BY l.at DESC, l.id) = 1"
}


@query("det04_bulk_access", t.with_tables("reads", more=_BULK, sql=f"SELECT {_fid('AS-003', 'e')} AS id, actor, session, asset_id, at, distinct_files, sensitive_files, array_to_string(e, ',') AS evidence_ids FROM bulk"))
def det04(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.bulk_access(rules.bulk_windows(t.file_access(spark, sf_dir), CONFIG), CONFIG)
    return joined(found.select("id", "actor", "session", "asset_id", "at", "distinct_files", "sensitive_files", "evidence_ids"))


@query("win01_window_peaks", t.with_tables("reads", more=_BULK, sql="SELECT actor, session, asset_id, at AS peak_at, id AS peak_id, n AS peak FROM peaks"))
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.window_peaks(t.file_access(spark, sf_dir), t.WINDOW, t.THRESHOLD)


@query("join04_latest_login", t.with_tables("reads", "logins", more=_BULK | _LATEST, sql="SELECT actor, session, asset_id, window_start, login_id, login_at, gateway_id FROM latest"))
def join04(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.latest_login(rules.bulk_windows(t.file_access(spark, sf_dir), CONFIG), t.logins(spark, sf_dir), t.LOOKBACK)
    return found.select("actor", "session", "asset_id", "window_start", "login_id", "login_at", "gateway_id")


_EXPOSED = {"exposed": "SELECT id FROM assets WHERE patch_state = 'pending' AND internet_exposed IS TRUE"}
_AS004 = f"SELECT {_fid('AS-004', 'list_concat([concat(' + chr(39) + 'asset:' + chr(39) + ', gateway_id), login_id], e)')} AS id, actor, session, asset_id, gateway_id, at, distinct_files, sensitive_files, concat_ws(',', concat('asset:', gateway_id), login_id, array_to_string(e, ',')) AS evidence_ids FROM latest WHERE {_SUSPICIOUS} AND sensitive_files >= 1 AND gateway_id IN (SELECT id FROM exposed)"


@query("det05_correlation", t.with_tables("reads", "logins", "assets", more=_BULK | _LATEST | _EXPOSED, sql=_AS004))
def det05(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.correlated(rules.bulk_windows(t.file_access(spark, sf_dir), CONFIG), t.logins(spark, sf_dir), t.assets(spark, sf_dir), CONFIG)
    return joined(found.select("id", "actor", "session", "asset_id", "gateway_id", "at", "distinct_files", "sensitive_files", "evidence_ids"))


_ALL = {
    "found": " UNION ALL ".join([
        f"SELECT {_fid('AS-001', 'list_value(concat(' + chr(39) + 'asset:' + chr(39) + ', id))')} AS id, 'AS-001' AS rule, CASE WHEN internet_exposed IS TRUE AND (known_exploited IS TRUE OR (privileged_path IS TRUE AND sensitive_path IS TRUE)) THEN 'P1' WHEN internet_exposed IS TRUE OR coalesce(cvss, 0) >= 7 THEN 'P2' ELSE 'P3' END AS priority, 'exposure' AS kind FROM assets WHERE patch_state = 'pending'",
        f"SELECT {_fid('AS-005', 'list_value(concat(' + chr(39) + 'asset:' + chr(39) + ', id))')}, 'AS-005', 'P2', 'coverage' FROM assets WHERE internet_exposed IS NULL OR privileged_path IS NULL OR sensitive_path IS NULL OR patch_state = 'unknown' OR {t.AS_OF} - observed_at > 86400",
        f"SELECT {_fid('AS-002', 'list_value(id)')}, 'AS-002', 'P2', 'identity' FROM logins WHERE success AND {_SUSPICIOUS}",
        f"SELECT {_fid('AS-003', 'e')}, 'AS-003', 'P2', 'bulk' FROM bulk",
        f"SELECT id, 'AS-004', 'P1', 'correlation' FROM ({_AS004})",
    ])
}
_PLAN_SQL = "SELECT id, rule, priority, kind, CASE kind WHEN 'exposure' THEN 'patch_or_isolate' WHEN 'identity' THEN 'verify_session' WHEN 'bulk' THEN 'review_access' WHEN 'correlation' THEN 'contain_and_investigate' ELSE 'manual_review' END AS plan FROM found"


def _analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.analyze(t.assets(spark, sf_dir), t.logins(spark, sf_dir), t.file_access(spark, sf_dir), t.AS_OF, CONFIG)


@query("det06_findings_in_order", t.with_tables("reads", "logins", "assets", more=_BULK | _LATEST | _EXPOSED | _ALL, sql="SELECT id, rule, priority, kind FROM found ORDER BY priority, CASE WHEN kind = 'correlation' THEN 0 ELSE 1 END, id"))
def det06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.in_order(_analyze(spark, sf_dir)).select("id", "rule", "priority", "kind")


@query("join14_response_plans", t.with_tables("reads", "logins", "assets", more=_BULK | _LATEST | _EXPOSED | _ALL, sql=_PLAN_SQL))
def join14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posture.response_plans(_analyze(spark, sf_dir)).select("id", "rule", "priority", "kind", "plan")


@query("agg05_findings_by_priority", t.with_tables("reads", "logins", "assets", more=_BULK | _LATEST | _EXPOSED | _ALL, sql="SELECT rule, count(*) AS findings, count(*) FILTER (WHERE priority = 'P1') AS p1 FROM found GROUP BY rule"))
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyze(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("findings"), F.count_if(F.col("priority") == "P1").alias("p1"))


@query(
    "det20_coverage",
    t.with_tables("reads", "logins", "assets", sql="""SELECT '' AS missing_sources,
    (SELECT count(*) FILTER (WHERE internet_exposed IS NULL) + count(*) FILTER (WHERE privileged_path IS NULL) + count(*) FILTER (WHERE sensitive_path IS NULL) FROM assets) AS unknown_asset_fields,
    (SELECT count(*) FILTER (WHERE privileged IS NULL) + count(*) FILTER (WHERE device_trusted IS NULL) + count(*) FILTER (WHERE approved IS NULL) FROM logins) AS unknown_login_fields,
    (SELECT count(*) FILTER (WHERE sensitive IS NULL) FROM reads) AS unknown_classifications, (SELECT count(*) FILTER (WHERE bytes_read IS NULL) FROM reads) AS unknown_read_sizes, CAST(0 AS BIGINT) AS live_connectors"""),
)
def det20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(rules.coverage(t.assets(spark, sf_dir), t.logins(spark, sf_dir), t.file_access(spark, sf_dir)))


# --- cases over control events

_DAY = f"at >= {t.NOW - 86400}"


def _case_sql(rule: str, priority: str, rows: str, keys: str, having: str = "") -> str:
    """Cases from evidence rows (keys, id, at, place), as correlate.case() makes them."""
    return f"""SELECT substr(sha256(concat('["{rule}",', CAST(to_json(list(id ORDER BY id)) AS VARCHAR), ']')), 1, 24) AS id, '{rule}' AS rule, '{priority}' AS priority, organization, actor,
      array_to_string(list_slice(list(id ORDER BY place, at, id), 1, 32), ',') AS evidence_ids, count(*) AS evidence_count, count(*) > 32 AS evidence_truncated, min(at) AS first_at, max(at) AS last_at
      FROM ({rows}) GROUP BY {keys} {having}"""


def _cases(df: DataFrame) -> DataFrame:
    return joined(df.select("id", "rule", "priority", "organization", "actor", "evidence_ids", "evidence_count", "evidence_truncated", "first_at", "last_at"))


@query("det09_sensitive_egress", t.with_tables("control", sql=_case_sql("AN-SENSITIVE-EGRESS", "P1", f"SELECT organization, actor, id, at, 0 AS place FROM control WHERE {_DAY} AND kind = 'egress' AND data_class IN ('confidential', 'restricted') AND target_type IN ('personal', 'unknown') AND result <> 'blocked'", "organization, actor")))
def det09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(correlate.sensitive_egress(t.control_events(spark, sf_dir), t.NOW))


#: The last month's events as if they had come in a day, so that the rule's own three in a day come.
_DENSE = {"dense": f"SELECT * REPLACE ({t.NOW} - ({t.NOW} - at) // 30 AS at) FROM control"}


@query("det10_low_and_slow", t.with_tables("control", more=_DENSE, sql=_case_sql("AN-LOW-SLOW", "P2", f"SELECT organization, actor, id, at, 0 AS place FROM dense WHERE {_DAY} AND kind = 'egress' AND data_class IN ('internal', 'confidential', 'restricted') AND target_type <> 'organization' AND result <> 'blocked'", "organization, actor", "HAVING count(*) >= 3 AND max(at) - min(at) >= 600")))
def det10(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = t.control_events(spark, sf_dir).withColumn("at", t.NOW - F.floor((t.NOW - F.col("at")) / 30))
    return _cases(correlate.low_and_slow(dense, t.NOW))


#: Rows are sparse here: five failures in ten minutes never come, two in four days do.
_FAIL_WINDOW, _FAIL_LEAST = 345_600, 2
_FAIL = {
    "hits": f"SELECT l.organization, l.actor, l.id AS login_id, l.at AS login_at, f.id, f.at, 0 AS place FROM control l JOIN control f ON l.organization = f.organization AND l.actor = f.actor AND l.source = f.source AND l.at - f.at > 0 AND l.at - f.at <= {_FAIL_WINDOW} WHERE l.kind IN ('vpn_login', 'idp_login') AND l.result = 'success' AND f.kind IN ('vpn_login', 'idp_login') AND f.result = 'failure'",
    "enough": f"SELECT * FROM hits QUALIFY count(*) OVER (PARTITION BY login_id) >= {_FAIL_LEAST}",
    "evidence": "SELECT organization, actor, login_id, id, at, place FROM enough UNION ALL SELECT DISTINCT organization, actor, login_id, login_id, login_at, 1 FROM enough",
}


@query("det11_login_after_failures", t.with_tables("control", more=_FAIL, sql=_case_sql("AN-LOGIN-AFTER-FAILURES", "P2", "SELECT * FROM evidence", "organization, actor, login_id")))
def det11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(correlate.login_after_failures(t.control_events(spark, sf_dir), _FAIL_WINDOW, _FAIL_LEAST))


#: Two years' events as if they had come in half a day, so that the rule's own five failures in ten minutes come.
_RUSH = 1500
_FAIL_OWN = {
    "dense": f"SELECT * REPLACE ({t.NOW} - ({t.NOW} - at) // {_RUSH} AS at) FROM control",
    "hits": _FAIL["hits"].replace("control l JOIN control f", "dense l JOIN dense f").replace(f"<= {_FAIL_WINDOW}", "<= 600"),
    "enough": _FAIL["enough"].replace(f">= {_FAIL_LEAST}", ">= 5"),
    "evidence": _FAIL["evidence"],
}


@query("det11_five_in_ten_minutes", t.with_tables("control", more=_FAIL_OWN, sql=_case_sql("AN-LOGIN-AFTER-FAILURES", "P2", "SELECT * FROM evidence", "organization, actor, login_id")))
def det11_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule at its own settings."""
    dense = t.control_events(spark, sf_dir).withColumn("at", t.NOW - F.floor((t.NOW - F.col("at")) / _RUSH))
    return _cases(correlate.login_after_failures(dense))


@query("join06_failures_before", t.with_tables("control", more=_FAIL, sql="SELECT organization, actor, login_id, login_at, count(*) AS failures FROM enough GROUP BY ALL"))
def join06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.failures_before(t.control_events(spark, sf_dir), _FAIL_WINDOW, _FAIL_LEAST).drop("source")


#: Every asset token that ends in 1 or 2 counts as risky in every organization; the window is a day, since rows are sparse.
_PATH = {
    "starts": "SELECT organization, actor, session, id AS login_id, at AS login_at FROM control WHERE kind IN ('vpn_login', 'idp_login') AND result = 'success' AND privileged IS TRUE AND (mfa IS FALSE OR device_trusted IS FALSE) AND session IS NOT NULL AND asset IN ('as-0', 'as-2')",
    "after": "SELECT s.organization, s.actor, s.login_id, s.login_at, c.id, c.at, c.kind FROM starts s JOIN control c ON s.organization = c.organization AND s.actor = c.actor AND s.session = c.session AND c.at - s.login_at BETWEEN 0 AND 86400 WHERE c.data_class IN ('confidential', 'restricted') AND ((c.kind = 'file_read' AND c.result = 'success') OR (c.kind = 'egress' AND c.result <> 'blocked' AND c.target_type <> 'organization'))",
    "firsts": "SELECT login_id, min(at) AS first_read FROM after WHERE kind = 'file_read' GROUP BY login_id",
    "evidence": "SELECT a.organization, a.actor, a.login_id, a.id, a.at, CASE WHEN kind = 'file_read' THEN 1 ELSE 2 END AS place FROM after a JOIN firsts f ON a.login_id = f.login_id WHERE kind = 'file_read' OR at >= first_read UNION ALL SELECT s.organization, s.actor, s.login_id, s.login_id, s.login_at, 0 FROM starts s JOIN firsts f ON s.login_id = f.login_id",
}


@query("det12_privilege_data_path", t.with_tables("control", more=_PATH, sql=_case_sql("AN-VPN-PRIVILEGE-DATA-PATH", "P1", "SELECT * FROM evidence", "organization, actor, login_id")))
def det12(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.control_events(spark, sf_dir)
    risky = events.where("asset in ('as-0', 'as-2')").select("organization", "asset").distinct()
    return _cases(correlate.privilege_data_path(events, risky, 86_400))


def _baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes sent on each of the 28 days before the last, by actor."""
    events = t.control_events(spark, sf_dir).where(f"kind = 'egress' and at < {t.NOW - 86400}")
    day = F.floor((F.lit(t.NOW - 86400) - F.col("at") - 1) / 86400).cast("int")
    daily = events.groupBy("organization", "actor", day.alias("day")).agg(F.sum("bytes").alias("b")).where("day < 28")
    per = daily.groupBy("organization", "actor").agg(F.map_from_entries(F.collect_list(F.struct("day", "b"))).alias("m"))
    return per.select("organization", "actor", F.lit(t.NOW - 86401).cast("long").alias("until"), F.transform(F.sequence(F.lit(0), F.lit(27)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0))).alias("samples"))


_BASE = {
    "daily": f"SELECT organization, actor, day, sum(bytes) AS b FROM (SELECT *, CAST(floor(({t.NOW - 86400} - at - 1) / 86400) AS INTEGER) AS day FROM control WHERE kind = 'egress' AND at < {t.NOW - 86400}) WHERE day < 28 GROUP BY organization, actor, day",
    "actors": "SELECT DISTINCT organization, actor FROM daily",
    "samples": "SELECT a.organization, a.actor, coalesce(d.b, 0) AS x FROM actors a CROSS JOIN range(28) r(day) LEFT JOIN daily d ON a.organization = d.organization AND a.actor = d.actor AND d.day = r.day",
    "medians": "SELECT organization, actor, median(x) AS median FROM samples GROUP BY ALL",
    "limits": "SELECT organization, actor, median, mad, greatest(median * 3, median + 6 * greatest(mad, 1024), 1048576) AS threshold FROM (SELECT m.organization, m.actor, m.median, median(abs(s.x - m.median)) AS mad FROM medians m JOIN samples s ON m.organization = s.organization AND m.actor = s.actor GROUP BY ALL)",
}


@query("agg07_baseline_limits", t.with_tables("control", more=_BASE, sql="SELECT organization, actor, CAST(median AS DOUBLE) AS median, CAST(mad AS DOUBLE) AS mad, CAST(threshold AS DOUBLE) AS threshold FROM limits"))
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.baseline_limits(_baselines(spark, sf_dir)).drop("until")


_SENT = f"SELECT organization, actor, id, at, bytes FROM control WHERE {_DAY} AND kind = 'egress' AND result = 'success'"


@query("det13_baseline_deviation", t.with_tables("control", more=_BASE, sql=_case_sql("AN-BASELINE-DEVIATION", "P2", f"SELECT s.organization, s.actor, s.id, s.at, 0 AS place FROM ({_SENT}) s JOIN limits l ON s.organization = l.organization AND s.actor = l.actor QUALIFY sum(bytes) OVER (PARTITION BY s.organization, s.actor) > threshold", "organization, actor")))
def det13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(correlate.baseline_deviation(t.control_events(spark, sf_dir), _baselines(spark, sf_dir), t.NOW))


_STALE = t.with_tables("control", sql=f"SELECT x.source, coalesce(max(c.at), 0) AS last_seen FROM (SELECT DISTINCT concat('src', CAST(n_nationkey % 8 AS VARCHAR)) AS source FROM nation) x LEFT JOIN control c ON c.source = x.source GROUP BY x.source HAVING {t.NOW} - coalesce(max(c.at), 0) > 300")


@query("det21_stale_sources", _STALE)
def det21(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), (F.col("n_nationkey") % 8).cast("string")).alias("source"))
    return correlate.stale_sources(t.control_events(spark, sf_dir), expected, t.NOW)


# --- transfers and posture

_FIRST = {"firsts": "SELECT * FROM dlp QUALIFY row_number() OVER (PARTITION BY source, event_id ORDER BY at) = 1"}


@query("det07_sensitive_transfers", t.with_tables("dlp", more=_FIRST, sql="SELECT 'DLP-001' AS rule, source, actor, event_id AS evidence_ids, outcome AS observed_outcome FROM firsts WHERE tenant <> 'managed' AND data_class IN ('confidential', 'restricted')"))
def det07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(posture.sensitive_transfers(t.dlp(spark, sf_dir))).drop("verdict", "leak_confirmed")


def _version_sql(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '[0-9]{{1,6}}(\\.[0-9]{{1,6}}){{0,5}}') THEN list_resize([CAST(x AS INTEGER) FOR x IN string_split({c}, '.')], 6, 0) END"


_POSTURE = {
    "kev": "SELECT DISTINCT cve FROM advisories WHERE right(cve, 1) IN ('1', '4', '7')",
    "i": f"SELECT *, CASE WHEN regexp_full_match(version, '[0-9]{{1,6}}(\\.[0-9]{{1,6}}){{0,5}}') THEN list_resize(CAST(string_split(version, '.') AS INTEGER[]), 6, 0) END AS v FROM inventory",
    "a": f"SELECT *, {_version_sql('introduced')} AS low, CASE WHEN regexp_full_match(fixed, '[0-9]{{1,6}}(\\.[0-9]{{1,6}}){{0,5}}') THEN list_resize(CAST(string_split(fixed, '.') AS INTEGER[]), 6, 0) END AS high FROM advisories",
    "rows_": "SELECT i.*, a.cve, coalesce(v IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL AND low < high, false) AS ok, low, high, a.cve IN (SELECT cve FROM kev) AS known FROM i LEFT JOIN a ON lower(i.vendor) = lower(a.vendor) AND lower(i.product) = lower(a.product)",
    "per": "SELECT id, count(*) FILTER (WHERE ok AND low <= v AND v < high) AS hits, bool_or(ok AND low <= v AND v < high AND known) AS hot, count(cve) AS candidates, bool_or(cve IS NOT NULL AND NOT ok) AS odd, bool_or(internet_exposed IS NULL OR privileged_path IS NULL OR sensitive_path IS NULL) AS unset, bool_or(internet_exposed IS TRUE) AS exposed, bool_or(sensitive_path IS TRUE) AS sensitive, string_agg(CASE WHEN ok AND low <= v AND v < high THEN cve END, ',' ORDER BY cve) AS cves FROM rows_ GROUP BY id",
}


def _posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    adv = t.advisories(spark, sf_dir)
    kev = adv.where("right(cve, 1) in ('1', '4', '7')").select("cve")
    return posture.assess(t.inventory(spark, sf_dir), adv, kev, t.NOW - 3600, t.NOW - 7200, t.NOW - 86400, t.NOW)


@query("det15_asset_posture", t.with_tables("inventory", "advisories", more=_POSTURE, sql="SELECT id AS asset_id, CASE WHEN hits > 0 AND exposed AND (hot OR sensitive) THEN 'P1' ELSE 'P2' END AS priority, CASE WHEN hits > 0 THEN 'affected' WHEN candidates = 0 OR unset OR odd THEN 'unknown' ELSE 'no_match_in_supplied_ranges' END AS status, coalesce(cves, '') AS cves, concat_ws(',', CASE WHEN candidates = 0 THEN 'no_vendor_data' END, CASE WHEN unset THEN 'exposure_or_path_unknown' END, CASE WHEN odd THEN 'version_not_comparable' END) AS reasons FROM per"))
def det15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posture(spark, sf_dir).select("asset_id", "priority", "status", F.array_join("matches.cve", ",").alias("cves"), F.array_join("reasons", ",").alias("reasons"))


_CONTROLS = {"asset_id": "concat('c-', cast(c_custkey as varchar(20)))", "observed_at": f"cast({t.NOW} - (c_custkey % 50) * 2400 as bigint)", "mfa_required": "case c_custkey % 3 when 0 then false when 1 then true end", "admin_public": "case c_custkey % 4 when 0 then true when 1 then false when 2 then false end", "supported": "case c_custkey % 5 when 0 then false when 1 then true when 2 then true when 3 then true end"}


@query("det16_vpn_controls", f"WITH c AS (SELECT {t.sql_list(_CONTROLS)} FROM customer), f AS (SELECT *, {t.NOW} - observed_at > 86400 AS stale FROM c) SELECT 'VPN-STALE-CONTROLS' AS rule, asset_id AS asset, 'P2' AS priority FROM f WHERE stale UNION ALL SELECT CASE WHEN mfa_required IS NULL THEN 'VPN-UNKNOWN' ELSE 'VPN-MFA' END, asset_id, CASE WHEN mfa_required IS NULL THEN 'P2' ELSE 'P1' END FROM f WHERE NOT stale AND mfa_required IS NOT TRUE UNION ALL SELECT CASE WHEN admin_public IS NULL THEN 'VPN-UNKNOWN' ELSE 'VPN-ADMIN-PUBLIC' END, asset_id, CASE WHEN admin_public IS NULL THEN 'P2' ELSE 'P1' END FROM f WHERE NOT stale AND admin_public IS NOT FALSE UNION ALL SELECT CASE WHEN supported IS NULL THEN 'VPN-UNKNOWN' ELSE 'VPN-EOL' END, asset_id, CASE WHEN supported IS NULL THEN 'P2' ELSE 'P1' END FROM f WHERE NOT stale AND supported IS NOT TRUE")
def det16(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(*[F.expr(e.replace("varchar(20)", "string")).alias(k) for k, e in _CONTROLS.items()])
    return posture.vpn_controls(c, t.NOW)


@query("det19_tool_drift", "SELECT concat('t-', CAST(p_partkey AS VARCHAR)) AS tool_id, true AS requires_reapproval FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0")
def det19(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("t-"), F.col("p_partkey").cast("string")).alias("id"), F.sha2("p_name", 256).alias("sha256"), F.array(F.lit("read"), F.lit("write")).alias("permissions"), F.col("p_brand").alias("publisher"))
    old = tools.where("p_partkey % 7 <> 0").withColumn("permissions", F.when(F.col("p_partkey") % 11 == 0, F.array(F.lit("write"), F.lit("read"))).otherwise(F.col("permissions"))).withColumn("publisher", F.when(F.col("p_partkey") % 13 == 0, F.lit(None)).otherwise(F.col("publisher")))
    return posture.tool_drift(tools, old).select("tool_id", "requires_reapproval")


# --- content

#: The patterns without look-around, which the comparison engine lacks; the mobile clause asks for its neighbours instead.
_SECRET_RE = s.SECRET.replace("'", "''")
_PERSONAL_RE = r"[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,10}|(^|[^0-9])0[789]0[- ]?[0-9]{4}[- ]?[0-9]{4}($|[^0-9])"
_VERDICT = f"CASE WHEN text IS NULL THEN 'unread' WHEN regexp_matches(text, '{_SECRET_RE}') THEN 'block' WHEN regexp_matches(text, '{_PERSONAL_RE}') THEN 'review' ELSE 'no_findings' END"


@query("det24_document_verdicts", f"SELECT doc_id, {_VERDICT} AS verdict FROM documents")
def det24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.inspect_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "verdict")


@query("det24_page_verdicts", f"SELECT page_id, {_VERDICT.replace('text', 'html')} AS verdict FROM pages")
def det24_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.inspect_texts(table(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", "verdict")


@query("det24_conversation_verdicts", f"SELECT conv_id, turn, {_VERDICT} AS verdict FROM conversations")
def det24_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.inspect_texts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", "verdict")


_GRANTS = "SELECT * FROM (VALUES ('ai.prompt', 'https://ai.example', ['public'], NULL), ('mail.send', 'https://mail.example', ['public', 'internal'], NULL), ('agent.read', 'https://mail.example', ['public'], 'reader')) g(action, destination, data_classes, tool)"
_PREFLIGHT = {
    "g": _GRANTS,
    "j": "SELECT r.*, g.data_classes, g.action IS NOT NULL AS granted, r.action = 'agent.execute' AS human FROM requests r LEFT JOIN g ON r.action = g.action AND r.destination = g.destination AND r.tool IS NOT DISTINCT FROM g.tool",
    "d": f"SELECT event_id, action, concat_ws(',', CASE WHEN human THEN 'PG-005' END, CASE WHEN NOT human AND NOT granted THEN 'PG-001' END, CASE WHEN NOT human AND granted AND data_class IN ('public', 'internal') AND NOT list_contains(data_classes, data_class) THEN 'PG-007' END, CASE WHEN data_class IN ('confidential', 'restricted') THEN 'PG-002' END, CASE WHEN data_class = 'unknown' THEN 'PG-004' END, CASE WHEN regexp_matches(text, '{_SECRET_RE}') THEN 'PG-003' END, CASE WHEN regexp_matches(text, '{_PERSONAL_RE}') THEN 'PG-006' END) AS rule_ids FROM j",
}


@query("det22_preflight", t.with_tables("requests", more=_PREFLIGHT, sql="SELECT event_id, action, rule_ids, CASE WHEN regexp_matches(rule_ids, 'PG-00[1237]') THEN 'block' WHEN rule_ids <> '' THEN 'review' ELSE 'allow' END AS decision FROM d"))
def det22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(content.preflight(t.requests(spark, sf_dir), t.grants(spark))).select("event_id", "action", "rule_ids", "decision")


@query("det26_bundle_decisions", f"WITH v AS (SELECT conv_id, {_VERDICT} AS verdict FROM conversations) SELECT conv_id AS bundle_id, CASE max(CASE verdict WHEN 'block' THEN 2 WHEN 'review' THEN 1 WHEN 'unread' THEN 1 ELSE 0 END) WHEN 2 THEN 'block' WHEN 1 THEN 'review' ELSE 'no_findings' END AS decision, bool_and(verdict <> 'unread') AS coverage_complete, count(*) FILTER (WHERE verdict IN ('block', 'review')) AS findings FROM v GROUP BY conv_id")
def det26(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = content.inspect_texts(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("bundle_id"), "verdict", (F.col("verdict") != "unread").alias("complete"), F.array("verdict").alias("rules"), F.col("verdict").isin("block", "review").cast("long").alias("findings"))
    return content.bundle_decisions(parts).drop("rules")


@query("evl07_corpus_measurement", f"WITH v AS (SELECT d.lang AS category, {_VERDICT.replace('text', 'd.text')} IN ('block', 'review') AS hit, l.toxic = 1 AS want FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT category, count(*) AS total, count(*) FILTER (WHERE hit) AS detected, count(*) FILTER (WHERE want AND NOT hit) AS missed, count(*) FILTER (WHERE hit AND NOT want) AS false_alarms FROM v GROUP BY category")
def evl07(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.when(F.col("toxic") == 1, "detect").otherwise("clean").alias("expect"), "text")
    return content.measure(cases)[0]


@query("fn21_strict_urls", r"SELECT page_id, regexp_full_match(url, 'https://[a-z0-9-]+(\.[a-z0-9-]+)+(:443)?(/[\x21-\x7E]*)?') AND NOT regexp_matches(url, '^https://[0-9.]+(:443)?(/|$)') AND NOT regexp_matches(url, '[@?#%\\]') AND NOT regexp_matches(url, '/\.{1,2}(/|$)') AS strict FROM pages")
def fn21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", s.strict_url(F.col("url")).alias("strict"))


@query("fn08_slugs", "WITH x AS (SELECT p_partkey, p_name AS v, regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9_.-]{0,79}') AS keep, coalesce(nullif(rtrim(substr(trim(regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'asset') AS head FROM part) SELECT p_partkey, CASE WHEN keep THEN v ELSE concat(CASE WHEN regexp_matches(head, '^[A-Za-z0-9]') THEN head ELSE concat('x', head) END, ':', substr(sha256(v), 1, 16)) END AS slug FROM x")
def fn08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", s.slug(F.col("p_name")).alias("slug"))


@query("fn02_tri_state", "SELECT o_orderkey, CASE WHEN lower(o_orderstatus) IN ('f') THEN true WHEN lower(o_orderstatus) IN ('p') THEN false WHEN contains(lower(o_orderpriority), 'urgent') THEN true WHEN contains(lower(o_orderpriority), 'low') THEN false END AS flag FROM orders")
def fn02(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    both = F.coalesce(s.tri_state(F.col("o_orderstatus"), ["F"], ["P"]), s.tri_state(F.col("o_orderpriority"), None, None, ["URGENT"], ["LOW"]))
    return o.select("o_orderkey", both.alias("flag"))


# --- cleaning, joins, aggregates

_TWICE = "SELECT *, 0 AS r FROM reads UNION ALL SELECT * REPLACE (CASE WHEN CAST(substr(id, 4) AS BIGINT) % 10 = 0 THEN concat(file_id, 'x') ELSE file_id END AS file_id), 1 AS r FROM reads WHERE CAST(substr(id, 4) AS BIGINT) % 3 = 0"


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, and a third of them again from a second source, some with other content."""
    reads = t.file_access(spark, sf_dir)
    n = F.substring("id", 4, 20).cast("long")
    again = reads.where(n % 3 == 0).withColumn("file_id", F.when(n % 10 == 0, F.concat("file_id", F.lit("x"))).otherwise(F.col("file_id")))
    return reads.withColumn("_source", F.lit("a")).unionByName(again.withColumn("_source", F.lit("b"))).withColumn("_row", F.col("at"))


@query("cln01_repeated_events", t.with_tables("reads", more={"twice": _TWICE}, sql="SELECT id, count(DISTINCT file_id) AS contents, count(*) - count(DISTINCT file_id) AS dropped FROM twice GROUP BY id"))
def cln01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _twice(spark, sf_dir)
    kept, _ = clean.without_repeats(rows)
    a = kept.groupBy("id").agg(F.count("*").alias("contents"))
    return rows.groupBy("id").agg(F.count("*").alias("n")).join(a, "id").select("id", "contents", (F.col("n") - F.col("contents")).alias("dropped"))


@query("cln02_conflicting_ids", t.with_tables("reads", more={"twice": _TWICE}, sql="SELECT CASE WHEN r = 1 THEN concat(substr(id, 1, 40), ':') ELSE id END AS id_head, file_id, r = 1 AS renamed FROM twice QUALIFY row_number() OVER (PARTITION BY id, file_id ORDER BY r) = 1"))
def cln02(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = clean.without_repeats(_twice(spark, sf_dir))
    out = clean.renamed_conflicts(kept)
    return out.select(F.when(F.col("renamed"), F.regexp_replace("id", ":[0-9a-f]{16}$", ":")).otherwise(F.col("id")).alias("id_head"), "file_id", "renamed")


@query("cln04_latest_assets", t.with_tables("control", sql="SELECT asset AS id, max(at) AS observed_at, arg_max(actor, at * 100000000 + CAST(substr(id, 4) AS BIGINT)) AS actor FROM control GROUP BY asset"))
def cln04(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.control_events(spark, sf_dir)
    return clean.latest_assets(c.select(F.col("asset").alias("id"), F.col("at").alias("observed_at"), "actor", F.lit("a").alias("_source"), F.substring("id", 4, 20).cast("long").alias("_row"))).select("id", "observed_at", "actor")


@query("join01_shadow_assets", t.with_tables("reads", "logins", "assets", sql="SELECT DISTINCT id FROM (SELECT concat(gateway_id, CASE WHEN privileged THEN 'p' ELSE '' END) AS id FROM logins UNION ALL SELECT asset_id FROM reads) WHERE id NOT IN (SELECT id FROM assets)"))
def join01(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = t.logins(spark, sf_dir).withColumn("gateway_id", F.concat("gateway_id", F.when(F.col("privileged"), "p").otherwise("")))
    return clean.shadow_assets(t.assets(spark, sf_dir), logins, t.file_access(spark, sf_dir))


@query("flt03_registered_events", t.with_tables("logins", "assets", sql="SELECT id, at, gateway_id FROM logins WHERE gateway_id IN (SELECT id FROM assets WHERE kind <> 'saas')"))
def flt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.registered_only(t.logins(spark, sf_dir), t.assets(spark, sf_dir).where("kind <> 'saas'"), "gateway_id").select("id", "at", "gateway_id")


@query("agg03_as_of", t.with_tables("reads", "logins", "assets", sql="SELECT greatest(max(at), (SELECT max(observed_at) FROM assets)) AS as_of, min(at) AS first_at, max(at) AS last_at FROM (SELECT at FROM logins UNION ALL SELECT at FROM reads)"))
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.as_of(t.assets(spark, sf_dir), t.logins(spark, sf_dir), t.file_access(spark, sf_dir))


@query("agg04_events_by_kind", t.with_tables("control", sql="SELECT kind, count(*) AS n, count(DISTINCT actor) AS actors FROM control GROUP BY kind"))
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.control_events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("actors"))


@query("val03_control_event_problems", t.with_tables("control", sql=f"SELECT id, concat_ws(',', CASE WHEN NOT (at BETWEEN {t.NOW - 50 * 86400} AND {t.NOW - 20 * 86400} + 60) THEN 'bad_at' END) AS problems FROM control"))
def val03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(clean.control_event_problems(t.control_events(spark, sf_dir), t.NOW - 20 * 86400).select("id", "problems"))


@query("val01_event_problems", t.with_tables("reads", "assets", sql="SELECT id, concat_ws(',', CASE WHEN asset_id NOT IN (SELECT id FROM assets WHERE kind <> 'server') THEN 'unregistered_asset' END, CASE WHEN at > 1705500000 + 300 THEN 'bad_at' END) AS problems FROM reads"))
def val01(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = t.assets(spark, sf_dir).where("kind <> 'server'")
    return joined(clean.event_problems(t.file_access(spark, sf_dir), assets, "asset_id", 1_705_500_000).select("id", "problems"))


# --- evaluation

#: An event is malicious if its number is divisible by 17; scenarios are users' remainders by 4.
_EVL = {
    "alerts": f"SELECT CAST(substr(actor, 2) AS BIGINT) % 4 AS scenario, rule, list_bool_or([CAST(substr(x, 4) AS BIGINT) % 17 = 0 FOR x IN e]) AS tp FROM (SELECT actor, 'AS-002' AS rule, [id] AS e FROM logins WHERE success AND {_SUSPICIOUS} UNION ALL SELECT actor, 'AS-003', e FROM bulk)",
    "spans": "SELECT CAST(substr(actor, 2) AS BIGINT) % 4 AS scenario, greatest((max(at) - min(at)) / 86400.0, 1.0 / 24) AS days FROM (SELECT actor, at FROM logins UNION ALL SELECT actor, at FROM reads) GROUP BY 1",
    "scored": "SELECT s.scenario, r.rule, count(a.rule) AS alerts, count(*) FILTER (WHERE a.tp) AS tp, s.scenario <> 3 AS expected FROM spans s CROSS JOIN (VALUES ('AS-002'), ('AS-003'), ('AS-004')) r(rule) LEFT JOIN alerts a ON a.scenario = s.scenario AND a.rule = r.rule GROUP BY ALL",
}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, logins = t.file_access(spark, sf_dir), t.logins(spark, sf_dir)
    found = rules.identity(logins, CONFIG).unionByName(rules.bulk_access(rules.bulk_windows(reads, CONFIG), CONFIG))
    scenario = (F.substring("actor", 2, 20).cast("long") % 4).alias("scenario")
    both = logins.select("id", "actor", "at").unionAll(reads.select("id", "actor", "at"))
    malicious = both.where(F.substring("id", 4, 20).cast("long") % 17 == 0).select(F.col("id").alias("evidence_id"))
    spans = both.groupBy(scenario).agg(F.greatest((F.max("at") - F.min("at")) / 86400.0, F.lit(1.0 / 24)).alias("days"))
    expected = spans.where("scenario <> 3").select("scenario", F.explode(F.array(*[F.lit(r) for r in evaluate.BEHAVIORAL])).alias("rule"))
    return evaluate.scores(evaluate.marked(found.withColumn("scenario", scenario), malicious), expected, spans)


@query("evl01_scores", t.with_tables("reads", "logins", more=_BULK | _EVL, sql="SELECT scenario, rule, alerts, tp, alerts - tp AS fp, CAST(expected AND tp = 0 AS BIGINT) AS fn, CASE WHEN expected AND tp > 0 THEN 'tp' WHEN expected THEN 'fn' WHEN alerts > 0 THEN 'fp' ELSE 'tn' END AS cell FROM scored"))
def evl01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).drop("days", "expected")


@query("evl02_totals", t.with_tables("reads", "logins", more=_BULK | _EVL, sql="SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(alerts - tp) AS BIGINT) AS fp, count(*) FILTER (WHERE expected AND tp = 0) AS missed, count(*) FILTER (WHERE expected) AS expected, round(sum(tp) / sum(alerts), 4) AS precision, round((count(*) FILTER (WHERE expected AND tp > 0)) / count(*) FILTER (WHERE expected), 4) AS recall FROM scored"))
def evl02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.totals(_scored(spark, sf_dir)).drop("days", "fp_per_day")


@query("evl03_case_metrics", t.with_tables("reads", "logins", more=_BULK | _EVL | {"n": "SELECT count(*) FILTER (WHERE expected AND tp > 0) AS tp, count(*) FILTER (WHERE NOT expected AND alerts > 0) AS fp, count(*) FILTER (WHERE NOT expected AND alerts = 0) AS tn, count(*) FILTER (WHERE expected AND tp = 0) AS fn FROM scored"}, sql="SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(fp / (fp + tn), 4) AS fpr, round(fn / (tp + fn), 4) AS fnr FROM n"))
def evl03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.case_metrics(_scored(spark, sf_dir))


_SWEEP_WINDOWS, _SWEEP_THRESHOLDS = [21_600, 86_400], [2, 3, 4]
_SWEEP = {
    "counts": f"SELECT w.w AS window_seconds, a.actor, a.session, a.asset_id, a.at, a.id, count(DISTINCT b.file_id) AS n FROM (VALUES (21600), (86400)) w(w) CROSS JOIN reads a JOIN reads b ON a.actor = b.actor AND a.session = b.session AND a.asset_id = b.asset_id AND b.at >= a.at - w.w AND (b.at, b.id) <= (a.at, a.id) GROUP BY ALL",
    "peaks": "SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY window_seconds, actor, session, asset_id ORDER BY n DESC, at, id) = 1 AND n >= 2",
    "marks": "SELECT p.window_seconds, p.actor, p.session, p.asset_id, p.n, bool_or(CAST(substr(r.id, 4) AS BIGINT) % 17 = 0) AS tp FROM peaks p JOIN reads r ON p.actor = r.actor AND p.session = r.session AND p.asset_id = r.asset_id AND r.at >= p.at - p.window_seconds AND (r.at, r.id) <= (p.at, p.id) GROUP BY ALL",
    "cells": "SELECT w.w AS window_seconds, h.h AS threshold, count(m.n) AS alerts, count(*) FILTER (WHERE m.tp) AS tp FROM (VALUES (21600), (86400)) w(w) CROSS JOIN (VALUES (2), (3), (4)) h(h) LEFT JOIN marks m ON m.window_seconds = w.w AND m.n >= h.h GROUP BY ALL",
}


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = t.file_access(spark, sf_dir)
    malicious = reads.where(F.substring("id", 4, 20).cast("long") % 17 == 0).select(F.col("id").alias("evidence_id"))
    return evaluate.sweep(reads, malicious, _SWEEP_THRESHOLDS, _SWEEP_WINDOWS)


@query("evl04_threshold_sweep", t.with_tables("reads", more=_SWEEP, sql="SELECT window_seconds, threshold, alerts, tp, alerts - tp AS fp FROM cells"))
def evl04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@query("evl05_recommendation", t.with_tables("reads", more=_SWEEP, sql="SELECT window_seconds, threshold, alerts, tp, alerts - tp AS fp FROM cells WHERE tp >= 1 ORDER BY fp, threshold, window_seconds DESC LIMIT 1"))
def evl05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recommendation(_sweep(spark, sf_dir), 1)


# --- journal

_JOURNAL = {"journal": "SELECT o_orderkey + 1 AS seq, strftime(o_orderdate + to_seconds(o_orderkey), '%Y-%m-%dT%H:%M:%SZ') AS at, CASE o_orderkey % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'ingest' ELSE 'policy' END AS action, sha256(CAST(o_orderkey AS VARCHAR)) AS mac FROM orders"}


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.to_json(F.struct(F.lit("allow").alias("decision"), F.array(F.lit("PG-006")).alias("rule_ids")))
    return o.select((F.col("o_orderkey") + 1).alias("seq"), at.alias("at"), F.when(F.col("o_orderkey") % 3 == 0, "decision").when(F.col("o_orderkey") % 3 == 1, "ingest").otherwise("policy").alias("action"), body.alias("payload"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("mac"), F.sha2((F.col("o_orderkey") - 1).cast("string"), 256).alias("prev"))


@query("aud01_broken_links", "SELECT o_orderkey + 1 AS seq, 'broken_link' AS problem FROM orders WHERE o_orderkey % 1000 = 999")
def aud01(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _journal(spark, sf_dir).withColumn("prev", F.when(F.col("seq") % 1000 == 0, F.lit("0" * 64)).otherwise(F.col("prev")))
    first = (0, "ef2d127de37b942baad06145e54b0c619a1f22327b2ebbcfbec78f5564afe39d")
    return audit.chain_problems(j.withColumn("prev", F.when(F.col("seq") == 1, F.lit(first[1])).otherwise(F.col("prev"))), b"key", first).where("problem = 'broken_link'")


@query("aud03_prune", t.with_tables(more=_JOURNAL, sql="SELECT seq, at, action FROM journal WHERE seq >= (SELECT min(seq) FROM journal WHERE at >= '2001-07-30T00:00:00Z')"))
def aud03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, _ = audit.pruned(_journal(spark, sf_dir), "2001-07-30T00:00:00Z", "2001-08-01T00:00:00Z")
    return rest.select("seq", "at", "action")


@query("snk03_export", t.with_tables(more=_JOURNAL, sql="SELECT seq, at, action, 'PG-006' AS rule_ids, 'allow' AS decision FROM (SELECT * FROM journal WHERE action IN ('decision', 'ingest') ORDER BY seq DESC LIMIT 500) ORDER BY seq"))
def snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(audit.exported(_journal(spark, sf_dir), 500))
