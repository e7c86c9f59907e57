"""The driver's tables as domain frames. The same SQL expressions define them for Spark and for the comparison engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that give rows on these sparse tables, all within bounds.
WINDOW, THRESHOLD, LOOKBACK = 86_400, 3, 604_800
#: The instant that batch rules take as now, as_of of the ledger, and the organization of events.
NOW, AS_OF = 1_706_659_200, 1_706_659_200

#: Named select lists over events as (event_id, at, user_id, event_type, value, k), by output column.
FILE_ACCESS = {
    "id": "concat('ev-', cast(event_id as varchar(20)))",
    "at": "at",
    "actor": "concat('u', cast(user_id as varchar(20)))",
    "session": "concat('u', cast(user_id as varchar(20)), '-', cast(cast(floor(at / 604800) as bigint) as varchar(20)))",
    "asset_id": "concat('as-', cast(k % 3 as varchar(20)))",
    "file_id": "concat('f', cast(k as varchar(20)))",
    "sensitive": "case k % 3 when 0 then true when 1 then false end",
    "bytes_read": "cast(floor(value * 100) as bigint)",
}
LOGINS = {
    "id": "concat('ev-', cast(event_id as varchar(20)))",
    "at": "at",
    "actor": FILE_ACCESS["actor"],
    "session": FILE_ACCESS["session"],
    "gateway_id": "concat('as-', cast(k % 4 as varchar(20)))",
    "success": "event_type = 'signup'",
    "privileged": "k % 2 = 0",
    "device_trusted": "case k % 3 when 0 then false when 1 then true end",
    "approved": "case when k % 5 < 2 then false when k % 5 < 4 then true end",
}
CONTROL = {
    "id": "concat('ev-', cast(event_id as varchar(20)))",
    "organization": "concat('org', cast(user_id % 3 as varchar(20)))",
    "source": "concat('src', cast(user_id % 5 as varchar(20)))",
    "at": "at",
    "kind": "case event_type when 'purchase' then 'egress' when 'click' then 'file_read' when 'signup' then 'vpn_login' when 'error' then 'idp_login' else 'collector_heartbeat' end",
    "actor": FILE_ACCESS["actor"],
    "result": "case when event_type = 'error' then 'failure' when event_type = 'purchase' and k % 7 = 0 then 'blocked' else 'success' end",
    "session": FILE_ACCESS["session"],
    "asset": "concat('as-', cast(k % 4 as varchar(20)))",
    "target": "concat('t', cast(k % 10 as varchar(20)))",
    "channel": "case when event_type = 'purchase' then 'cloud' else 'unknown' end",
    "target_type": "case k % 4 when 0 then 'organization' when 1 then 'personal' when 2 then 'unknown' else 'personal' end",
    "data_class": "case k % 5 when 0 then 'public' when 1 then 'internal' when 2 then 'confidential' when 3 then 'restricted' else 'unknown' end",
    "bytes": "cast(floor(value * 10000) as bigint)",
    "privileged": "k % 2 = 0",
    "mfa": "case k % 3 when 0 then false when 1 then true end",
    "device_trusted": "case k % 5 when 0 then false when 1 then true end",
}
#: Over supplier.
ASSETS = {
    "id": "concat('as-', cast(s_suppkey as varchar(20)))",
    "kind": "case s_suppkey % 4 when 0 then 'vpn' when 1 then 'server' when 2 then 'saas' else 'endpoint' end",
    "patch_state": "case s_suppkey % 4 when 0 then 'pending' when 1 then 'pending' when 2 then 'applied' else 'unknown' end",
    "observed_at": f"cast({AS_OF} - (s_suppkey % 40) * 3600 as bigint)",
    "internet_exposed": "case s_suppkey % 5 when 0 then true when 1 then true when 2 then true when 3 then false end",
    "privileged_path": "case s_suppkey % 3 when 0 then true when 1 then true end",
    "sensitive_path": "case s_suppkey % 2 when 0 then true else s_suppkey % 7 = 1 end",
    "reference": "case when s_suppkey % 6 > 0 then concat('CVE-2025-', cast(10000 + s_suppkey as varchar(20))) end",
    "cvss": "case when s_suppkey % 6 > 0 then cast(cast(floor(abs(s_acctbal)) as bigint) % 101 as double) / 10 end",
    "known_exploited": "case when s_suppkey % 6 > 0 then s_suppkey % 9 = 0 end",
}
#: Over part.
INVENTORY = {
    "id": "concat('p-', cast(p_partkey as varchar(20)))",
    "vendor": "p_type",
    "product": "p_brand",
    "version": "case when p_partkey % 23 = 0 then 'custom-build' else concat(cast(p_size as varchar(20)), '.', cast(p_partkey % 10 as varchar(20))) end",
    "internet_exposed": "case p_partkey % 3 when 0 then true when 1 then false end",
    "privileged_path": "p_partkey % 2 = 0",
    "sensitive_path": "case p_partkey % 5 when 0 then true when 1 then false else false end",
}
#: Over the distinct (p_type, p_brand) of part, where b is the number at the brand's end.
ADVISORIES = {
    "vendor": "lower(p_type)",
    "product": "p_brand",
    "cve": "concat('CVE-2025-', cast(20000 + b as varchar(20)))",
    "introduced": "concat(cast(b as varchar(20)), '.0')",
    "fixed": "case when b % 11 = 0 then 'unfixed' else concat(cast(b + 12 as varchar(20)), '.5') end",
    "source": "concat('https://vendor.example/', cast(b as varchar(20)))",
}
#: Over orders.
DLP = {
    "event_id": "concat('o', cast(o_orderkey as varchar(20)))",
    "source": "concat('s', cast(o_custkey % 4 as varchar(20)))",
    "actor": "concat('c', cast(o_custkey as varchar(20)))",
    "operation": "case o_orderkey % 4 when 0 then 'upload' when 1 then 'usb' when 2 then 'sync' else 'download' end",
    "tenant": "case o_orderkey % 3 when 0 then 'managed' when 1 then 'personal' else 'unknown' end",
    "data_class": "case o_orderkey % 5 when 0 then 'public' when 1 then 'internal' when 2 then 'confidential' when 3 then 'restricted' else 'unknown' end",
    "bytes": "cast(floor(o_totalprice) as bigint)",
    "outcome": "case o_orderkey % 3 when 0 then 'blocked' when 1 then 'allowed' else 'unknown' end",
}
#: Over documents.
REQUESTS = {
    "event_id": "concat('EV-', cast(doc_id as varchar(20)))",
    "action": "case doc_id % 4 when 0 then 'ai.prompt' when 1 then 'mail.send' when 2 then 'agent.read' else 'agent.execute' end",
    "destination": "case doc_id % 3 when 0 then 'https://ai.example' else 'https://mail.example' end",
    "text": "text",
    "data_class": "case doc_id % 5 when 0 then 'public' when 1 then 'internal' when 2 then 'confidential' when 3 then 'unknown' else 'public' end",
    "tool": "case when doc_id % 4 >= 2 then 'reader' end",
}
GRANT_ROWS = [("ai.prompt", "https://ai.example", ["public"], None), ("mail.send", "https://mail.example", ["public", "internal"], None), ("agent.read", "https://mail.example", ["public"], "reader")]


def sql_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e.replace("varchar(20)", "string")).alias(c) for c, e in columns.items()])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return df.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "user_id", "event_type", "value", k.alias("k"))


#: The same for the comparison engine.
EVENTS_SQL = "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events"


def file_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(events(spark, sf_dir).where("event_type in ('view', 'click')"), FILE_ACCESS)


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(events(spark, sf_dir).where("event_type in ('signup', 'error')"), LOGINS)


def control_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(events(spark, sf_dir), CONTROL)


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _select(spark.read.parquet(f"{sf_dir}/supplier.parquet"), ASSETS)
    v = F.when(F.col("reference").isNotNull(), F.struct("reference", "cvss", "known_exploited"))
    return flat.withColumn("vulnerability", v).drop("reference", "cvss", "known_exploited")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark.read.parquet(f"{sf_dir}/part.parquet"), INVENTORY)


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type", "p_brand").distinct()
    return _select(brands.withColumn("b", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")), ADVISORIES)


def dlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return _select(orders.withColumn("at", at), DLP | {"at": "at"})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark.read.parquet(f"{sf_dir}/documents.parquet"), REQUESTS)


def grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRANT_ROWS, "action string, destination string, data_classes array<string>, tool string")


#: Common tables of the comparison SQL.
CTES = {
    "ev": EVENTS_SQL,
    "reads": f"SELECT {sql_list(FILE_ACCESS)} FROM ev WHERE event_type IN ('view', 'click')",
    "logins": f"SELECT {sql_list(LOGINS)} FROM ev WHERE event_type IN ('signup', 'error')",
    "control": f"SELECT {sql_list(CONTROL)} FROM ev",
    "assets": f"SELECT {sql_list(ASSETS)} FROM supplier",
    "inventory": f"SELECT {sql_list(INVENTORY)} FROM part",
    "brands": "SELECT DISTINCT p_type, p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS b FROM part",
    "advisories": f"SELECT {sql_list(ADVISORIES)} FROM brands",
    "dlp": f"SELECT {sql_list(DLP)}, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS at FROM orders",
    "requests": f"SELECT {sql_list(REQUESTS)} FROM documents",
}
_NEEDS = {"reads": ["ev"], "logins": ["ev"], "control": ["ev"], "advisories": ["brands"]}


def with_tables(*names: str, sql: str, more: dict[str, str] | None = None) -> str:
    """`sql` after the common tables it names."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return f"WITH {', '.join(parts)} {sql}"
