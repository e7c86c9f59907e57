"""Posture: inventory against advisories and exploited vulnerabilities, VPN controls, transfer rules, manifest drift."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import casefold, opaque_token, version
from .rules import is_true, reasons


def first_observations(events: DataFrame) -> DataFrame:
    """One row per (source, event_id): the earliest, then that of least content."""
    order = Window.partitionBy("source", "event_id").orderBy("at", F.xxhash64(*events.columns))
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sensitive_transfers(events: DataFrame) -> DataFrame:
    """DLP-001: each confidential or restricted transfer outside managed tenants, whatever became of it."""
    return sensitive_only(first_observations(events))


def sensitive_only(events: DataFrame) -> DataFrame:
    """DLP-001 over observations that come once each."""
    rows = events.where((F.col("tenant") != "managed") & F.col("data_class").isin("confidential", "restricted"))
    return rows.select(F.lit("DLP-001").alias("rule"), "source", "actor", F.array("event_id").alias("evidence_ids"), F.col("outcome").alias("observed_outcome"), F.lit("requires_review").alias("verdict"), F.lit(False).alias("leak_confirmed"))


def repeated_transfers(events: DataFrame, window: int = 86400) -> DataFrame:
    """DLP-002: for each actor the first three transfers to personal or unknown tenants within a day."""
    rows = first_observations(events).where(F.col("tenant").isin("personal", "unknown"))
    order = Window.partitionBy("actor").orderBy("at", "source", "event_id")
    lagged = rows.select("actor", "at", "source", "event_id", F.lag("at", 2).over(order).alias("start"), F.array(F.lag("event_id", 2).over(order), F.lag("event_id").over(order), F.col("event_id")).alias("evidence_ids"))
    hits = lagged.where(F.col("at") - F.col("start") <= window)
    first = hits.groupBy("actor").agg(F.min_by("evidence_ids", F.struct("at", "source", "event_id")).alias("evidence_ids"))
    return first.select(F.lit("DLP-002").alias("rule"), "actor", "evidence_ids", F.lit("requires_review").alias("verdict"), F.lit(False).alias("leak_confirmed"))


#: Assets of one product that a task compares with the product's advisories; more are dealt over several tasks.
DEAL = 100_000
_STAB = "id string, cve string, known_exploited boolean, fixed string, source string"
_STAB_ARROW = pa.schema([("id", pa.string()), ("cve", pa.string()), ("known_exploited", pa.bool_()), ("fixed", pa.string()), ("source", pa.string())])


def _stab(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of versions with ranges, from rows sorted by product, deal and version, at each of which ranges begin before assets come.

    Ranges that are open are carried on in the order in which they end.
    """
    now, open_, turn = None, [], 0
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if (key := (r["_vendor"], r["_product"], r["_deal"])) != now:
                now, open_ = key, []
            while open_ and open_[0][0] <= r["_at"]:
                heappop(open_)
            if r["id"] is None:
                turn += 1
                heappush(open_, (r["_high"], turn, (r["cve"], r["known_exploited"], r["fixed"], r["source"])))
            else:
                out += [(r["id"], *range_) for _, _, range_ in open_]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _STAB_ARROW)], schema=_STAB_ARROW)


def affected(assets: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, cve, known_exploited, fixed, source): which assets (id, _vendor, _product, _v) lie in which ranges (_vendor, _product,
    _low, _high, cve, known_exploited, fixed, source), from _low up to before _high.

    Begins of ranges and assets of a product are sorted together by version and swept once; what is made is the matches
    alone, not all pairs of a product. The assets of a product of many are dealt, and its ranges go to every deal.
    """
    product = ["_vendor", "_product"]
    deals = assets.groupBy(*product).agg(F.ceil(F.count("*") / DEAL).cast("int").alias("_deals"))
    a = assets.join(deals.hint("merge"), product).select(*product, F.pmod(F.xxhash64("id"), "_deals").cast("int").alias("_deal"), F.col("_v").alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast("array<int>").alias("_high"), "id", *[F.lit(None).cast(k).alias(c) for c, k in (("cve", "string"), ("known_exploited", "boolean"), ("fixed", "string"), ("source", "string"))])
    b = ranges.join(deals.hint("merge"), product).select(*product, F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)).alias("_deal"), F.col("_low").alias("_at"), F.lit(0).alias("_turn"), "_high", F.lit(None).cast("string").alias("id"), "cve", "known_exploited", "fixed", "source")
    rows = a.unionByName(b).repartition(*product, "_deal").sortWithinPartitions(*product, "_deal", "_at", "_turn")
    return rows.mapInArrow(_stab, _STAB)


def assess(inventory: DataFrame, advisories: DataFrame, kev: DataFrame, observed_at: int, advisories_at: int, kev_at: int, now: int) -> DataFrame:
    """Per asset: asset_id, priority, status, matches, reasons.

    Products match by case-folded vendor and name; a version is affected from `introduced` up to before `fixed`. What
    can't be compared is unknown, never safe. kev is (cve). Asset ids are unique.
    """
    product = ["_vendor", "_product"]
    folded = [casefold(F.col("vendor")).alias("_vendor"), casefold(F.col("product")).alias("_product")]
    a = inventory.select("*", version(F.col("version")).alias("_v"), *folded)
    known = kev.select("cve").distinct().withColumn("_known", F.lit(True))
    adv = advisories.select(*folded, "cve", "fixed", "source", version(F.col("introduced")).alias("_low"), version(F.col("fixed")).alias("_high")).where("cve is not null")
    adv = adv.join(known.hint("merge"), "cve", "left").withColumn("known_exploited", F.coalesce("_known", F.lit(False)))
    comparable = F.coalesce(F.col("_low") < F.col("_high"), F.lit(False))
    facts = adv.groupBy(*product).agg(F.count("*").alias("candidates"), F.count_if(~comparable).alias("odd"))
    hits = affected(a.where("_v is not null").select("id", *product, "_v"), adv.where(comparable))
    found = hits.groupBy("id").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("cve", "known_exploited", "fixed", "source")))).alias("matches"))
    out = a.join(facts.hint("merge"), product, "left").join(found.hint("merge"), "id", "left")
    candidates, flags = F.coalesce("candidates", F.lit(0)), ("internet_exposed", "privileged_path", "sensitive_path")
    unset = F.col(flags[0]).isNull() | F.col(flags[1]).isNull() | F.col(flags[2]).isNull()
    why = reasons((candidates == 0, "no_vendor_data"), (F.lit(now - observed_at > 86400), "inventory_older_than_24h"), (F.lit(now - advisories_at > 172800 or now - kev_at > 172800), "feeds_older_than_48h"), (unset, "exposure_or_path_unknown"), ((candidates > 0) & (F.col("_v").isNull() | (F.col("odd") > 0)), "version_not_comparable"))
    out = out.withColumn("matches", F.coalesce("matches", F.array().cast(found.schema["matches"].dataType))).withColumn("reasons", why)
    hit = F.size("matches") > 0
    urgent = hit & is_true("internet_exposed") & (F.exists("matches", lambda m: m["known_exploited"]) | is_true("sensitive_path"))
    return out.select(F.col("id").alias("asset_id"), F.when(urgent, "P1").otherwise("P2").alias("priority"), F.when(hit, "affected").when(F.size("reasons") > 0, "unknown").otherwise("no_match_in_supplied_ranges").alias("status"), "matches", "reasons")


def vpn_controls(controls: DataFrame, now: int) -> DataFrame:
    """(rule, asset, priority): stale observations alone, else each unsafe or unknown setting."""
    stale = now - F.col("observed_at") > 86400
    tests = [("mfa_required", False, "VPN-MFA"), ("admin_public", True, "VPN-ADMIN-PUBLIC"), ("supported", False, "VPN-EOL")]
    found = [F.when(F.col(c) == F.lit(bad), F.struct(F.lit(rule).alias("rule"), F.lit("P1").alias("priority"))).when(F.col(c).isNull(), F.struct(F.lit("VPN-UNKNOWN").alias("rule"), F.lit("P2").alias("priority"))) for c, bad, rule in tests]
    old = F.array(F.struct(F.lit("VPN-STALE-CONTROLS").alias("rule"), F.lit("P2").alias("priority")))
    return controls.select(F.col("asset_id").alias("asset"), F.explode(F.when(stale, old).otherwise(F.array_compact(F.array(*found)))).alias("f")).select("f.rule", "asset", "f.priority")


def kev_freshness(feed: DataFrame, now: int) -> DataFrame:
    """From one row (published_at, fetched_at): basis, basis_at, fresh. A feed fetched over a minute before it was published is an error."""
    wrong = F.col("published_at") > F.col("fetched_at") + 60
    checked = F.when(wrong, F.raise_error(F.lit("publication and fetch times contradict each other"))).otherwise(F.coalesce("fetched_at", "published_at"))
    return feed.select(F.when(F.col("fetched_at").isNotNull(), "fetched_at").otherwise("published_at_fallback").alias("basis"), checked.cast("long").alias("basis_at")).withColumn("fresh", now - F.col("basis_at") <= 172800)


def risky_assets(posture: DataFrame, key: bytes, organization: str) -> DataFrame:
    """(organization, asset) tokens of affected P1 assets, as control events name them."""
    rows = posture.where("status = 'affected' and priority = 'P1'")
    return rows.select(opaque_token(key, F.lit("organization"), F.lit(organization)).alias("organization"), opaque_token(key, F.lit(organization + ":asset"), F.col("asset_id")).alias("asset"))


def tool_drift(manifest: DataFrame, approved: DataFrame) -> DataFrame:
    """Tools that are new or differ in any field from what was approved; the order of permissions counts."""
    fields = ["sha256", "permissions", "publisher"]
    base = approved.select("id", F.struct(*fields).alias("_old"))
    rows = manifest.select("id", F.struct(*fields).alias("_new")).join(base, "id", "left").where(~F.col("_new").eqNullSafe(F.col("_old")))
    return rows.select(F.col("id").alias("tool_id"), F.lit(True).alias("requires_reapproval"), F.lit("new_or_changed_manifest").alias("reason"))


def device_inventory(status: DataFrame, asset_id: str) -> DataFrame:
    """One-asset inventory from a device's status (status, http_method, version); a strange version is unknown, flags are null."""
    rows = status.where((F.col("status") == "success") & (F.col("http_method") == "GET"))
    v = F.ltrim(F.col("version"), F.lit("v"))
    return rows.select(F.lit(asset_id).alias("id"), F.when(v.rlike(r"^[0-9]{1,6}(\.[0-9]{1,6}){0,5}$"), v).otherwise("unknown").alias("version"), *[F.lit(None).cast("boolean").alias(c) for c in ("internet_exposed", "privileged_path", "sensitive_path")])


def inventory_problems(inventory: DataFrame) -> DataFrame:
    """Inventory rows with the array `problems` of what is wrong with each."""
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    named = lambda c: F.col(c).rlike(r"^[^\x00-\x1f]{1,200}$")
    repeated = F.count("*").over(Window.partitionBy("id")) > 1
    return inventory.withColumn("problems", reasons((bad(F.col("id").rlike(r"^[^\x00-\x1f]{1,256}$")), "bad_id"), (repeated, "repeated_id"), (bad(named("vendor")), "bad_vendor"), (bad(named("product")), "bad_product"), (bad(named("version")), "bad_version")))


def advisory_problems(advisories: DataFrame) -> DataFrame:
    """Advisories with `problems`: ids are CVE ids, sources are HTTPS addresses, and each names a vendor and a product."""
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    named = lambda c: F.col(c).rlike(r"^[^\x00-\x1f]{1,200}$")
    return advisories.withColumn("problems", reasons((bad(F.col("cve").rlike(r"^CVE-[0-9]{4}-[0-9]{4,19}$")), "bad_cve"), (bad(F.col("source").rlike("^https://")), "bad_source"), (bad(named("vendor")), "bad_vendor"), (bad(named("product")), "bad_product")))


def feed_time_problems(feeds: DataFrame, now: int) -> DataFrame:
    """Feeds (observed_at) with `problems`: a time is there and at most a minute ahead."""
    return feeds.withColumn("problems", reasons((~F.coalesce(F.col("observed_at") <= now + 60, F.lit(False)), "bad_time")))


def kev_entries(raw: DataFrame) -> DataFrame:
    """(cve) of a feed read as JSON with `vulnerabilities`; a malformed id rejects the whole feed."""
    cve = raw.select(F.explode("vulnerabilities.cveID").alias("cve"))
    ok = F.coalesce(F.col("cve").rlike(r"^CVE-[0-9]{4}-[0-9]{4,19}$"), F.lit(False))
    return cve.select(F.when(ok, F.col("cve")).otherwise(F.raise_error(F.lit("malformed CVE id in the feed"))).alias("cve"))


PLANS = {"exposure": "patch_or_isolate", "identity": "verify_session", "bulk": "review_access", "correlation": "contain_and_investigate"}


def response_plans(findings: DataFrame, plans: dict[str, str] | None = None, default: str = "manual_review") -> DataFrame:
    """Findings with the response plan of their kind."""
    table = plans or PLANS
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return findings.withColumn("plan", F.coalesce(F.try_element_at(lookup, F.col("kind")), F.lit(default)))
