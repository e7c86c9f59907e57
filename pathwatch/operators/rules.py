"""Detection rules over one snapshot: asset hygiene, privileged logins, bulk access, and their correlation.

Every function takes frames as in schemas.py and returns findings. Conditions are tested as IS TRUE and IS FALSE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RULE_VERSION, RuleConfig
from ..functions.scalars import finding_id, reasons

_EXTRA = {"asset_id": "string", "actor": "string", "session": "string", "gateway_id": "string", "at": "long", "cvss": "double", "reference": "string", "distinct_files": "long", "sensitive_files": "long", "hypothesis": "boolean"}


def is_true(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).eqNullSafe(True)


def is_false(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).eqNullSafe(False)


def findings(df: DataFrame, rule: str, kind: str, title: str, config: RuleConfig) -> DataFrame:
    """The common columns of a finding; what a rule doesn't set is null."""
    have = set(df.columns)
    return df.select(
        finding_id(rule, F.col("evidence_ids")).alias("id"),
        F.lit(rule).alias("rule"),
        F.lit(RULE_VERSION).alias("rule_version"),
        F.lit(config.digest).alias("rule_config_digest"),
        "priority",
        F.lit(title).alias("title"),
        "reasons",
        "evidence_ids",
        F.lit("requires_review").alias("verdict"),
        F.lit(kind).alias("kind"),
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _EXTRA.items()],
    )


def exposed_pending(assets: DataFrame) -> DataFrame:
    """Ids of assets that are on the internet with a patch pending."""
    return assets.where((F.col("patch_state") == "pending") & is_true("internet_exposed")).select("id")


def exposure(assets: DataFrame, config: RuleConfig) -> DataFrame:
    """AS-001: pending patches, by exposure, known exploitation and reach."""
    v = F.col("vulnerability")
    exposed, known = is_true("internet_exposed"), is_true(v["known_exploited"])
    path = is_true("privileged_path") & is_true("sensitive_path")
    critical = exposed & (known | path)
    severe = F.coalesce(v["cvss"], F.lit(0.0)) >= config.cvss_priority_threshold
    df = assets.where(F.col("patch_state") == "pending").select(
        F.when(critical, "P1").when(exposed | severe, "P2").otherwise("P3").alias("priority"),
        reasons((F.lit(True), "patch_not_applied"), (v.isNull(), "no_vulnerability_reference"), (exposed, "internet_exposed"), (known, "known_exploited"), (path, "path_to_privilege_and_data"), (critical & (v["cvss"] < config.cvss_priority_threshold), "exposure_outweighs_cvss")).alias("reasons"),
        F.array(F.concat(F.lit("asset:"), "id")).alias("evidence_ids"),
        F.col("id").alias("asset_id"),
        v["cvss"].alias("cvss"),
        v["reference"].alias("reference"),
    )
    return findings(df, "AS-001", "exposure", "Review the unapplied patch", config)


def asset_coverage(assets: DataFrame, as_of: int | Column, config: RuleConfig) -> DataFrame:
    """AS-005: assets with unknown facts, or observed too long ago."""
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    unknown = F.col("internet_exposed").isNull() | F.col("privileged_path").isNull() | F.col("sensitive_path").isNull() | (F.col("patch_state") == "unknown")
    stale = as_of - F.col("observed_at") > config.stale_asset_hours * 3600
    df = assets.where(unknown | stale).select(F.lit("P2").alias("priority"), F.array(F.lit("missing_or_stale_asset_data")).alias("reasons"), F.array(F.concat(F.lit("asset:"), "id")).alias("evidence_ids"), F.col("id").alias("asset_id"))
    return findings(df, "AS-005", "coverage", "Check missing or stale asset data", config)


def suspicious(config: RuleConfig) -> Column:
    """A privileged login whose device or approval condition is known to fail."""
    a, b = is_false("device_trusted"), is_false("approved")
    return is_true("privileged") & ((a & b) if config.identity_conditions == "both" else (a | b))


def identity(logins: DataFrame, config: RuleConfig) -> DataFrame:
    """AS-002: successful suspicious logins. Stateless, so it runs on a stream as it is."""
    df = logins.where(is_true("success") & suspicious(config)).select(F.lit("P2").alias("priority"), F.array(F.lit("privileged_login_conditions_" + config.identity_conditions), F.lit("not_a_conclusion_of_misuse")).alias("reasons"), F.array("id").alias("evidence_ids"), "actor", "session", "gateway_id", "at")
    return findings(df, "AS-002", "identity", "Check the privileged-login conditions", config)


GROUP = ["actor", "session", "asset_id"]


#: A group is swept in slices of time of so many windows each, so that no task needs a whole group.
SLICE = 16


def window_counts(reads: DataFrame, windows: list[int], threshold: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Each read of a complete group with n_<window>: how many distinct files its group's trailing window holds, for each of `windows`.

    A window reaches back so many seconds, both ends included. A read adds a file unless the same file was read within
    the window before it, and a file leaves when no later read renews it; counts are running sums of these steps, for all
    windows over one sort and without sets. Time is cut into slices, and a slice also gets the reads of the widest window
    before it, which is all that its counts depend on: a group of many reads is many tasks. Slices of fewer files than
    `threshold` are dropped. `keep` names further columns, and rows come with `slice` for windows over them.
    """
    widest = max(windows)
    length = SLICE * max(widest, 1)
    own = F.floor(F.col("at") / length)
    near_end = F.col("at") + widest >= (own + 1) * length
    rows = reads.where(" and ".join(f"{c} is not null" for c in GROUP)).select(*GROUP, "file_id", "at", "id", *(keep or []), own.alias("own"), F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))).alias("slice"))
    group = [*GROUP, "slice"]
    by_file, whole = Window.partitionBy(*group, "file_id").orderBy("at", "id"), Window.partitionBy(*group)
    rows = rows.repartition(*group).withColumn("before", F.lag("at").over(by_file)).withColumn("after", F.lead("at").over(by_file))
    rows = rows.withColumn("files", F.count_if(F.col("before").isNull()).over(whole)).where(F.col("files") >= threshold)
    upto = whole.orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    enters = {w: F.count_if(F.col("before").isNull() | (F.col("at") - F.col("before") > w)).over(upto) for w in windows}
    gone = {w: F.count_if(F.col("after").isNull() | (F.col("after") - F.col("at") > w)).over(whole.orderBy("at").rangeBetween(Window.unboundedPreceding, -w - 1)) for w in windows}
    rows = rows.select("*", *[c.alias(f"n_{w}") for w, c in enters.items()])
    rows = rows.select(*[c for c in rows.columns if not c.startswith("n_")], *[(F.col(f"n_{w}") - c).alias(f"n_{w}") for w, c in gone.items()])
    return rows.drop("before", "after", "files")


def window_peaks(reads: DataFrame, window_seconds: int, threshold: int = 1) -> DataFrame:
    """(actor, session, asset_id, peak_at, peak_id, peak): the first read at which the trailing window holds the most files.

    Peaks of slices are merged by their maximum; reads with null keys belong to no group.
    """
    counted = window_counts(reads, [window_seconds], threshold).where("slice = own")
    best = F.min(F.struct((-F.col(f"n_{window_seconds}")).alias("c"), "at", "id")).alias("b")
    peaks = counted.groupBy(*GROUP).agg(best)
    return peaks.select(*GROUP, F.col("b.at").alias("peak_at"), F.col("b.id").alias("peak_id"), (-F.col("b.c")).cast("long").alias("peak")).where(F.col("peak") >= threshold)


def bulk_windows(reads: DataFrame, config: RuleConfig) -> DataFrame:
    """Peaks that reach the threshold, with the reads in their window, in order of time and id."""
    peaks = window_peaks(reads, config.window_seconds, config.distinct_file_threshold)
    inside = (F.col("at") >= F.col("peak_at") - config.window_seconds) & (F.struct("at", "id") <= F.struct(F.col("peak_at").alias("at"), F.col("peak_id").alias("id")))
    rows = reads.join(peaks.hint("merge"), GROUP).where(inside)
    sensitive = F.count_distinct(F.when(is_true("sensitive"), F.col("file_id")))
    return rows.groupBy(*GROUP, "peak_at", "peak").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("w"), sensitive.alias("sensitive_files")).select(*GROUP, F.col("peak_at").alias("at"), F.col("peak").alias("distinct_files"), "sensitive_files", F.col("w.id").alias("evidence_ids"), F.col("w")[0]["at"].alias("window_start"))


def bulk_access(windows: DataFrame, config: RuleConfig) -> DataFrame:
    """AS-003 from bulk_windows()."""
    df = windows.select(F.lit("P2").alias("priority"), F.array(F.lit("many_distinct_files_in_window"), F.lit("reads_do_not_prove_a_leak")).alias("reasons"), "evidence_ids", *GROUP, "distinct_files", "sensitive_files", "at")
    return findings(df, "AS-003", "bulk", "Bulk file access in a short window", config)


def latest_login(windows: DataFrame, logins: DataFrame, lookback: int) -> DataFrame:
    """Each window with the latest successful login of its actor and session at most `lookback` before it; ties: least id."""
    login = logins.where(is_true("success")).select("actor", "session", F.col("id").alias("login_id"), F.col("at").alias("login_at"), "gateway_id", "privileged", "device_trusted", "approved")
    delta = F.col("window_start") - F.col("login_at")
    pairs = windows.join(login.hint("merge"), ["actor", "session"]).where((delta >= 0) & (delta <= lookback))
    latest = F.min_by(F.struct(*[c for c in login.columns if c not in ("actor", "session")]), F.struct(-F.col("login_at"), "login_id")).alias("login")
    found = pairs.groupBy(*GROUP).agg(latest).select(*GROUP, "login.*")
    return windows.join(found.hint("merge"), GROUP)


def correlated(windows: DataFrame, logins: DataFrame, assets: DataFrame, config: RuleConfig) -> DataFrame:
    """AS-004: a bulk window whose latest login is suspicious and came through an exposed, unpatched gateway."""
    rows = latest_login(windows, logins, config.login_lookback_seconds).where(suspicious(config) & (F.col("sensitive_files") >= config.sensitive_file_minimum))
    rows = rows.join(exposed_pending(assets).withColumnRenamed("id", "gateway_id").hint("merge"), "gateway_id", "left_semi")
    evidence = F.concat(F.array(F.concat(F.lit("asset:"), "gateway_id"), F.col("login_id")), "evidence_ids")
    df = rows.select(F.lit("P1").alias("priority"), F.array(F.lit("gateway_login_and_bulk_access_related"), F.lit("same_user_and_session"), F.lit("exploitation_unconfirmed")).alias("reasons"), evidence.alias("evidence_ids"), *GROUP, "gateway_id", "distinct_files", "sensitive_files", "at", F.lit(True).alias("hypothesis"))
    return findings(df, "AS-004", "correlation", "Correlated case: suspected maintenance-account compromise", config)


def analyze(assets: DataFrame, logins: DataFrame, reads: DataFrame, as_of: int, config: RuleConfig | None = None) -> DataFrame:
    """All findings; in_order() gives the order of review."""
    config = config or RuleConfig()
    windows = bulk_windows(reads, config)
    parts = [exposure(assets, config), asset_coverage(assets, as_of, config), identity(logins, config), bulk_access(windows, config), correlated(windows, logins, assets, config)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_order(found: DataFrame) -> DataFrame:
    """Priority, then correlations, then id."""
    return found.orderBy("priority", F.when(F.col("kind") == "correlation", 0).otherwise(1), "id")


def coverage(assets: DataFrame, logins: DataFrame, reads: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """One row: which sources are missing, how many facts are unknown, how many live connectors are verified."""
    nulls = lambda *cs: F.coalesce(sum((F.count_if(F.col(c).isNull()) for c in cs[1:]), F.count_if(F.col(cs[0]).isNull())), F.lit(0))
    a = assets.agg(F.count("*").alias("n_assets"), nulls("internet_exposed", "privileged_path", "sensitive_path").alias("unknown_asset_fields"))
    b = logins.agg(F.count("*").alias("n_logins"), nulls("privileged", "device_trusted", "approved").alias("unknown_login_fields"))
    c = reads.agg(F.count("*").alias("n_reads"), nulls("sensitive").alias("unknown_classifications"), nulls("bytes_read").alias("unknown_read_sizes"))
    out = a.crossJoin(b).crossJoin(c)  # one row each
    live = F.lit(0).cast("long")
    if provenance is not None:
        out = out.crossJoin(provenance.agg(F.count_distinct(F.when(is_true("verified") & (F.col("connector") == "okta-system-log-api"), F.col("connector"))).alias("live")))
        live = F.col("live")
    missing = reasons((F.col("n_assets") == 0, "assets"), (F.col("n_logins") == 0, "logins"), (F.col("n_reads") == 0, "file_access"))
    return out.select(missing.alias("missing_sources"), "unknown_asset_fields", "unknown_login_fields", "unknown_classifications", "unknown_read_sizes", live.alias("live_connectors"))
