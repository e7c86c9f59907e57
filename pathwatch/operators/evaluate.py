"""Findings against labels: precision, recall and false positives per day, over a grid of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RuleConfig
from . import rules

BEHAVIORAL, HYGIENE = ["AS-002", "AS-003", "AS-004"], ["AS-001", "AS-005"]
THRESHOLDS, WINDOWS = [60, 100, 150, 200, 300, 500, 800], [120, 300, 600]


def marked(findings: DataFrame, malicious: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Findings with `tp`: whether evidence meets a label. malicious: (keys..., evidence_id)."""
    keys = keys or []
    hit = findings.select("id", *keys, F.explode("evidence_ids").alias("evidence_id")).join(malicious.hint("merge"), [*keys, "evidence_id"], "left_semi").select("id", *keys).distinct().withColumn("tp", F.lit(True))
    return findings.join(hit.hint("merge"), ["id", *keys], "left").withColumn("tp", F.coalesce("tp", F.lit(False)))


def scores(marked_findings: DataFrame, expected: DataFrame, spans: DataFrame) -> DataFrame:
    """Per scenario and behavioural rule: alerts, tp, fp, fn, and the confusion cell.

    expected: (scenario, rule); spans: (scenario, days). Every scenario is crossed with the three rules only.
    """
    grid = spans.select("scenario", "days", F.explode(F.array(*[F.lit(r) for r in BEHAVIORAL])).alias("rule"))
    counts = marked_findings.groupBy("scenario", "rule").agg(F.count("*").alias("alerts"), F.count_if("tp").alias("tp"))
    rows = grid.join(counts.hint("merge"), ["scenario", "rule"], "left").join(expected.select("scenario", "rule", F.lit(True).alias("wanted")).distinct().hint("merge"), ["scenario", "rule"], "left")
    alerts, tp, wanted = F.coalesce("alerts", F.lit(0)), F.coalesce("tp", F.lit(0)), F.coalesce("wanted", F.lit(False))
    cell = F.when(wanted & (tp > 0), "tp").when(wanted, "fn").when(alerts > 0, "fp").otherwise("tn")
    return rows.select("scenario", "rule", "days", alerts.alias("alerts"), tp.alias("tp"), (alerts - tp).alias("fp"), (wanted & (tp == 0)).cast("long").alias("fn"), wanted.alias("expected"), cell.alias("cell"))


def totals(scored: DataFrame) -> DataFrame:
    """One row: alert precision, recall of expected rules, and false positives per day; null where there is nothing to divide by."""
    ratio = lambda a, b: F.round(F.try_divide(a, b), 4)
    tp, fp, fn, expected = F.sum("tp"), F.sum("fp"), F.sum("fn"), F.count_if("expected")
    days = scored.groupBy("scenario").agg(F.first("days").alias("days")).agg(F.sum("days").alias("days"))
    out = scored.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("missed"), expected.alias("expected"), ratio(tp, tp + fp).alias("precision"), ratio(expected - fn, expected).alias("recall"))
    return out.crossJoin(days).withColumn("fp_per_day", F.round(F.try_divide("fp", "days"), 2))  # one row each


def case_metrics(scored: DataFrame) -> DataFrame:
    """One row of the scenario-by-rule confusion: tp, fp, tn, fn, precision, recall, f1, fpr, fnr."""
    n = {k: F.count_if(F.col("cell") == k) for k in ("tp", "fp", "tn", "fn")}
    ratio = lambda a, b: F.round(F.try_divide(a, b), 4)
    return scored.agg(*[c.alias(k) for k, c in n.items()], ratio(n["tp"], n["tp"] + n["fp"]).alias("precision"), ratio(n["tp"], n["tp"] + n["fn"]).alias("recall"), ratio(2 * n["tp"], 2 * n["tp"] + n["fp"] + n["fn"]).alias("f1"), ratio(n["fp"], n["fp"] + n["tn"]).alias("fpr"), ratio(n["fn"], n["tp"] + n["fn"]).alias("fnr"))


def sweep(reads: DataFrame, malicious: DataFrame, thresholds: list[int] | None = None, windows: list[int] | None = None) -> DataFrame:
    """(window_seconds, threshold, alerts, tp, fp) of bulk access for each cell of the grid.

    All windows are counted over one sort of the reads. A peak depends on its window alone, so thresholds are filters over
    peaks; it is a true alert if the latest labelled read up to it lies in its window.
    """
    thresholds, windows = thresholds or THRESHOLDS, windows or WINDOWS
    labelled = malicious.select(F.col("evidence_id").alias("id")).distinct().withColumn("bad", F.lit(True))
    counted = rules.window_counts(reads.join(labelled.hint("merge"), "id", "left"), windows, min(thresholds), ["bad"])
    upto = Window.partitionBy(*rules.GROUP, "slice").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("last_bad", F.max(F.when(F.col("bad"), F.col("at"))).over(upto)).where("slice = own")
    best = [F.min(F.struct((-F.col(f"n_{w}")).alias("c"), "at", "id", F.coalesce(F.col("last_bad") >= F.col("at") - w, F.lit(False)).alias("tp"))).alias(f"b_{w}") for w in windows]
    peaks = counted.groupBy(*rules.GROUP).agg(*best)
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("window_seconds"), (-F.col(f"b_{w}.c")).alias("peak"), F.col(f"b_{w}.tp").alias("tp")) for w in windows])).alias("p")
    cells = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    found = peaks.select(each).select("p.*", cells).where("peak >= threshold").groupBy("window_seconds", "threshold").agg(F.count("*").alias("alerts"), F.count_if("tp").alias("tp"))
    grid = reads.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in windows])).alias("window_seconds")).select("window_seconds", cells)
    out = grid.join(found.hint("merge"), ["window_seconds", "threshold"], "left").select("window_seconds", "threshold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("alerts", "tp")])
    return out.withColumn("fp", F.col("alerts") - F.col("tp"))


def recommendation(cells: DataFrame, expected: int) -> DataFrame:
    """The cell of full recall with the fewest false positives, then the lowest threshold, then the widest window; none if there is none."""
    return cells.where(F.col("tp") >= expected).orderBy("fp", "threshold", F.desc("window_seconds")).limit(1)


def observations(total: DataFrame, recommended: DataFrame) -> list[str]:
    """What the tiny result rows say, in sentences."""
    t, r = total.first(), recommended.first()
    out = [f"{t.tp} true and {t.fp} false alerts; {t.missed} of {t.expected} expected detections missed."]
    if t.precision is not None and t.precision < 0.5:
        out.append("More than half of the alerts are false.")
    out.append(f"Recommended: threshold {r.threshold}, window {r.window_seconds} s." if r else "No cell has full recall; nothing is recommended.")
    return out
