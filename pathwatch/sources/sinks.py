"""Results as files, and the small reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RuleConfig


def write_snapshot(frames: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """One folder per frame."""
    for name, df in frames.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")


def export(frames: dict[str, DataFrame], path: str, most: int) -> None:
    """write_snapshot() of a whole dataset of at most `most` rows in all; a larger one is refused before anything is written."""
    if sum(df.limit(most + 1).count() for df in frames.values()) > most:
        raise ValueError(f"the dataset has more than {most} rows")
    write_snapshot(frames, path)


def current(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of the newest snapshot in `history` (snapshot_id, at); of equal times the largest id."""
    newest = history.agg(F.max(F.struct("at", "snapshot_id")).alias("x")).select(F.col("x.snapshot_id").alias("snapshot_id"))
    return rows.join(F.broadcast(newest), "snapshot_id")  # one row


def write_rules(recommended: DataFrame, base: RuleConfig, path: str) -> RuleConfig:
    """Write the recommended rule settings as one JSON row; without a recommendation nothing is written."""
    best = recommended.first()
    if best is None:
        raise ValueError("there is no recommendation to save")
    from dataclasses import asdict

    config = RuleConfig.load({**asdict(base), "window_seconds": best.window_seconds, "distinct_file_threshold": best.threshold})
    recommended.sparkSession.createDataFrame([asdict(config)]).coalesce(1).write.mode("overwrite").json(path)
    return config


def markdown(total: DataFrame, per_rule: DataFrame, cells: DataFrame) -> str:
    """An evaluation in Markdown; the frames hold a few dozen aggregate rows."""
    t = total.first().asDict()
    lines = ["# Evaluation", "", "| Metric | Value |", "|---|---|", *[f"| {k} | {'not measured' if v is None else v} |" for k, v in t.items()], "", "| Rule | Alerts | TP | FP | FN |", "|---|---|---|---|---|"]
    lines += [f"| {r.rule} | {r.alerts} | {r.tp} | {r.fp} | {r.fn} |" for r in per_rule.orderBy("rule").collect()]
    lines += ["", "| Window | Threshold | Alerts | TP | FP |", "|---|---|---|---|---|"]
    lines += [f"| {r.window_seconds} | {r.threshold} | {r.alerts} | {r.tp} | {r.fp} |" for r in cells.orderBy("window_seconds", "threshold").collect()]
    return "\n".join(lines) + "\n"
