"""A journal of HMAC-linked rows: building, verifying, pruning and exporting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hmac_sha256, pseudonym

ZERO = "0" * 64
ACTIONS = ["decision", "export", "ingest", "policy", "retention", "rules.configured"]
EXPORTED = ["seq", "at", "action", "rule_ids", "decision"]


def _mac(key: bytes) -> Column:
    quoted = [F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1) for c in ("at", "action", "payload", "prev")]
    body = F.concat(F.lit("["), F.concat_ws(",", F.col("seq").cast("string"), *quoted), F.lit("]"))
    return hmac_sha256(key, body.cast("binary"))


def expected_macs(journal: DataFrame, key: bytes) -> DataFrame:
    """Rows with `want`: the HMAC of their canonical [seq, at, action, payload, prev]."""
    return journal.withColumn("want", _mac(key))


def chain_problems(journal: DataFrame, key: bytes, anchor: tuple[int, str] = (0, ZERO)) -> DataFrame:
    """(seq, problem) of rows that break the chain after `anchor` (seq, mac).

    Each row is joined with its predecessor by number; no window over the whole journal is needed.
    """
    seq, tip = anchor
    rows = expected_macs(journal.where(F.col("seq") > seq), key)
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("mac").alias("_prior"))
    prior = F.when(F.col("seq") == seq + 1, F.lit(tip)).otherwise(F.col("_prior"))
    joined = rows.join(before, "seq", "left").withColumn("_prior", prior)
    problem = F.when(F.col("_prior").isNull(), "gap").when(F.col("prev") != F.col("_prior"), "broken_link").when(F.col("mac") != F.col("want"), "bad_mac")
    repeated = rows.groupBy("seq").count().where("count > 1").select("seq", F.lit("repeated_seq").alias("problem"))
    return joined.select("seq", problem.alias("problem")).where("problem is not null").unionByName(repeated)


def verified(journal: DataFrame, key: bytes, anchor: tuple[int, str] = (0, ZERO), tip: tuple[int, str] | None = None) -> bool:
    """Whether the chain holds; with `tip` (count, mac) also whether its end is still there."""
    if chain_problems(journal, key, anchor).limit(1).count():
        return False
    if tip is None:
        return True
    last = journal.orderBy(F.desc("seq")).limit(1).first()
    return (last.seq, last.mac) == tip if last else tip == anchor


def pruned(journal: DataFrame, before: str, now_minus_day: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row (seq, mac) of the new anchor): the longest prefix older than `before` goes, never a younger row."""
    if before > now_minus_day:
        raise ValueError("the last day is always kept")
    keep = journal.where(F.col("at") >= before).agg(F.min("seq").alias("first"))
    first = F.coalesce("first", F.lit(2**62))
    rest = journal.crossJoin(keep).where(F.col("seq") >= first).drop("first")  # one row
    gone = journal.crossJoin(keep).where(F.col("seq") < first)
    return rest, gone.agg(F.max("seq").alias("seq"), F.max_by("mac", "seq").alias("mac"))


def newest(journal: DataFrame, limit: int = 10_000, action: str | None = None) -> DataFrame:
    rows = journal.orderBy(F.desc("seq")).limit(limit)
    return rows.where(F.col("action") == action) if action else rows


def exported(journal: DataFrame, limit: int, actions: list[str] | None = None) -> DataFrame:
    """The last rows of allowed actions in ascending order, with allowed keys of the payload only."""
    rows = journal.where(F.col("action").isin(actions or ["decision", "ingest"])).orderBy(F.desc("seq")).limit(limit)
    v = F.from_json("payload", "rule_ids array<string>, decision string")
    return rows.select("seq", "at", "action", v["rule_ids"].alias("rule_ids"), v["decision"].alias("decision")).orderBy("seq")


def entries(decisions: DataFrame, key: bytes) -> DataFrame:
    """(action, payload) metadata rows of decisions (actor, target, decision, rule_ids): names pseudonymized, 24 rules at most."""
    ok = F.col("decision").isin("allow", "review", "block")
    body = F.to_json(F.struct(pseudonym(F.col("actor"), key, "actor").alias("actor"), F.when(ok, F.col("decision")).otherwise(F.raise_error(F.lit("bad decision"))).alias("decision"), F.slice("rule_ids", 1, 24).alias("rule_ids"), pseudonym(F.col("target"), key, "target").alias("target")))
    return decisions.select(F.lit("decision").alias("action"), body.alias("payload"))


def config_change(history: DataFrame, digest: str, at: str) -> DataFrame:
    """A rules.configured row if the latest one in `history` (at, digest) has another digest, else none."""
    last = history.agg(F.max_by("digest", "at").alias("last"))
    return last.where(~F.col("last").eqNullSafe(F.lit(digest))).select(F.lit(at).alias("at"), F.lit(digest).alias("digest"), F.lit("rules.configured").alias("action"))
