"""Content decisions: requests against grants, secrets and personal data in texts, traffic and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..schemas import DATA_CLASSES
from .rules import reasons

ACTIONS = ["ai.prompt", "mail.send", "storage.upload", "usb.write", "agent.read", "agent.write", "agent.execute", "agent.delete", "agent.share", "agent.send"]
HUMAN_ACTIONS = ["agent.execute", "agent.delete", "agent.share", "agent.send"]
TEXT_BYTES = 262_144
#: What each decision rule says, and whether it blocks.
RULES = {
    "PG-001": ("no grant covers this destination", True),
    "PG-002": ("confidential or restricted data", True),
    "PG-003": ("a secret was found", True),
    "PG-004": ("the data class is unknown", False),
    "PG-005": ("an agent action needs a person", False),
    "PG-006": ("personal data was found", False),
    "PG-007": ("the grant doesn't cover this data class", True),
}


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows with `_repeated`: whether their event_id comes more than once. Only ids are counted, so texts aren't sorted with them."""
    again = rows.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id", F.lit(True).alias("_again"))
    return rows.join(again.hint("merge"), "event_id", "left").withColumn("_repeated", F.coalesce("_again", F.lit(False))).drop("_again")


def request_problems(requests: DataFrame) -> DataFrame:
    """Requests with the array `problems` of what is wrong with each.

    A text's length is taken before repeated ids are joined, so that a caller who doesn't ask for texts sorts none.
    """
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    agent = F.startswith("action", F.lit("agent."))
    rows = _repeated(requests.withColumn("_short", F.octet_length("text") <= TEXT_BYTES))
    return rows.withColumn("problems", reasons((bad(F.col("event_id").rlike(r"^EV-[0-9]{1,12}$")), "bad_event_id"), (F.col("_repeated"), "repeated_event_id"), (bad(F.col("action").isin(ACTIONS)), "bad_action"), (bad(F.col("data_class").isin(DATA_CLASSES)), "bad_data_class"), (bad(F.col("_short")), "text_too_long"), (agent != F.col("tool").isNotNull(), "tool_only_for_agents"))).select(*requests.columns, "problems")


def grant_problems(grants: DataFrame) -> DataFrame:
    """Grants with `problems`: only reading agents, only public and internal data, each combination once."""
    key = Window.partitionBy("action", "destination", "tool")
    write = F.col("action").isin(*HUMAN_ACTIONS, "agent.write")
    wide = ~F.coalesce(F.forall("data_classes", lambda c: c.isin("public", "internal")), F.lit(False))
    return grants.withColumn("problems", reasons((write, "action_needs_a_person"), (wide, "class_can't_be_granted"), (F.count("*").over(key) > 1, "repeated_grant")))


def preflight(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """(event_id, action, decision, rule_ids, state): block if a rule blocks, else review if any applies, else allow.

    A grant matches on action, destination and tool, null with null; text is NFKC-normalized before any pattern. Grants
    are a policy of at most a few hundred rows; their size is Spark's to weigh.
    """
    r, g = requests.alias("r"), grants.select("action", "destination", "tool", "data_classes", F.lit(True).alias("granted")).alias("g")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("action", "destination", "tool")]
    df = r.join(g, same[0] & same[1] & same[2], "left").select("r.*", "granted", "data_classes").withColumn("_text", s.nfkc(F.col("text")))
    human, cls = F.col("action").isin(HUMAN_ACTIONS), F.col("data_class")
    covered = F.coalesce(F.array_contains("data_classes", cls), F.lit(False))
    tests = {
        "PG-005": human,
        "PG-001": ~human & F.col("granted").isNull(),
        "PG-007": ~human & F.col("granted").isNotNull() & cls.isin("public", "internal") & ~covered,
        "PG-002": cls.isin("confidential", "restricted"),
        "PG-004": cls == "unknown",
        "PG-003": s.matches(F.col("_text"), s.SECRET),
        "PG-006": s.matches(F.col("_text"), s.PERSONAL),
    }
    df = df.withColumn("rule_ids", reasons(*[(c, k) for k, c in tests.items()]))
    blocking = F.array(*[F.lit(k) for k, (_, blocks) in RULES.items() if blocks])
    decision = F.when(F.arrays_overlap("rule_ids", blocking), "block").when(F.size("rule_ids") > 0, "review").otherwise("allow")
    return df.select("event_id", "action", decision.alias("decision"), "rule_ids", F.lit("evaluated").alias("state"))


def replay(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """preflight() over past requests, whose execution isn't known; a repeated id is an error."""
    checked = _repeated(requests).withColumn("event_id", F.when(~F.col("_repeated"), F.col("event_id")).otherwise(F.raise_error(F.lit("an event id comes twice")))).select(*requests.columns)
    return preflight(checked, grants).withColumn("state", F.lit("historical_execution_unknown"))


def report(decisions: DataFrame) -> DataFrame:
    """Decisions with a message for each rule."""
    table = F.create_map(*[F.lit(x) for k, (text, _) in RULES.items() for x in (k, text)])
    found = F.transform("rule_ids", lambda r: F.try_element_at(table, r))
    return decisions.withColumn("messages", F.when(F.size("rule_ids") == 0, F.array(F.lit("no rule applies to what was supplied"))).otherwise(found))


def decision_findings(decisions: DataFrame) -> DataFrame:
    """Findings of what wasn't allowed, without payload or destination."""
    rows = decisions.where("decision <> 'allow'")
    return rows.select(s.finding_id("PREFLIGHT", F.array("event_id")).alias("id"), F.lit("PREFLIGHT").alias("rule"), F.when(F.col("decision") == "block", "P1").otherwise("P2").alias("priority"), F.col("rule_ids").alias("reasons"), F.array("event_id").alias("evidence_ids"), F.lit("preflight").alias("kind"))


def verdict(text: Column, cut: Column | None = None) -> Column:
    """block for a secret, review for personal data or a text that was `cut`, else no_findings; unread for null, which is never clean."""
    found = s.matches(text, s.PERSONAL) if cut is None else s.matches(text, s.PERSONAL) | F.coalesce(cut, F.lit(True))
    return F.when(text.isNull(), "unread").when(s.matches(text, s.SECRET), "block").when(found, "review").otherwise("no_findings")


def inspect_texts(texts: DataFrame, column: str = "text", normalize: bool = True, cut: str | None = None) -> DataFrame:
    """Rows with their `verdict`; texts are NFKC-normalized first unless told not to. `cut` names a flag of what was left out of a text."""
    c = s.nfkc(F.col(column)) if normalize else F.col(column)
    return texts.withColumn("_text", c).withColumn("verdict", verdict(F.col("_text"), F.col(cut) if cut else None)).drop("_text")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Cases of measure() in JSON lines: text, or parts that are joined to one."""
    return spark.read.schema("id string, category string, expect string, text string, parts array<string>").json(path)


def measure(cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((category, total, detected, missed, false_alarms), (category, id, kind) of each wrong case, one row of recall,
    precision and false-positive rate).

    cases: id, category, expect (detect or clean), text or parts.
    """
    text = F.coalesce("text", F.array_join("parts", "")) if "parts" in cases.columns else F.col("text")
    rows = inspect_texts(cases.withColumn("_text", text), "_text").withColumn("hit", F.col("verdict").isin("block", "review"))
    want = F.col("expect") == "detect"
    per = rows.groupBy("category").agg(F.count("*").alias("total"), F.count_if("hit").alias("detected"), F.count_if(want & ~F.col("hit")).alias("missed"), F.count_if(~want & F.col("hit")).alias("false_alarms"))
    wrong = rows.where(want != F.col("hit")).select("category", "id", F.when(want, "missed").otherwise("false_alarm").alias("kind"))
    tp, fp = F.count_if(want & F.col("hit")), F.count_if(~want & F.col("hit"))
    pos, neg = F.count_if(want), F.count_if(~want)
    return per, wrong, rows.agg(tp.alias("tp"), fp.alias("fp"), F.round(F.try_divide(tp, pos), 4).alias("recall"), F.round(F.try_divide(tp, tp + fp), 4).alias("precision"), F.round(F.try_divide(fp, neg), 4).alias("false_positive_rate"))


def prompt_traffic(traffic: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """Requests (url, method, body) that may carry prompts: a listed host, a method with a body, and 40 characters of text.

    `text` is null for a body without text: it can't be inspected, which isn't clean. `cut` tells that some was left out,
    and such a body counts whatever the length of the rest.
    """
    host = F.try_parse_url("url", F.lit("HOST"))
    rows = traffic.where(F.coalesce(host.isin(hosts or s.KNOWN_HOSTS), F.lit(False)) & F.upper("method").isin("POST", "PUT", "PATCH"))
    rows = rows.withColumn("_leaves", s.leaves(F.col("body"))).withColumn("endpoint", s.endpoint_label(F.col("url"), hosts))
    rows = rows.withColumn("text", F.col("_leaves.text")).withColumn("cut", F.col("_leaves.cut")).drop("_leaves")
    return rows.where(F.col("text").isNull() | F.col("cut") | (F.length(F.trim("text")) >= 40))


def traffic_decision(outcome: Column, inspectable: Column, rules: Column) -> tuple[Column, Column, Column]:
    """(action, may be overridden, first 24 rules): no outcome blocks, what can't be inspected asks, else as the verdict says."""
    action = F.when(outcome.isNull() | (outcome == "error"), "block").when(~F.coalesce(inspectable, F.lit(False)), "confirm").when(outcome == "block", "block").when(outcome == "review", "confirm").when(outcome.isin("allow", "no_findings"), "allow").otherwise("block")
    return action, action == "confirm", F.slice(rules, 1, 24)


def bundle_decisions(parts: DataFrame) -> DataFrame:
    """Per bundle of parts (bundle_id, verdict, complete, rules, findings): the worst verdict and what it rests on."""
    rank = F.when(F.col("verdict") == "block", 2).when(F.col("verdict").isin("review", "unread"), 1).otherwise(0)
    out = parts.groupBy("bundle_id").agg(F.max(rank).alias("r"), F.coalesce(F.bool_and("complete"), F.lit(False)).alias("coverage_complete"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("rules")))), 1, 24).alias("rules"), F.sum("findings").alias("findings"))
    return out.select("bundle_id", F.when(F.col("r") == 2, "block").when((F.col("r") == 1) | ~F.col("coverage_complete"), "review").otherwise("no_findings").alias("decision"), "coverage_complete", "rules", "findings")
