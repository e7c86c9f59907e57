import json

import pytest
from pyspark.sql import functions as F

from pathwatch.sources import strict


def test_snapshot_documents(spark, tmp_path):
    good = {"schema_version": 1, "as_of": "2026-01-01T00:00:00Z", "assets": [{"id": "a", "kind": "vpn", "vulnerability": None}], "events": [{"id": "e", "type": "login", "actor": "x"}, {"id": "f", "type": "file_access", "bytes_read": 3}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({**good, "extra": 1}))
    (tmp_path / "c.json").write_text('{"schema_version": 1, "schema_version": 2}')
    (tmp_path / "d.json").write_text("[1]")
    docs = strict.read_documents(spark, str(tmp_path), strict.SNAPSHOT_KEYS)
    got = {r.source: r.problems for r in docs.collect()}
    assert got == {"a.json": [], "b.json": ["unknown_keys"], "c.json": ["not_an_object"], "d.json": ["not_an_object"]}
    ok = docs.where("size(problems) = 0")
    assert [r.id for r in strict.snapshot_assets(ok).collect()] == ["a"]
    assert [(r.id, r.bytes_read) for r in strict.snapshot_events(ok, "file_access").collect()] == [("f", 3)]
    with pytest.raises(Exception, match="invalid document"):
        strict.strict(docs).collect()


def test_labels(spark):
    rows = spark.createDataFrame([(["e"], [], ["AS-003"]), (["bad id"], ["a"], ["AS-009"]), (None, [], [])], "malicious_event_ids array<string>, malicious_asset_ids array<string>, expect_rules array<string>")
    assert [r.problems for r in strict.label_problems(rows).collect()] == [[], ["bad_event_ids", "unknown_rules"], ["bad_event_ids"]]


def test_settings_are_refused_as_the_loader_does(spark):
    from pathwatch.config import RuleConfig

    cases = [{}, {"window_seconds": 10}, {"window_seconds": 9}, {"window_seconds": 300.0}, {"window_seconds": True}, {"window_seconds": "300"}, {"window_seconds": None}, {"cvss_priority_threshold": 7}, {"cvss_priority_threshold": 0.5}, {"cvss_priority_threshold": 10.5}, {"cvss_priority_threshold": False}, {"identity_conditions": "both"}, {"identity_conditions": "none"}, {"identity_conditions": 1}, {"x": 1}, {"sensitive_file_minimum": 101}, {"sensitive_file_minimum": 101, "distinct_file_threshold": 101}, {"distinct_file_threshold": 10**30}, {"stale_asset_hours": [1]}]
    rows = [(i, json.dumps(c)) for i, c in enumerate(cases)] + [(-1, "[1]"), (-2, "{"), (-3, None)]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, body string").select("i", strict.setting_problems(F.col("body")).alias("p")).collect()}

    def refused(c):
        try:
            RuleConfig.load(c)
        except (ValueError, TypeError):
            return True
        return False

    assert [bool(got[i]) for i in range(len(cases))] == [refused(c) for c in cases]
    assert got[-1] == got[-2] == got[-3] == ["not_an_object"]


def test_settings_are_parsed_once(spark):
    rows = spark.createDataFrame([('{"window_seconds": 300}',), ("[1]",), (None,)], "body string")
    found = rows.select(strict.setting_problems(F.col("body")).alias("p"))
    assert [r.p for r in found.collect()] == [[], ["not_an_object"], ["not_an_object"]]
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
