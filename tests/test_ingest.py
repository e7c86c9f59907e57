import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from pathwatch.functions import scalars as s
from pathwatch.operators import clean
from pathwatch.sources import idp, ingest
from pathwatch.sources.profiles import BUILT_IN, Profile, ProfileError, built_in


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_profiles_load_and_refuse():
    for name in BUILT_IN:
        assert built_in(name).name == name
    raw = BUILT_IN["generic-auth-csv"]
    for bad in ({**raw, "extra": 1}, {**raw, "format": "xml"}, {**raw, "map": {}}, {**raw, "skip_rows": True}, {**raw, "map": {**raw["map"], "at": {"field": "t", "const": 1}}}):
        with pytest.raises(ProfileError):
            Profile.load(bad)


def test_csv_import(spark, tmp_path):
    p = tmp_path / "auth.csv"
    p.write_text(
        "timestamp,event_id,user,session_id,gateway,result,account_type,device_state,change_ticket,secret_col\n"
        "2026-01-01T09:00:00,e1,taro,s1,gw 1,success,admin,unmanaged,CHG-1,x\n"
        "2026-01-01 00:00:00Z,e2,taro,s1,gw1,失敗,user,,none,x\n"
        "yesterday,e3,taro,s1,gw1,success,,,,x\n"
        "2026-01-01T09:00:00,e4,,s1,gw1,success,,,,x\n"
    )
    profile = built_in("generic-auth-csv")
    rows, skipped = ingest.scan(spark, str(p), profile)
    parsed = ingest.parse(rows, profile)
    got = {r.id: r for r in parsed.rows.collect()}
    assert set(got) == {"e1", "e2"} and skipped.count() == 0
    assert got["e1"].at == got["e2"].at == 1767225600  # the profile's zone is +09:00
    assert got["e1"].privileged is True and got["e1"].device_trusted is False and got["e1"].approved is True
    assert got["e2"].success is False and got["e2"].device_trusted is None and got["e2"].approved is False
    assert got["e1"].gateway_id.startswith("gw-1:") and "secret_col" not in parsed.rows.columns
    assert {(r.reason, r.n) for r in parsed.skipped.collect()} == {("missing_at", 1), ("missing_actor", 1)}
    q = ingest.quality([parsed]).first()
    assert (q.rows_read, q.rows_imported, q.rows_skipped) == (4, 2, 2)
    source = ingest.provenance(spark, str(p), parsed).first()
    assert source.sha256 == hashlib.sha256(p.read_bytes()).hexdigest() and source.verified


def test_a_log_is_cut_once_for_all_that_is_returned(spark, tmp_path):
    (tmp_path / "a.csv").write_text('timestamp,event_id,user,session_id,gateway,result\n2026-01-01T09:00:00,e1," t",s,gw 1,success\n2026-01-01T09:00:00,e2,,s,g,success\n')
    (tmp_path / "b.csv").write_text("timestamp,event_id,user,session_id,gateway,result\n")
    (tmp_path / "c.csv").write_text("timestamp,event_id,user,session_id,gateway,result\n,e3,t,s,g,failure\n")
    profile = built_in("generic-auth-csv")
    parsed = ingest.parse(ingest.scan(spark, str(tmp_path), profile)[0], profile)
    frames = [parsed.rows, parsed.skipped, parsed.unknown, parsed.read, ingest.quality([parsed]), ingest.normalized_identifiers(parsed.rows, "gateway_id")]
    assert not any("MapInArrow" in f._jdf.queryExecution().optimizedPlan().toString() for f in frames)
    got = [sorted(map(tuple, f.collect())) for f in frames[1:]]
    assert got[0] == [("a.csv", "missing_actor", 1), ("c.csv", "missing_at", 1)]
    assert got[1] == [("a.csv", c, 1) for c in ("approved", "device_trusted", "privileged")]
    assert got[2:] == [[("a.csv", 2), ("c.csv", 1)], [("a.csv", "login", 2, 1, 1), ("c.csv", "login", 1, 0, 1)], [(1,)]]


def test_a_log_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,event_id,user,session_id,gateway,result\n")
    profile = built_in("generic-auth-csv")
    parsed = ingest.parse(ingest.scan(spark, str(tmp_path), profile)[0], profile)
    assert [f.count() for f in (parsed.rows, parsed.skipped, parsed.unknown, parsed.read, ingest.quality([parsed]))] == [0] * 5
    assert ingest.normalized_identifiers(parsed.rows, "gateway_id").first().n == 0


@pytest.mark.parametrize("name", sorted(BUILT_IN))
def test_checked_rows_come_from_code_that_the_jvm_compiles(spark, monkeypatch, name):
    """HotSpot leaves methods beyond 8,000 bytes to its interpreter."""
    plans = []
    monkeypatch.setattr(ingest, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan()) or df)
    kind = "map<string,string>" if built_in(name).format == "csv" else "variant"
    rows = spark.range(9).selectExpr("'f' AS _source", "id AS _row", "map('user', 'x') AS _v" if kind != "variant" else "parse_json('{}') AS _v").mapInArrow(lambda x: x, f"_source string, _row long, _v {kind}")
    ingest.parse(rows, built_in(name))
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plans[0])
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_constants_and_mapped_identifiers_are_trimmed(spark):
    raw = {**BUILT_IN["generic-auth-csv"], "map": {**BUILT_IN["generic-auth-csv"]["map"], "session": {"const": "  s 1 "}, "gateway_id": {"field": "gateway", "map": {"a": " g 1 ", "b": "g2"}}}}
    profile = Profile.load(raw)
    rows = spark.createDataFrame([("f", i, {"timestamp": "2026-01-01T09:00:00", "event_id": f"e{i}", "user": "u", "gateway": g, "result": "success"}) for i, g in enumerate([" A ", "b", "c"])], "_source string, _row long, _v map<string,string>")
    parsed = ingest.parse(rows, profile)
    assert {(r.id, r.session, r.gateway_id[:4]) for r in parsed.rows.collect()} == {("e0", "s 1", "g-1:"), ("e1", "s 1", "g2")}
    assert [(r.reason, r.n) for r in parsed.skipped.collect()] == [("missing_gateway_id", 1)]


def test_slugs_of_odd_names(spark):
    names = ["", " ", "-", "--a", "_a", ".", "é", "é_", "é-_b", "x", "a b", "a:b", "a" * 81, "-" * 70 + "b", "保守 a"]
    heads = [None, None, "asset:", "a:", "x_a:", "x.:", "asset:", "x_:", "x_b:", "x", "a-b:", "a-b:", "a" * 60 + ":", "b:", "a:"]
    got = [r.s for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, x string").orderBy("i").select(s.slug(F.col("x")).alias("s")).collect()]
    want = [h and (h + hashlib.sha256(n.strip().encode()).hexdigest()[:16] if h.endswith(":") else h) for h, n in zip(heads, names)]
    assert got == want


def test_jsonl_import(spark, tmp_path):
    p = tmp_path / "files.jsonl"
    p.write_text('{"ts": 1767225600123, "user": {"id": "a"}, "session": "s", "host": "h", "path": "/x", "label": "機密", "bytes": "1e400"}\n\n[1]\n{"ts": 1, bad}\n{"ts": 1767225600123, "session": "s", "host": "h", "path": "/x"}\n')
    profile = built_in("generic-file-access-jsonl")
    rows, skipped = ingest.scan(spark, str(p), profile)
    parsed = ingest.parse(rows, profile)
    r = parsed.rows.collect()
    assert len(r) == 1 and r[0].at == 1767225600 and r[0].sensitive is True and r[0].bytes_read is None and r[0].id.startswith("fa-")
    assert {(x.reason, x.n) for x in skipped.collect()} == {("not_an_object", 1), ("not_json", 1)}
    assert {(x.reason, x.n) for x in parsed.skipped.collect()} == {("missing_actor", 1)}


def test_shift_jis_with_skipped_lines(spark, tmp_path):
    raw = {**BUILT_IN["generic-auth-csv"], "encoding": "cp932", "skip_rows": 1}
    p = tmp_path / "a.csv"
    p.write_bytes("報告\ntimestamp,event_id,user,session_id,gateway,result\n2026-01-01T09:00:00,e1,太郎,s,g,成功\n".encode("cp932"))
    profile = Profile.load(raw)
    parsed = ingest.parse(ingest.scan(spark, str(p), profile)[0], profile)
    assert [(r.actor, r.success) for r in parsed.rows.collect()] == [("太郎", True)]


def test_scalars(spark):
    key = b"k" * 80
    assert one(spark, s.pseudonym(F.lit("ünï"), key, "actor")) == "actor-" + hmac.new(key, b"actor\0" + "ünï".encode(), hashlib.sha256).hexdigest()[:24]
    assert one(spark, s.epoch(F.lit("2026-01-01T00:00:00"))) is None
    assert one(spark, s.epoch(F.lit("2026-01-01T00:00:00.9+09:00"))) == 1767193200
    assert one(spark, s.epoch(F.lit("01/02/2026 03:04"), "%d/%m/%Y %H:%M", "+09:00")) == 1769882640
    assert one(spark, s.finite(F.lit("inf"))) is None and one(spark, s.finite(F.lit("x"))) is None
    assert one(spark, s.bounded_long(F.lit("12.9"), 0, 20)) == 12 and one(spark, s.bounded_long(F.lit("21"), 0, 20)) is None
    assert one(spark, s.tri_state(F.lit(" YES "))) is True and one(spark, s.tri_state(F.lit("maybe"))) is None and one(spark, s.tri_state(F.lit(None).cast("string"))) is None
    assert one(spark, s.version(F.lit("1.10"))) == [1, 10, 0, 0, 0, 0] and one(spark, s.version(F.lit("1.x"))) is None
    assert one(spark, s.slug(F.lit("A-1"))) == "A-1" and ":" in one(spark, s.slug(F.lit("A:1")))
    assert one(spark, s.strict_url(F.lit("https://a.example/x/../y"))) is False and one(spark, s.strict_url(F.lit("https://a.example:443/x"))) is True
    assert one(spark, s.leaf_strings(F.lit('{"a": ["x", {"b": "y"}], "c": 1}'))) == "x\ny" and one(spark, s.leaf_strings(F.lit(None).cast("string"))) is None


def test_duplicates_and_conflicts(spark):
    rows = spark.createDataFrame([("e", 1, "x", "a", 0), ("e", 1, "x", "b", 0), ("e", 2, "x", "b", 1), ("f", 1, None, "b", 2)], "id string, at long, actor string, _source string, _row long")
    kept, dropped = clean.without_repeats(rows)
    assert kept.count() == 3 and [(r.source, r.n) for r in dropped.collect()] == [("b", 1)]
    out = {r.id: r.renamed for r in clean.renamed_conflicts(kept).collect()}
    assert out["e"] is False and out["f"] is False and sum(out.values()) == 1 and len(out) == 3
    assert clean.conflicting_ids(rows.drop("_source", "_row")).count() == 1
    with pytest.raises(Exception, match="several contents"):
        clean.deduplicated(rows.select("id", "at", "actor")).collect()


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", None)], "id string, at long")
    b = spark.createDataFrame([("y", None), ("x", 1)], "id string, at long")
    assert clean.fingerprint(a).first() == clean.fingerprint(b.repartition(3)).first()
    assert clean.fingerprint(a).first() != clean.fingerprint(a.limit(1)).first()


def test_identity_provider_log(spark):
    good = '{"uuid":"u-1","eventType":"user.session.start","published":"2026-01-01T00:00:00Z","actor":{"alternateId":"a"},"authenticationContext":{"externalSessionId":"s"},"outcome":{"result":"SUCCESS"},"client":{"ipAddress":"10.0.0.1"}}'
    lines = spark.createDataFrame([("f", 0, good), ("f", 1, good.replace("SUCCESS", "SKIPPED")), ("f", 2, "nonsense"), ("f", 3, good.replace('"u-1"', '"bad id"'))], "_source string, _row long, line string")
    logins, others = idp.session_logins(lines)
    got = logins.collect()
    assert [r.id for r in got][0] == "u-1" and got[1].id.startswith("okta-") and others.first().n == 2
    assert got[0].privileged is None and got[0].gateway_id == "okta-idp"
    assert idp.merged(logins, logins, 1767225600).count() == 2
    assert idp.merged(logins, logins, 0).count() == 0
