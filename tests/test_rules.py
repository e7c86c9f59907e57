import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from pathwatch.config import RuleConfig
from pathwatch.operators import rules
from pathwatch.schemas import ASSETS, FILE_ACCESS, LOGINS

START = 1_700_000_000


def reads(spark, rows):
    return spark.createDataFrame([(i, at, a, s, x, f, sens, None) for i, at, a, s, x, f, sens in rows], FILE_ACCESS)


def logins(spark, rows):
    return spark.createDataFrame(rows, LOGINS)


def assets(spark, rows):
    return spark.createDataFrame(rows, ASSETS)


GATEWAY = ("gw", "vpn", "pending", START, True, None, None, ("CVE-1", 6.5, None))


def burst(n, step=2, sensitive=42, session="s1", actor="mallory", same=False):
    return [(f"r{i:04}", START + 60 + i * step, actor, session, "files", "f0" if same else f"f{i}", i < sensitive) for i in range(n)]


def naive(rows, window):
    held, files, best, peak = deque(), Counter(), [], 0
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        while held and r[1] - held[0][1] > window:
            old = held.popleft()
            files[old[5]] -= 1
            if not files[old[5]]:
                del files[old[5]]
        held.append(r)
        files[r[5]] += 1
        if len(files) > peak:
            peak, best = len(files), list(held)
    return peak, [r[0] for r in best]


def test_digests():
    assert RuleConfig().digest == "814b2f0ec0026668"
    assert RuleConfig(identity_conditions="both").digest == "d21e6d2c039126d2"


@pytest.mark.parametrize("raw", [{"window_seconds": 9}, {"window_seconds": True}, {"nope": 1}, {"identity_conditions": "x"}, {"sensitive_file_minimum": 101}])
def test_bad_settings_are_refused(raw):
    with pytest.raises(ValueError):
        RuleConfig.load(raw)


def test_canonical_case(spark):
    login = [("l1", START, "mallory", "s1", "gw", True, True, False, False)]
    found = {r.rule: r for r in rules.analyze(assets(spark, [GATEWAY]), logins(spark, login), reads(spark, burst(130)), START).collect()}
    assert set(found) == {"AS-001", "AS-005", "AS-002", "AS-003", "AS-004"}
    assert found["AS-003"].distinct_files == 130 and found["AS-003"].sensitive_files == 42
    assert found["AS-004"].priority == "P1" and found["AS-004"].evidence_ids[:2] == ["asset:gw", "l1"]


@pytest.mark.parametrize(
    ("login", "rows"),
    [
        (("l1", START, "mallory", "s1", "gw", False, True, False, False), burst(130)),  # failed login
        (("l1", START - 10_800, "mallory", "s1", "gw", True, True, False, False), burst(130)),  # too early
        (("l1", START, "mallory", "s2", "gw", True, True, False, False), burst(130)),  # another session
        (("l1", START, "other", "s1", "gw", True, True, False, False), burst(130)),  # another actor
        (("l1", START, "mallory", "s1", "gw", True, True, None, None), burst(130)),  # unknown isn't false
        (("l1", START, "mallory", "s1", "gw", True, True, False, False), burst(99)),  # too few files
        (("l1", START, "mallory", "s1", "gw", True, True, False, False), burst(130, same=True)),
        (("l1", START, "mallory", "s1", "gw", True, True, False, False), burst(130, step=10)),
    ],
)
def test_no_correlation(spark, login, rows):
    out = rules.analyze(assets(spark, [GATEWAY]), logins(spark, [login]), reads(spark, rows), START)
    assert out.where("rule = 'AS-004'").count() == 0


def test_peaks_equal_a_sliding_window(spark):
    random.seed(3)
    rows = [(f"e{i:04}", START + random.randrange(400), f"a{random.randrange(8)}", "s", "x", f"f{random.randrange(7)}", None) for i in range(400)]
    config = RuleConfig(window_seconds=30, distinct_file_threshold=2)
    got = {r.actor: (r.distinct_files, r.evidence_ids) for r in rules.bulk_windows(reads(spark, rows), config).collect()}
    want = {a: naive([r for r in rows if r[2] == a], 30) for a in {r[2] for r in rows}}
    assert got == {a: v for a, v in want.items() if v[0] >= 2}


def test_empty_frames(spark):
    out = rules.analyze(assets(spark, []), logins(spark, []), reads(spark, []), START)
    assert out.count() == 0
    row = rules.coverage(assets(spark, []), logins(spark, []), reads(spark, [])).first()
    assert row.missing_sources == ["assets", "logins", "file_access"] and row.unknown_asset_fields == 0


def test_latest_login_ties_take_the_least_id(spark):
    windows = spark.createDataFrame([("a", "s", "x", 100)], "actor string, session string, asset_id string, window_start long")
    l = logins(spark, [("b", 90, "a", "s", "g", True, None, None, None), ("a", 90, "a", "s", "g", True, None, None, None), ("c", 101, "a", "s", "g", True, None, None, None)])
    assert rules.latest_login(windows, l, 60).select("login_id").first()[0] == "a"
    assert rules.latest_login(windows, l.where(F.lit(False)), 60).count() == 0


@pytest.mark.parametrize("windows", [[60], [0, 7, 200]])
def test_window_counts_of_a_hot_group_in_slices(spark, windows):
    """One group with most rows over many slices, ties in time and rows at slice borders, against sets."""
    r = random.Random(9)
    rows = [(f"r{i:04}", r.choice([r.randrange(9000), 16 * max(windows) * r.randrange(5)]), "a" if r.random() < 0.9 else "b", "s", "x", f"f{r.randrange(30)}") for i in range(900)]
    df = spark.createDataFrame([*rows, ("n", 5, None, "s", "x", "f1")], "id string, at long, actor string, session string, asset_id string, file_id string")
    got = rules.window_counts(df, windows).where("slice = own").collect()
    assert len(got) == len(rows)
    at = {}
    for w in windows:
        for i, t, actor, *_ in rows:
            at[i, w] = len({f for j, u, a, _, _, f in rows if a == actor and t - w <= u and (u, j) <= (t, i)})
    assert {(x.id, w): x[f"n_{w}"] for x in got for w in windows} == at
    best = {a: min(((-at[i, windows[-1]], t, i) for i, t, b, *_ in rows if b == a)) for a in ("a", "b")}
    peaks = rules.window_peaks(df, windows[-1], 2).collect()
    assert {(p.actor, -p.peak, p.peak_at, p.peak_id) for p in peaks} == {(a, *b) for a, b in best.items() if -b[0] >= 2}
    tasks = rules.window_counts(df, windows).where("actor = 'a'").select("slice").distinct().count()
    assert tasks > 2
