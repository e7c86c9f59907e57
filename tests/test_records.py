import csv
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pathwatch.sources import ingest, records
from pathwatch.sources.profiles import BUILT_IN, Profile


def by_hand(path, encoding, delimiter, skip):
    """What the csv module reads, file by file."""
    out = []
    for p in sorted(path.iterdir()):
        with p.open(encoding=encoding, errors="replace", newline="") as f:
            for _ in range(skip):
                f.readline()
            text = f.read().removeprefix("﻿")
        out += [(p.name, tuple(sorted((k, v or None) for k, v in row.items() if isinstance(k, str)))) for row in csv.DictReader(text.splitlines(keepends=True), delimiter=delimiter)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r._source, tuple(sorted(r._v.items()))) for r in df.collect()), key=repr)


def make(path, seed, encoding, delimiter, skip, rows=40, end="\n"):
    r = random.Random(seed)
    cells = ["", "x", "two words", "失敗", "表示", f"a{delimiter}b", 'say "hi"', "line\nbreak", "\n\n", f'"{delimiter}\n"', "é" if encoding != "cp932" else "ソ"]
    with path.open("w", encoding=encoding, errors="replace", newline="") as f:
        f.write("".join(f'report {i} with a lone " in it{end}' for i in range(skip)))
        w = csv.writer(f, delimiter=delimiter, lineterminator=end, quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        names = ["who", "at", "a longer name\nof two lines"][: r.randint(2, 3)]
        r.shuffle(names)
        w.writerow(names)
        for _ in range(rows):
            w.writerow(r.choices(cells, k=r.choice([len(names)] * 8 + [1, len(names) + 1])))
            if r.random() < 0.1:
                f.write(end + r.choice(['a 5" disk' + end, 'x"y' + end, '"closed" and more' + end, ""]))


@pytest.fixture
def small_blocks(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
    spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


@pytest.mark.parametrize(("encoding", "delimiter", "skip", "end", "block"), [("utf-8", ",", 0, "\n", 97), ("utf-8-sig", ";", 2, "\r\n", 211), ("cp932", ",", 1, "\r\n", 150), ("shift_jis", "|", 0, "\n", 60), ("euc_jp", "\t", 3, "\n", 400), ("latin-1", ",", 0, "\r\n", 10_000_000)])
def test_records_equal_the_csv_modules(spark, tmp_path, small_blocks, encoding, delimiter, skip, end, block):
    for i in range(5):
        make(tmp_path / f"f{i}.csv", i, encoding, delimiter, skip, 30 * i, end)
    (tmp_path / "empty.csv").write_text("")
    small_blocks(max(block, 400) if skip else max(block, 90))
    df = records.delimited(spark, str(tmp_path), encoding, delimiter, skip)
    assert found(df) == by_hand(tmp_path, encoding, delimiter, skip)
    rows = df.select("_source", "_row").collect()
    assert len(set(rows)) == len(rows)
    if block < 1000:
        assert records.physical(spark, str(tmp_path)).select("file", "block").distinct().count() > 10


def test_facts_too_large_to_send_are_joined(spark, tmp_path, small_blocks, monkeypatch):
    for i in range(4):
        make(tmp_path / f"f{i}.csv", i, "utf-8", ",", 0, 60)
    monkeypatch.setattr(records, "SENT_BYTES", 0)
    small_blocks(120)
    assert found(records.delimited(spark, str(tmp_path))) == by_hand(tmp_path, "utf-8", ",", 0)


def test_fields_of_records_without_quotes_equal_the_csv_modules():
    r = random.Random(2)
    for _ in range(20000):
        delimiter = r.choice(",;|\t")
        record = "".join(r.choices(["x", " ", delimiter, '"', "\0", "\x0b", "é", "\u2028"], [4, 2, 4, 1, 1, 1, 1, 1], k=r.randint(0, 9))) + r.choice(["", "\n", "\r\n", "\r"])
        assert records.fields(record, delimiter) == next(csv.reader([record], delimiter=delimiter), [])
    assert records._named("1,,3,4\n", ",", ["a", "b", "a"]) == {"a": "3", "b": None} and records._named("1\n", ",", ["a", "b"]) == {"a": "1", "b": None} and records._named("\r\n", ",", ["a"]) is None
    assert records._maps([{"a": "1", "b": None}, None, {"b": "2"}]).to_pylist() == [[("a", "1"), ("b", None)], None, [("b", "2")]]


def test_states_compose(spark):
    """Kept, fixed and turned starts in a row, against one pass over them."""
    r = random.Random(1)
    rows = [(f"f{f}", i * 10, r.random() < 0.5, r.random() < 0.5, ["h"] if i == 0 else None) for f in range(8) for i in range(12)]
    got = records.block_states(spark.createDataFrame(rows, "file string, block long, out boolean, `in` boolean, header array<string>"))
    state, want = {}, {}
    for f, b, out, in_, _ in rows:
        before = state.get(f, False)
        state[f] = in_ if before else out
        want[f, b] = (before, state[f], ["h"])
    assert {(r.file, r.block): (r.inside, r.open, r.header) for r in got.collect()} == want


def test_a_folder_of_other_headers_and_a_wide_one(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("at,who\n1,太郎\n".encode("cp932"))
    (tmp_path / "b.csv").write_bytes('who,at\n"multi\nline",3\n'.encode("cp932"))
    assert found(records.delimited(spark, str(tmp_path), "cp932")) == [("a.csv", (("at", "1"), ("who", "太郎"))), ("b.csv", (("at", "3"), ("who", "multi\nline")))]
    (tmp_path / "c.csv").write_text(",".join(f"c{i}" for i in range(201)) + "\n1\n")
    with pytest.raises(ValueError, match="201 columns"):
        records.delimited(spark, str(tmp_path), "cp932")


def test_import_of_files_of_other_headers(spark, tmp_path):
    profile = Profile.load({**BUILT_IN["generic-auth-csv"], "encoding": "cp932", "skip_rows": 1})
    (tmp_path / "a.csv").write_bytes("報告\ntimestamp,event_id,user,session_id,gateway,result\n2026-01-01T09:00:00,e1,太郎,s,g,成功\n".encode("cp932"))
    (tmp_path / "b.csv").write_bytes('報告\nresult,user,event_id,more,session_id,gateway,timestamp\n失敗,花子,e2,"x\ny",s,g,2026-01-01T09:00:00\n'.encode("cp932"))
    parsed = ingest.parse(ingest.scan(spark, str(tmp_path), profile)[0], profile)
    assert {(r.id, r.success, r._source) for r in parsed.rows.collect()} == {("e1", True, "a.csv"), ("e2", False, "b.csv")}


def test_lines_in_other_encodings_are_decoded_in_blocks(spark, tmp_path, small_blocks):
    lines = ["skipped"] + [f'{{"k": "表示{i}"}}' for i in range(50)]
    (tmp_path / "a.jsonl").write_bytes("\n".join(lines).encode("cp932"))
    small_blocks(100)
    got = records.decoded(spark, str(tmp_path), "cp932", 1).orderBy("_row").select("line").collect()
    assert [r.line for r in got] == lines[1:]
    assert records.physical(spark, str(tmp_path)).agg(F.count_distinct("block")).first()[0] > 5


def test_digests_of_whole_and_of_line_by_line_files(spark, tmp_path, small_blocks):
    texts = {"a": b"", "b": b"\n", "c": b"x", "d": b"x\ny", "e": b"x\r\ny\r\n", "f": b"\xef\xbb\xbfmark\n", "g": b"\xef\xbb\xbfmark", "h": bytes(range(256)) * 40, "i": b"line\n" * 500, "j": b"\n\n\nq\n"}
    for name, body in texts.items():
        (tmp_path / name).write_bytes(body)
    small_blocks(300)
    want = {n: hashlib.sha256(b).hexdigest() for n, b in texts.items() if b}
    for most in (0, 100, 1 << 20):
        got = records.file_digests(spark, str(tmp_path), most).collect()
        assert {r.file.rsplit("/", 1)[1]: r.sha256 for r in got} == want and len(got) == len(want)
