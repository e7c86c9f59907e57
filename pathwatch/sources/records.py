"""Delimited records of text files that many tasks cut, whatever their encoding, line breaks in quotes and headers.

Spark's text reader deals files out in blocks, by line feeds, as bytes. Whether a line starts within a quoted field depends
on all lines before it, so a first pass tells of each block where it ends if it starts outside of quotes, and where if it
starts within. These answers are functions of two states; a running composition over a file's blocks, one row a block,
gives each block its start. Then every block cuts its records by itself, and only the pieces of records that cross blocks
are put together, by one row a block and side.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import written

#: Columns of a table, and bytes of facts on blocks that are sent to all tasks; more are joined by a shuffle.
COLUMNS, SENT_BYTES = 200, 32 << 20
_BREAK = re.compile(r"(?<=\r)(?!\n)(?=.)", re.DOTALL)


def ends_quoted(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted field is open after `line`, which starts within one or not; a quote opens a field only as its first character."""
    at, start = 0, not inside
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line.startswith('"', at + 1):
                at = line.find('"', at + 2)
            if at < 0:
                return True
            at, inside, start = at + 1, False, False
        if start and line.startswith('"', at):
            at, inside = at + 1, True
            continue
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at, start = at + 1, True


def fields(record: str, delimiter: str) -> list[str]:
    """The fields of one record, none of a blank one. Only quotes and inner line breaks need the csv module."""
    if '"' not in record:
        line = record.rstrip("\r\n")
        if "\r" not in line and "\n" not in line:
            return line.split(delimiter) if line else []
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=delimiter), [])


def _named(record: str, delimiter: str, header: list[str]) -> dict[str, str | None] | None:
    """Values by name: empty ones and those that are missing are null, surplus ones are left out, of equal names the last counts."""
    values = fields(record, delimiter)
    if not values:
        return None
    found: dict[str, str | None] = dict.fromkeys(header) if len(values) < len(header) else {}
    found.update(zip(header, [v or None for v in values]))
    return found


def physical(spark: SparkSession, path: str) -> DataFrame:
    """(file, _source, block, place, line): the lines of text files as bytes, in order of block and place."""
    m = "_metadata."
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col(m + "file_path").alias("file"), F.col(m + "file_name").alias("_source"), F.col(m + "file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"),
    )


def _runs(batches: Iterator[pa.RecordBatch], encoding: str, skip: int) -> Iterator[tuple[dict | None, int, str | None]]:
    """(facts of the block where one begins, number in its block, text with its line end) of lines that follow one another;
    a null line has no text.

    The first `skip` lines and a byte-order mark of a file are left out; a carriage return alone ends a line, too.
    """
    now, number, gone = None, 0, 0
    for batch in batches:
        facts = batch.drop_columns(["line"])
        files, blocks = batch["file"], batch["block"]
        alone = len(pc.unique(files)) == len(pc.unique(blocks)) == 1
        keys = repeat((files[0].as_py(), blocks[0].as_py())) if alone else zip(files.to_pylist(), blocks.to_pylist())
        for i, (key, line) in enumerate(zip(keys, batch["line"].to_pylist())):
            if key != now:
                now, number, gone = key, 0, skip if key[1] else 0
                yield {n: facts[n][i].as_py() for n in facts.schema.names}, 0, None
            if line is None:
                continue
            text = line.decode(encoding, "replace") + "\n"
            for part in _BREAK.split(text) if "\r" in text[:-2] else [text]:
                if gone < skip:
                    gone += 1
                    continue
                if not key[1] and not number:
                    part = part.removeprefix("\ufeff")
                number += 1
                yield None, number, part


def _facts(encoding: str, delimiter: str, skip: int):
    """A row for each block: whether a quoted field is open after it, if none was before it and if one was; a file's first record."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        head: str | None = None
        for block, _, text in _runs(batches, encoding, skip):
            if block is not None:
                out.append(block | {"out": False, "in": True, "header": None})
                head = None if block["block"] else ""
                continue
            last = out[-1]
            if '"' in text:
                last["out"], last["in"] = ends_quoted(text, delimiter, last["out"]), ends_quoted(text, delimiter, last["in"])
            if head is not None:
                head += text
                if not last["out"]:
                    last["header"] = fields(head, delimiter) or None
                    head = "" if last["header"] is None else None
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("out", pa.bool_()), ("in", pa.bool_()), ("header", pa.list_(pa.string()))]))

    return facts


def block_states(facts: DataFrame) -> DataFrame:
    """(file, block, inside, open, header) from (file, block, out, in, header): where each block starts and ends.

    A block either ends the same way from both starts, or keeps the start, or turns it round. So what counts is the last
    block before of the first kind, and how many since turn it round.
    """
    upto = Window.partitionBy("file").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("out") & ~F.col("in")).cast("int")
    rows = facts.withColumn("fixed", F.when(F.col("out") == F.col("in"), F.col("out"))).withColumn("turns", F.sum(turns).over(upto))
    since = F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(F.last(F.when(F.col("fixed").isNotNull(), F.col("turns")), ignorenulls=True).over(before), F.lit(0))
    inside = F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(False)) != (since % 2 == 1)
    rows = rows.withColumn("inside", inside).withColumn("header", F.first("header", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("file", "block", "inside", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")).alias("open"), "header")


_CUT = "file string, _source string, _row long, starts boolean, text string, header array<string>, _v map<string,string>"
_CUT_ARROW = pa.schema([("file", pa.string()), ("_source", pa.string()), ("_row", pa.int64()), ("starts", pa.bool_()), ("text", pa.string()), ("header", pa.list_(pa.string())), ("_v", pa.map_(pa.string(), pa.string()))])


def _maps(found: Iterable[dict[str, str | None] | None]) -> pa.Array:
    """A map array from one list of all names and one of all values."""
    starts: list[int | None] = []
    names: list[str] = []
    values: list[str | None] = []
    for x in found:
        starts.append(None if x is None else len(names))
        names.extend(x or ())
        values.extend(x.values() if x else ())
    return pa.MapArray.from_arrays(pa.array([*starts, len(names)], pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [_maps(c) if pa.types.is_map(f.type) else pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT_ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_CUT_ARROW)


def _cut(encoding: str, delimiter: str, skip: int):
    """Records of each block with their values `_v`; pieces of a record that crosses blocks come as text instead."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        row, text, at, open_, starts, headed = {}, "", 0, False, True, True

        def piece() -> None:
            if text:
                out.append((row["file"], row["_source"], row["block"] + at, starts, text, row["header"], None))

        for block, number, line in _runs(batches, encoding, skip):
            if block is not None:
                piece()
                row, text, at, headed = block, "", 0, block["block"] > 0
                open_, starts = block["inside"], not block["inside"]
                continue
            if not text and starts:
                at = number
            text += line
            if '"' in line:
                open_ = ends_quoted(line, delimiter, open_)
            if open_:
                continue
            if not starts:
                piece()
            elif row["header"] and (values := _named(text, delimiter, row["header"])) is not None:
                if headed:
                    out.append((row["file"], row["_source"], row["block"] + at, True, None, None, values))
                headed = True
            text, starts = "", True
            if len(out) >= 5000:
                yield _rows(out)
                out.clear()
        piece()
        if out:
            yield _rows(out)

    return cut


def _parse(delimiter: str):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["file"], r["_source"], r["_row"], True, None, None, _named(r["text"], delimiter, r["header"])) for r in batch.to_pylist() if r["header"]]
            rows = [r for r in rows if r[-1] is not None]
            if rows:
                yield _rows(rows)

    return parse


def delimited(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ",", skip_rows: int = 0) -> DataFrame:
    """(_source, _row, _v): the records of delimited text files at `path`, with values by name (a map; empty ones are null).

    The first record of each file, after `skip_rows` lines, is its header; files may have different columns in any order.
    A field in double quotes may hold delimiters, line breaks and doubled quotes. _row ascends within a file. Blank records
    don't count; an empty file has no rows; a header of more than 200 columns is an error. Encodings are those in which a
    line feed is that byte and no part of a character. A file whose lines end in carriage returns alone is one block, and one
    whose header or skipped lines don't end in its first block has no rows.
    """
    lines = physical(spark, path)
    needed = F.when((F.col("block") == 0) | F.col("line").cast("string").contains('"'), F.col("line"))
    kinds = "file string, block long, out boolean, `in` boolean, header array<string>"
    facts = lines.select("file", "block", needed.alias("line")).mapInArrow(_facts(encoding, delimiter, skip_rows), kinds)
    states = written(block_states(written(facts)))
    size, wide, crossing = states.agg(F.sum(F.length("file") + F.coalesce(F.length(F.array_join("header", ",", "")), F.lit(0))), F.max(F.size("header")), F.count_if(F.col("inside") | F.col("open"))).first()
    if (wide or 0) > COLUMNS:
        raise ValueError(f"a table of {wide} columns; {COLUMNS} are the most")
    starts = states.select("file", "block", "inside", "header")
    if (size or 0) <= SENT_BYTES:
        joined = lines.join(starts.hint("broadcast"), ["file", "block"])
    else:
        joined = lines.join(starts.hint("merge"), ["file", "block"]).sortWithinPartitions("file", "block", "place")
    records = joined.select("file", "_source", "block", "inside", "header", "line").mapInArrow(_cut(encoding, delimiter, skip_rows), _CUT)
    whole = records.where("text is null")
    if crossing:
        pieces = records.where("text is not null").drop("_v")
        group = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file").orderBy("_row"))
        pieces = pieces.withColumn("_g", group).groupBy("file", "_g").agg(F.first("_source").alias("_source"), F.min("_row").alias("_row"), F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("_row", "text"))).alias("p"))
        joined_up = pieces.select("file", "_source", "_row", F.array_join("p.text", "").alias("text"), "header").mapInArrow(_parse(delimiter), _CUT)
        whole = whole.unionByName(joined_up)
    return whole.select("_source", "_row", "_v")


def decoded(spark: SparkSession, path: str, encoding: str, skip_rows: int) -> DataFrame:
    """(_source, _row, line) of text files in `encoding` without their first `skip_rows` lines, in many tasks."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(_runs(batches, encoding, skip_rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), (pa.string(), pa.int64(), pa.string()))], ["_source", "_row", "line"])

    def _grouped(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        out = []
        row: dict = {}
        for block, number, text in rows:
            if block is not None:
                row = block
                continue
            out.append((row["_source"], row["block"] + number, text.rstrip("\r\n")))
            if len(out) >= 5000:
                yield out
                out = []
        if out:
            yield out

    return physical(spark, path).select("file", "_source", "block", "line").mapInArrow(decode, "_source string, _row long, line string")


#: Files up to this size are hashed as one value, larger ones line by line.
WHOLE_BYTES = 64 << 20


_MARK = b"\xef\xbb\xbf"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file from its lines in order. What lines leave out, a last line feed and a byte-order mark, the file's
    size tells; a size that no such file has gives null."""
    out: list[tuple] = []
    now, size, states, n = None, 0, (), 0

    def end() -> None:
        if now is not None:
            if n in (size, size - len(_MARK)):
                for state in states:
                    state.update(b"\n")
            kind = {0: 0, 1: 0, -3: 1, -2: 1}.get(n - size)
            out.append((now, None if kind is None else states[kind].hexdigest()))

    for batch in batches:
        for file, length, line in zip(batch["file"].to_pylist(), batch["size"].to_pylist(), batch["line"].to_pylist()):
            if file != now:
                end()
                now, size, states, n = file, length, (hashlib.sha256(), hashlib.sha256(_MARK)), 0
            for state in states:
                state.update((b"\n" if n else b"") + line)
            n += len(line) + 1
    end()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["file", "sha256"])


def file_digests(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(file, sha256) of the files at `path`.

    A file of at most `whole_bytes` is read as one value. A larger one comes as lines, sorted by their place and passed
    through one SHA-256, so that no value holds it and it may be beyond the 2 GB of one; only a line must fit in memory. A large file that Spark
    decompresses by its name has no digest (null); empty files, which Spark doesn't read, are left out.
    """
    small = spark.read.format("binaryFile").load(path).where(F.col("length") <= whole_bytes)
    small = small.select(F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"),
    ).where(F.col("size") > whole_bytes)
    large = lines.repartition("file").sortWithinPartitions("file", "block", "place").select("file", "size", "line")
    return small.unionAll(large.mapInArrow(_hashes, "file string, sha256 string"))
