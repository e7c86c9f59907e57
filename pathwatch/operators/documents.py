"""Documents as bytes: text and structure of Office packages, byte checks of PDF, and findings over parts.

Python takes a package apart and says what each part holds, each text once; all rules, counts, locations and verdicts are
Spark's, over one shuffle by document.
"""

from __future__ import annotations

import hashlib
import io
import json
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, XMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s

PARTS = "doc long, path string, format string, part int, at long, kind string, location string, entry string, name string, depth long, text string, plain string"
#: Parts that a package must have besides its main part, the main part of each format and its content type.
CONTENT_TYPES, RELATIONSHIPS = "[Content_Types].xml", "_rels/.rels"
TYPES_ROOT = "{http://schemas.openxmlformats.org/package/2006/content-types}Types"
MAIN = {
    "xlsx": ("xl/workbook.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"),
    "pptx": ("ppt/presentation.xml", "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"),
}
TEXT_RULES = [("DOC-SECRET", "block", s.SECRET), ("DOC-PII", "review", s.PERSONAL), ("DOC-CLASS", "review", s.CONFIDENTIAL), ("DOC-INJECTION", "review", s.INJECTION)]
#: Elements whose texts belong together, those whose attributes say something, parts that are read as units.
SCOPES = {"si", "is", "p", "c", "comment"}
TOLD = {"Types", "Override", "Relationship", "sheet", "row", "col", "sld"}
UNIT = r"^(xl/worksheets/sheet|ppt/slides/slide)\d+\.xml$"
MACRO = r"(?i:macroEnabled|vbaProject|activeX)"
#: What documents of a format begin with; kinds of rows whose text a document says.
MAGIC = {"xlsx": b"PK\x03\x04", "pptx": b"PK\x03\x04", "pdf": b"%PDF-"}
SPOKEN = ("text", "attribute", "joined")
#: A package beyond these is not unpacked: expansion of a part, bytes of a part, bytes of all parts.
RATIO, PART_BYTES, EXPANDED = 1000, 64 << 20, 256 << 20
#: Rows and characters that a task holds before it hands them on.
CHUNK, CHUNK_CHARS = 20_000, 1 << 21

#: Findings after which nothing else is said of a document, which counts as unreadable.
UNREADABLE = {"DOC-SIZE": "block", "DOC-FORMAT-MISMATCH": "block", "DOC-UNSUPPORTED": "review", "DOC-PARSE-FAILED": "review"}
#: Findings that leave something unread.
PARTIAL = ["DOC-ACTIVE-CONTENT", "DOC-IMAGE-UNINSPECTED", "DOC-BINARY-UNINSPECTED", "DOC-NO-CONTENT", "DOC-PDF-REVISION-HISTORY", "DOC-PDF-TRAILING-CONTENT", "DOC-PDF-TEXT-UNINSPECTED"]


class _Part:
    """Target of an XML parser that tells what a part says, as it is read.

    rows: (place, kind, name, depth, text), where place is four times the element's number plus 0 for the joined text of
    a scope, 1 for an element's text, 2 for what follows it and 3 for its attributes.
    """

    def __init__(self) -> None:
        self.rows, self.run, self.whole, self.open, self.scopes = [], [], [], [], []
        self.number, self.slot = 0, 2

    def doctype(self, *_: object) -> None:
        raise ParseError("a document type could define entities")

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self._flush()
        here, name = 4 * self.number, tag.rsplit("}", 1)[-1]
        self.number += 1
        told = name in TOLD and (name not in ("row", "col") or "hidden" in attributes)
        if told:
            self.rows.append((here, "element", tag if name == "Types" else name, len(self.open), json.dumps(attributes)))
        self.rows += [(here + 3, "attribute", name, len(self.open), v) for v in attributes.values() if v]
        self.open.append(here)
        if name in SCOPES:
            self.scopes.append((here, []))
        self.slot = here + 1

    def data(self, text: str) -> None:
        self.run.append(text)

    def end(self, _: str) -> None:
        self._flush()
        here = self.open.pop()
        if self.scopes and self.scopes[-1][0] == here:
            self.rows.append((here, "joined", "", 0, "".join(self.scopes.pop()[1])))
        self.slot = here + 2

    def _flush(self) -> None:
        text, self.run = "".join(self.run), []
        if text:
            self.rows.append((self.slot, "text", "", len(self.open), text))
            self.whole.append(text)
            for _, pieces in self.scopes:
                pieces.append(text)

    def close(self) -> list[tuple]:
        """The rows in order. A joined text that says nothing, or no more than its part's, which comes first, is left out."""
        self._flush()
        whole = "".join(self.whole)
        rows = [r for r in self.rows if r[1] != "joined" or r[4] not in ("", whole)]
        return [(-1, "joined", "", 0, whole)] * bool(whole) + sorted(rows, key=lambda r: r[0])


def _read(package: zipfile.ZipFile, entry: zipfile.ZipInfo) -> list[tuple]:
    part = _Part()
    parser = XMLParser(target=part)
    with package.open(entry) as f:
        while block := f.read(1 << 20):
            parser.feed(block)
    return parser.close()


def _unsafe(package: zipfile.ZipFile) -> bool:
    """Whether names or sizes speak against unpacking: paths that leave the package, names that differ in case only, links,
    encryption, other compressions, expansion beyond bounds."""
    total, seen = 0, set()
    for i in package.infolist():
        name = unicodedata.normalize("NFKC", i.filename).casefold()
        path = i.filename.startswith("/") or ".." in i.filename.split("/") or any(c in "\\:" or ord(c) < 32 for c in i.filename)
        link = (i.external_attr >> 16) & 0o170000 == 0o120000
        total += i.file_size
        large = i.file_size > PART_BYTES or total > EXPANDED or i.file_size > RATIO * max(1, i.compress_size)
        if path or name in seen or link or i.flag_bits & 1 or large or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            return True
        seen.add(name)
    return not seen


def _office(content: bytes, kind: str) -> Iterator[tuple]:
    """(part, at, kind, location, entry, name, depth, text) of one package: its entries, and what its XML parts say."""
    failed = (0, -2, "problem", "package", "", "", 0, "DOC-PARSE-FAILED")
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
        if _unsafe(package):
            yield failed
            return
        entries = package.infolist()
        names = [i.filename for i in entries]
        first = [names.index(n) if n in names else -1 for n in (CONTENT_TYPES, RELATIONSHIPS, MAIN[kind][0])]
        if min(first) < 0:
            yield 0, -2, "problem", "package", "", "", 0, "DOC-FORMAT-MISMATCH"
            return
        whole: list[str] = []
        for n in [*first[:2], *(n for n in range(len(entries)) if n not in first[:2])]:
            entry, location = entries[n], f"part:{n + 1}"
            low = unicodedata.normalize("NFKC", entry.filename).lower()
            if entry.is_dir():
                continue
            yield n + 1, -2, "entry", location, entry.filename, "", 0, low
            if low.endswith((".xml", ".rels")):
                try:
                    rows = _read(package, entry)
                except (ParseError, zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, ValueError):
                    yield failed if n in first[:2] else (n + 1, *failed[1:])
                    return
                yield from ((n + 1, at, what, location, entry.filename, name, depth, text) for at, what, name, depth, text in rows)
                whole += [(n, what, text) for _, what, _, _, text in rows if what in ("text", "attribute")]
        whole.sort(key=lambda x: x[0])
        # Attributes before a text would hide a word at its start, so texts of several parts are joined without them, too.
        if len({n for n, what, _ in whole if what == "text"}) > 1:
            yield 2**31 - 1, 0, "joined", "cross_part_text", "", "", 0, "".join(t for _, what, t in whole if what == "text")
        yield 2**31 - 1, 1, "joined", "cross_part_text", "", "", 0, "".join(t for _, _, t in whole)
    except (zipfile.BadZipFile, zlib.error, EOFError, ValueError, NotImplementedError):
        yield failed


def _pdf(content: bytes) -> Iterator[tuple]:
    found = ["DOC-PDF-TEXT-UNINSPECTED"]
    if content.count(b"%%EOF") > 1 or content.count(b"startxref") > 1:
        found.append("DOC-PDF-REVISION-HISTORY")
    end = content.rfind(b"%%EOF")
    if end < 0 or content[end + 5 :].strip():
        found.append("DOC-PDF-TRAILING-CONTENT")
    yield from ((1, i, "structure", "pdf:structure", "", "", 0, rule) for i, rule in enumerate(found))


def _document(content: bytes, kind: str) -> Iterator[tuple]:
    magic = MAGIC.get(kind)
    problem = "DOC-SIZE" if not content else "DOC-UNSUPPORTED" if not magic else None if content.startswith(magic) else "DOC-FORMAT-MISMATCH"
    yield 0, -3, "document", "", "", "", len(content), hashlib.sha256(content).hexdigest()
    if problem:
        yield 0, -2, "problem", "package", "", "", 0, problem
    else:
        yield from _pdf(content) if kind == "pdf" else _office(content, kind)


def _plain(kind: str, text: str) -> str | None:
    """NFKC of what a document says, where that is another text."""
    return None if kind not in SPOKEN or text.isascii() else s.changed_by_nfkc(text)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents are taken one by one, and rows handed on by their number and size: a task holds little, whatever its batches."""
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (c.split() for c in PARTS.split(", "))])
    rows, chars = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for frame in batches:
        for doc, path, content, kind in zip(*(frame.column(c) for c in ("doc", "path", "content", "extension"))):
            doc, path, content, kind = doc.as_py(), path.as_py(), content.as_py(), kind.as_py()
            named = kind if kind in MAGIC and content else "unknown"
            for row in _document(content, kind):
                plain = _plain(row[2], row[-1])
                rows.append((doc, path, named, *row, plain))
                chars += len(row[-1]) + len(plain or "")
                if len(rows) >= CHUNK or chars >= CHUNK_CHARS:
                    yield batch()
                    rows, chars = [], 0
    if rows:
        yield batch()


def document_parts(documents: DataFrame) -> DataFrame:
    """What documents (path, content, extension) hold: doc (a number of the row), path, format, part, at, kind, location, entry,
    name, depth, text, plain (its NFKC, where that is another text).

    kind: `document` (depth: bytes, text: SHA-256), `entry` of a package (text: its name in small letters),
    `text` and `attribute` (each text of an element and attribute value once), `joined` (texts of a scope, a part or all
    parts, which may be split over elements; a scope's if it isn't its part's), `element` (text: attributes as JSON, where they say something), `structure` and
    `problem` (text: a finding). part and at give the order in the document. Hidden sheets, notes and metadata count. A null
    content is empty, a null extension unsupported.
    """
    kind = F.regexp_replace(F.lower(F.coalesce("extension", F.lit(""))), r"^\.", "")
    rows = documents.select(F.monotonically_increasing_id().alias("doc"), "path", F.coalesce("content", F.lit(b"")).alias("content"), kind.alias("extension"))
    return rows.mapInArrow(_parts, PARTS)


def _one(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _hits(parts: DataFrame) -> DataFrame:
    """`parts` with the findings of each row as `hits`.

    Texts and counts are columns of their own, each used more than once, so that Spark evaluates them once.
    """
    spoken = F.col("kind").isin(*SPOKEN)
    t = parts.withColumn("_t", F.when(spoken, F.coalesce("plain", "text"))).withColumn("_a", F.from_json(F.when(F.col("kind") == "element", F.col("text")), "map<string,string>"))
    t = t.withColumn("_low", F.lower("_t"))
    is_, entry = (lambda k: F.col("kind") == k), F.col("kind") == "entry"
    on = lambda *names: is_("element") & F.col("name").isin(*names)
    media = F.col("text").contains("/media/")
    hidden = on("sheet", "row", "col") & (F.coalesce(F.col("_a.state").isin("hidden", "veryHidden"), F.lit(False)) | F.coalesce(F.col("_a.hidden").isin("1", "true"), F.lit(False)))
    hits = [(rule, level, F.when(s.may_match(F.col("_t"), p, F.col("_low")), F.regexp_count("_t", F.lit(p)))) for rule, level, p in TEXT_RULES]
    hits += [
        ("DOC-ACTIVE-CONTENT", "block", _one(entry & F.col("text").rlike(s.ACTIVE)) + _one(is_("attribute") & (F.col("name") == "Override") & F.col("text").rlike(MACRO))),
        ("DOC-IMAGE-UNINSPECTED", "review", _one(entry & media)),
        ("DOC-BINARY-UNINSPECTED", "review", _one(entry & ~media & ~F.col("text").rlike(r"\.(xml|rels)$"))),
        ("DOC-EXTERNAL-REFERENCE", "review", _one(on("Relationship") & (F.col("_a.TargetMode") == "External"))),
        ("DOC-HIDDEN-CONTENT", "review", _one(hidden | on("sld") & F.coalesce(F.col("_a.show").isin("0", "false"), F.lit(False)))),
        *[(rule, "review", _one(is_("structure") & (F.col("text") == rule))) for rule in PARTIAL if rule.startswith("DOC-PDF")],
    ]
    t = t.withColumns({f"_n{i}": n.cast("long") for i, (_, _, n) in enumerate(hits)})
    found = [F.when(F.col(f"_n{i}") > 0, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.col(f"_n{i}").alias("n"))) for i, (rule, level, _) in enumerate(hits)]
    return t.withColumn("hits", F.array_compact(F.array(*found)))


def _facts() -> dict[str, Column]:
    """What a row with attributes `_a` tells of its document: whether it is a unit, and how its package names the main part."""
    attribute = lambda n: F.coalesce(F.col(f"_a.{n}"), F.lit(""))
    by_format = lambda i: F.when(F.col("format") == "xlsx", MAIN["xlsx"][i]).otherwise(MAIN["pptx"][i])
    within = lambda entry, name, depth: (F.col("kind") == "element") & (F.col("entry") == entry) & (F.col("name") == name) & (F.col("depth") == depth)
    override = within(CONTENT_TYPES, "Override", 1) & (attribute("PartName") == F.concat(F.lit("/"), by_format(0)))
    office = within(RELATIONSHIPS, "Relationship", 1) & attribute("Type").endswith("/officeDocument")
    target = (F.regexp_replace(attribute("Target"), "^/+", "") == by_format(0)) & attribute("TargetMode").isin("", "Internal")
    return {
        "units": _one((F.col("kind") == "entry") & F.col("text").rlike(UNIT)),
        "roots": _one(within(CONTENT_TYPES, TYPES_ROOT, 0)),
        "overrides": _one(override),
        "good_overrides": _one(override & (attribute("ContentType") == by_format(1))),
        "offices": _one(office),
        "good_offices": _one(office & target),
    }


def _ordered(rows: DataFrame, facts: list[Column]) -> DataFrame:
    """(doc, rule, level, count, locations) and `facts` from rows with a finding `h` or none: every match counts, the first
    five locations are shown.

    What only a join of texts holds counts once, and only where it comes before any other match of its rule.
    """
    order = Window.partitionBy("doc", "h.rule", "h.level").orderBy("part", "at")
    adds = F.when(F.col("kind") != "joined", F.col("h.n")).when(F.row_number().over(order) == 1, 1).otherwise(0)
    counted = rows.withColumn("adds", adds.cast("long"))
    counted = counted.withColumn("before", F.sum("adds").over(order) - F.col("adds"))
    shown = F.array_repeat("location", F.least("adds", 5 - F.col("before")).cast("int"))
    shown = F.when((F.col("before") < 5) & (F.col("adds") > 0), F.struct("part", "at", shown.alias("locations")))
    per = counted.groupBy("doc", F.col("h.rule").alias("rule"), F.col("h.level").alias("level")).agg(F.sum("adds").alias("count"), F.array_sort(F.collect_list(shown)).alias("shown"), *facts)
    return per.withColumn("locations", F.flatten("shown.locations")).drop("shown")


def findings(parts: DataFrame) -> DataFrame:
    """Per document of document_parts(): path, format, input_sha256, bytes_scanned, units, findings.

    findings is an array of (rule, level, count, locations), in order of rule. A document that can't be read has one
    finding alone: what is wrong with the package, else that its main part isn't what it says, else that a part fails.
    Only rows that tell something are shuffled, once, by document.
    """
    told = {n: c for n, c in _facts().items()}
    document = F.when(F.col("kind") == "document", F.struct("path", "format", F.col("text").alias("input_sha256"), F.col("depth").cast("long").alias("bytes_scanned")))
    problem = F.when(F.col("kind") == "problem", F.struct("part", F.col("text").alias("rule")))
    rows = _hits(parts).select("doc", "part", "at", "kind", "location", document.alias("document"), problem.alias("problem"), *[c.alias(n) for n, c in told.items()], F.posexplode_outer("hits").alias("k", "h"))
    # The condition names what is exploded, so Spark can't search all texts a second time to filter before that.
    rows = rows.where(F.col("h").isNotNull() | F.col("document").isNotNull() | F.col("problem").isNotNull() | F.expr(" + ".join(told) + " > 0")).repartition("doc")
    # What holds of a row counts with its first finding only.
    sums = [F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, F.col(n))).alias(n) for n in told]
    per = _ordered(rows, [F.max("document").alias("document"), F.min("problem").alias("problem"), *sums])
    found = F.array_sort(F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("rule", "level", "count", "locations"))))
    docs = per.groupBy("doc").agg(F.max("document").alias("document"), F.min("problem").alias("problem"), found.alias("found"), *[F.sum(n).alias(n) for n in told]).select("document.*", "problem", "found", *told)

    office = F.col("format").isin(*MAIN)
    fake = office & ~F.expr("roots = 1 and overrides = 1 and good_overrides = 1 and offices = 1 and good_offices = 1")
    wrong = F.when(F.col("problem.part") == 0, F.col("problem.rule")).when(fake, "DOC-FORMAT-MISMATCH").otherwise(F.col("problem.rule"))
    level = F.create_map(*[F.lit(x) for kv in UNREADABLE.items() for x in kv])
    single = lambda rule, level, locations: F.array(F.struct(rule.alias("rule"), level.alias("level"), F.lit(1).cast("long").alias("count"), locations.cast("array<string>").alias("locations")))
    no_content = single(F.lit("DOC-NO-CONTENT"), F.lit("review"), F.array(F.lit("package")))
    docs = docs.withColumn("wrong", wrong)
    unread = F.col("wrong").isNotNull()
    all_ = F.when(unread, single(F.col("wrong"), level[F.col("wrong")], F.array())).when(office & (F.col("units") == 0), F.array_sort(F.concat("found", no_content))).otherwise(F.col("found"))
    return docs.select("path", "format", "input_sha256", "bytes_scanned", F.when(unread, 0).otherwise(F.col("units")).alias("units"), all_.alias("findings"))


#: Fixed in every report: what made it, what it did not do, and that it releases nothing.
REPORT = {"scanner": "documents-1", "ocr_performed": False, "malware_scan_performed": False, "network_isolation_verified": False, "release_authorized": False, "report_schema": "pathwatch.document-report.v1"}


def inspect_documents(documents: DataFrame) -> DataFrame:
    """A report of each row of documents (path, content, extension): path, input_sha256, format, verdict, coverage, units,
    bytes_scanned, findings, and what holds for all reports.

    coverage is unreadable, partial or supported_text_complete. Only a complete one without findings is no_findings.
    """
    f = findings(document_parts(documents))
    wrong = F.exists("findings", lambda x: x.rule.isin(*UNREADABLE))
    part = F.exists("findings", lambda x: x.rule.isin(*PARTIAL))
    coverage = F.when(wrong, "unreadable").when(part, "partial").otherwise("supported_text_complete")
    verdict = F.when(F.exists("findings", lambda x: x.level == "block"), "block").when((coverage != "supported_text_complete") | (F.size("findings") > 0), "review").otherwise("no_findings")
    return f.select("path", "input_sha256", "format", verdict.alias("verdict"), coverage.alias("coverage"), "units", "bytes_scanned", "findings", *[F.lit(v).alias(k) for k, v in REPORT.items()])


def finding_rows(documents: DataFrame) -> DataFrame:
    """(path, rule, level, count, locations): the findings of each row of documents."""
    return findings(document_parts(documents)).select("path", F.explode("findings").alias("f")).select("path", "f.*")


def redacted(text: Column) -> Column:
    """A preview: withheld whole if it holds a secret or personal data, else with classification marks replaced."""
    return F.when(s.matches(text, s.SECRET) | s.matches(text, s.PERSONAL), "[withheld]").otherwise(F.regexp_replace(text, s.CONFIDENTIAL, "[redacted]"))


def read_documents(spark, path: str) -> DataFrame:
    """(path, content, extension) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.lower(F.element_at(F.split("path", r"\."), -1)).alias("extension"))
