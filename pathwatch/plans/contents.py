"""Registered queries over contents, documents as bytes, journals and drained streams."""

from __future__ import annotations

import io
import re
import threading
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import scalars as s
from ..operators import audit, content, documents, evaluate, posture
from ..sources import sinks
from ..streaming import streams
from . import adapters as t
from . import landing
from .imports import KEY, hmac_sql, pick
from .registry import _BULK, _EVL, _JOURNAL, _PERSONAL_RE, _POSTURE, _PREFLIGHT, _SECRET_RE, _STALE, _SWEEP, CONFIG, _journal, _posture, _scored, _sweep, joined, query, table

_CONFIDENTIAL_RE = s.CONFIDENTIAL
_INJECTION_RE = s.INJECTION

# --- documents as bytes

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


_SHEET, _SLIDE = "xl/worksheets/sheet{}.xml", "ppt/slides/slide{}.xml"
_REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def _frame(kind: str = "xlsx", override: str | None = None, target: str | None = None) -> dict[str, str]:
    """The parts that name a package's main part, and the main part."""
    main, mime = documents.MAIN[kind]
    override = f'<Override PartName="/{main}" ContentType="{mime}"/>' if override is None else override
    return {
        documents.CONTENT_TYPES: f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{override}</Types>',
        documents.RELATIONSHIPS: _REL.format(f'<Relationship Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{target or main}"/>'),
        main: '<workbook><sheet state="visible"/></workbook>',
    }


def _zipped(parts: dict[str, str], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body, compress_type=method if "sheet" in name else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _cell(text: str) -> str:
    return f"<worksheet><c><v>{escape(_CONTROL.sub(' ', text))}</v></c></worksheet>"


def _package(texts: list[str], hidden: bool, external: bool, media: bool, active: bool) -> bytes:
    """A workbook with a sheet for each text that isn't blank."""
    parts = _frame()
    if hidden:
        parts["xl/workbook.xml"] = '<workbook><sheet state="hidden"/></workbook>'
    parts |= {_SHEET.format(i + 1): _cell(text) for i, text in enumerate(texts) if text.strip()}
    if external:
        parts["xl/_rels/workbook.xml.rels"] = _REL.format('<Relationship TargetMode="External" Target="x"/>')
    if media:
        parts["xl/media/image1.png"] = "png"
    if active:
        parts["xl/vbaProject.bin"] = "macro"
    return _zipped(parts)


@F.arrow_udf(BinaryType())
def _packed(left: pa.Array, right: pa.Array, k: pa.Array) -> pa.Array:
    rows = ((a.as_py(), b.as_py(), n.as_py()) for a, b, n in zip(left, right, k))
    return pa.array((_package([x for x in (a, b) if x is not None], n % 5 == 0, n % 7 == 0, n % 11 == 0, n % 13 == 0) if a is not None else None for a, b, n in rows), pa.binary())


#: Faults that a package can have, in order of the remainder that chooses them.
_FAULTS = [
    "none", "no content types", "no override", "override names another type", "relationship names another part", "external main part", "macro override", "other compression",
    "names differ in case", "path leaves the package", "no sheet", "split over attributes", "expands too far", "entity", "hidden slide", "hidden row",
]


def _faulty(text: str, fault: str) -> bytes:
    kind = "pptx" if fault == "hidden slide" else "xlsx"
    main, mime = documents.MAIN[kind]
    parts = _frame(kind)
    if fault == "no content types":
        del parts[documents.CONTENT_TYPES]
    elif fault == "no override":
        parts = _frame(override="")
    elif fault == "override names another type":
        parts = _frame(override=f'<Override PartName="/{main}" ContentType="application/xml"/>')
    elif fault == "relationship names another part":
        parts = _frame(target="xl/other.xml")
    elif fault == "external main part":
        parts[documents.RELATIONSHIPS] = parts[documents.RELATIONSHIPS].replace("/></R", ' TargetMode="External"/></R')
    elif fault == "macro override":
        parts = _frame(override=f'<Override PartName="/{main}" ContentType="{mime}"/><Override PartName="/xl/a.xml" ContentType="application/vnd.ms-office.vbaProject"/>')
    if fault == "hidden slide":
        parts[_SLIDE.format(1)] = f'<sld show="0"><t>{escape(_CONTROL.sub(" ", text))}</t></sld>'
    elif fault == "hidden row":
        parts[_SHEET.format(1)] = _cell(text).replace("<c>", '<row hidden="1"/><row hidden="0"/><c>')
    elif fault != "no sheet":
        parts[_SHEET.format(1)] = _cell(text)
    extra = {
        "names differ in case": {"XL/Workbook.xml": "<x/>"},
        "path leaves the package": {"../x.xml": "<x/>"},
        "split over attributes": {"docProps/a.xml": '<x a=" pass"/>', "docProps/b.xml": '<x a="word=hunter2hunter2"/>'},
        "expands too far": {"xl/large.xml": " " * 200_000},
        "entity": {"xl/e.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'},
    }
    return _zipped(parts | extra.get(fault, {}), zipfile.ZIP_BZIP2 if fault == "other compression" else zipfile.ZIP_DEFLATED)


@F.arrow_udf(BinaryType())
def _packed_faulty(text: pa.Array, k: pa.Array) -> pa.Array:
    return pa.array((_faulty(t.as_py(), _FAULTS[n.as_py() % len(_FAULTS)]) for t, n in zip(text, k)), pa.binary())


#: A third of the texts gets a secret, a fifth two personal addresses and a mark, all made of the row's own key and text.
_PLANTED = "concat(text, case when doc_id % 3 = 0 then concat(' api_key=', md5(text)) else '' end, case when doc_id % 5 = 0 then concat(' x', doc_id, '@example.invalid, y', doc_id, '@example.invalid confidential') else '' end)"


_PDF = "case when doc_id % 20 = 19 then '%PDF-1.4 one %%EOF two %%EOF x' when doc_id % 30 = 9 then 'no magic %%EOF' else '%PDF-1.4 one %%EOF' end"
_PATH = "concat('d', cast(doc_id as varchar(20)), case doc_id % 10 when 9 then '.pdf' else '.xlsx' end)"


def _files(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """The documents as workbooks, every tenth as PDF; `split` halves texts over two parts of a workbook."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    half = (F.length("text") / 2).cast("int")
    left, right = (F.expr("left(text, cast(length(text) / 2 as int))"), F.substring("text", half + 1, F.length("text"))) if split else (F.col("text"), F.lit(None).cast("string"))
    pdf = F.col("doc_id") % 10 == 9
    # Python gets every row, but not the texts that aren't packed.
    body = F.when(pdf, F.expr(_PDF).cast("binary")).otherwise(_packed(F.when(~pdf, left), F.when(~pdf, right), F.col("doc_id")))
    return d.select(F.expr(_PATH.replace("varchar(20)", "string")).alias("path"), body.alias("content"), F.when(pdf, "pdf").otherwise("XLSX").alias("extension"))


_CLEAN = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')"
_BLANK = "trim(text, ' ' || chr(9) || chr(10) || chr(13)) = ''"
_BOOKS = f"SELECT *, {_PATH} AS path FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 9"
_RULE_SQL = {"DOC-SECRET": ("block", _SECRET_RE), "DOC-PII": ("review", _PERSONAL_RE), "DOC-CLASS": ("review", _CONFIDENTIAL_RE), "DOC-INJECTION": ("review", _INJECTION_RE)}
_STRUCT_SQL = " UNION ALL ".join(f"SELECT path, '{rule}' AS rule, '{level}' AS level, 1 AS count FROM books WHERE doc_id % {n} = 0" for rule, level, n in [("DOC-HIDDEN-CONTENT", "review", 5), ("DOC-EXTERNAL-REFERENCE", "review", 7), ("DOC-IMAGE-UNINSPECTED", "review", 11), ("DOC-BINARY-UNINSPECTED", "review", 13), ("DOC-ACTIVE-CONTENT", "block", 13)]) + f" UNION ALL SELECT path, 'DOC-NO-CONTENT' AS rule, 'review' AS level, 1 AS count FROM books WHERE {_BLANK}"
_PDF_SQL = f"SELECT {_PATH} AS path, doc_id % 20 = 19 AS odd, doc_id % 30 = 9 AND doc_id % 20 <> 19 AS bad FROM documents WHERE text IS NOT NULL AND doc_id % 10 = 9"


@query("doc01_extracted_texts", f"WITH books AS ({_BOOKS}) SELECT path, sha256({_CLEAN}) AS digest FROM books WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def doc01(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = documents.document_parts(_files(spark, sf_dir))
    return parts.where(f"kind = 'text' and entry = '{_SHEET.format(1)}'").select("path", F.sha2("text", 256).alias("digest"))


@query("src16_document_files", f"WITH books AS ({_BOOKS}) SELECT path, sha256({_CLEAN}) AS digest FROM books WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As doc01, of a landed table of bytes that is read back."""
    parts = documents.document_parts(landing.parquet(_files(spark, sf_dir)))
    return parts.where(f"kind = 'text' and entry = '{_SHEET.format(1)}'").select("path", F.sha2("text", 256).alias("digest"))


@query("doc02_structure_findings", f"WITH books AS ({_BOOKS}), pdfs AS ({_PDF_SQL}) {_STRUCT_SQL}")
def doc02(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.finding_rows(_files(spark, sf_dir).where("extension = 'XLSX'"))
    return found.where(~F.col("rule").isin(*_RULE_SQL)).select("path", "rule", "level", "count")


def _text_rules(where: str) -> str:
    return " UNION ALL ".join(f"SELECT path, '{rule}' AS rule, '{level}' AS level FROM books WHERE {where.replace('RE', chr(39) + pattern + chr(39))}" for rule, (level, pattern) in _RULE_SQL.items())


@query("doc03_text_findings", f"WITH books AS ({_BOOKS}) {_text_rules('regexp_matches(text, RE)')}")
def doc03(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.finding_rows(_files(spark, sf_dir).where("extension = 'XLSX'"))
    return found.where(F.col("rule").isin(*_RULE_SQL)).select("path", "rule", "level")


#: Attributes of the workbook and of its relationships, between which all parts joined hold the text.
_AROUND = "CASE WHEN doc_id % 5 = 0 THEN 'hidden' ELSE 'visible' END", "CASE WHEN doc_id % 7 = 0 THEN 'Externalx' ELSE '' END"


@query("doc04_split_over_parts", f"WITH books AS ({_BOOKS}) {_text_rules('regexp_matches(text, RE) OR regexp_matches(left(text, CAST(floor(length(text) / 2) AS INTEGER)), RE) OR regexp_matches(substr(text, CAST(floor(length(text) / 2) AS INTEGER) + 1), RE) OR regexp_matches(concat(' + _AROUND[0] + ', text, ' + _AROUND[1] + '), RE)')}")
def doc04(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.finding_rows(_files(spark, sf_dir, split=True).where("extension = 'XLSX'"))
    return found.where(F.col("rule").isin(*_RULE_SQL)).select("path", "rule", "level")


@query("doc05_document_verdicts", f"WITH books AS ({_BOOKS}), v AS (SELECT path, doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AS any_text, {' OR '.join(f'regexp_matches(text, {chr(39)}{p}{chr(39)})' for _, (_, p) in _RULE_SQL.items())} AS found, regexp_matches(text, '{_SECRET_RE}') AS secret FROM books) SELECT path, CASE WHEN secret OR doc_id % 13 = 0 THEN 'block' WHEN found OR NOT any_text OR doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'review' ELSE 'no_findings' END AS verdict, CASE WHEN NOT any_text OR doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'partial' ELSE 'supported_text_complete' END AS coverage FROM v")
def doc05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.inspect_documents(_files(spark, sf_dir).where("extension = 'XLSX'")).select("path", "verdict", "coverage")


@query("doc06_pdf_structure", f"WITH p AS ({_PDF_SQL}) SELECT path, unnest(CASE WHEN bad THEN ['DOC-FORMAT-MISMATCH'] WHEN odd THEN ['DOC-PDF-REVISION-HISTORY', 'DOC-PDF-TRAILING-CONTENT', 'DOC-PDF-TEXT-UNINSPECTED'] ELSE ['DOC-PDF-TEXT-UNINSPECTED'] END) AS rule FROM p")
def doc06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.finding_rows(_files(spark, sf_dir).where("extension = 'pdf'")).select("path", "rule")


@query("doc07_redacted_previews", f"SELECT conv_id, turn, CASE WHEN regexp_matches(x, '{_SECRET_RE}') OR regexp_matches(x, '{_PERSONAL_RE}') THEN '[withheld]' ELSE regexp_replace(x, '{_CONFIDENTIAL_RE}', '[redacted]', 'g') END AS preview FROM (SELECT conv_id, turn, concat(text, CASE WHEN turn % 2 = 0 THEN ' 社外秘 Confidential' ELSE '' END) AS x FROM conversations WHERE text IS NOT NULL)")
def doc07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    text = F.concat("text", F.when(F.col("turn") % 2 == 0, " 社外秘 Confidential").otherwise(""))
    return rows.select("conv_id", "turn", documents.redacted(text).alias("preview"))


@query("doc08_document_reports", f"WITH p AS ({_PDF_SQL}) SELECT {_PATH} AS path, sha256({_PDF}) AS input_sha256, 'pdf' AS format, CASE WHEN bad THEN 'block' ELSE 'review' END AS verdict, CASE WHEN bad THEN 'unreadable' ELSE 'partial' END AS coverage, CAST(0 AS BIGINT) AS units, CAST(strlen({_PDF}) AS BIGINT) AS bytes_scanned, 'documents-1' AS scanner, false AS ocr_performed, false AS malware_scan_performed, false AS network_isolation_verified, false AS release_authorized, 'pathwatch.document-report.v1' AS report_schema FROM documents JOIN p ON p.path = {_PATH} WHERE text IS NOT NULL AND doc_id % 10 = 9")
def doc08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.inspect_documents(_files(spark, sf_dir).where("extension = 'pdf'")).drop("findings")


def _fault(*names: str) -> str:
    return f"doc_id % {len(_FAULTS)} IN ({', '.join(str(_FAULTS.index(n)) for n in names)})"


_WRONG = {"DOC-PARSE-FAILED": ("review", ("other compression", "names differ in case", "path leaves the package", "expands too far", "entity")), "DOC-FORMAT-MISMATCH": ("block", ("no content types", "no override", "override names another type", "relationship names another part", "external main part"))}
_ODD = {"DOC-ACTIVE-CONTENT": ("block", "part:1", "macro override"), "DOC-NO-CONTENT": ("review", "package", "no sheet"), "DOC-HIDDEN-CONTENT": ("review", "part:4", "hidden slide", "hidden row")}


def _faulty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr(_PLANTED).alias("text"))
    return d.select(F.concat(F.lit("f"), "doc_id").alias("path"), _packed_faulty("text", "doc_id").alias("content"), F.when(F.col("doc_id") % len(_FAULTS) == _FAULTS.index("hidden slide"), ".pptx").otherwise("xlsx").alias("extension"))


#: In a text that one cell holds, a rule counts its matches and once more what the part as a whole says, before them.
_FAULTY_SQL = f"""
WITH d AS (SELECT doc_id, concat('f', doc_id) AS path, {_PLANTED} AS text FROM documents WHERE text IS NOT NULL),
told AS (SELECT * FROM d WHERE NOT ({_fault(*[f for _, fs in _WRONG.values() for f in fs])}) AND NOT {_fault("no sheet")}),
hits AS ({" UNION ALL ".join(f"SELECT doc_id, path, '{rule}' AS rule, '{level}' AS level, len(regexp_extract_all(text, '{pattern}')) AS n FROM told" for rule, (level, pattern) in _RULE_SQL.items())})
SELECT path, rule, level, CAST(n + 1 AS BIGINT) AS count, array_to_string(list_transform(range(least(5, n + 1)), lambda i: 'part:4'), ',') AS locations FROM hits WHERE n > 0
UNION ALL SELECT path, rule, level, 1, 'cross_part_text' FROM hits WHERE n = 0 AND rule = 'DOC-SECRET' AND {_fault("split over attributes")}
UNION ALL {" UNION ALL ".join(f"SELECT path, '{rule}', '{level}', 1, '' FROM d WHERE {_fault(*faults)}" for rule, (level, faults) in _WRONG.items())}
UNION ALL {" UNION ALL ".join(f"SELECT path, '{rule}', '{level}', 1, '{at}' FROM d WHERE {_fault(*faults)}" for rule, (level, at, *faults) in _ODD.items())}
"""


@query("doc09_package_checks", _FAULTY_SQL)
def doc09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with each fault and with planted secrets: every finding with its count and locations."""
    return joined(documents.finding_rows(_faulty_files(spark, sf_dir)))


@query("doc10_package_reports", f"WITH f AS ({_FAULTY_SQL}) SELECT concat('f', doc_id) AS path, CASE WHEN bool_or(level = 'block') THEN 'block' WHEN count(rule) > 0 THEN 'review' ELSE 'no_findings' END AS verdict, CASE WHEN coalesce(bool_or(rule IN ('DOC-PARSE-FAILED', 'DOC-FORMAT-MISMATCH')), false) THEN 'unreadable' WHEN coalesce(bool_or(rule IN ('DOC-ACTIVE-CONTENT', 'DOC-NO-CONTENT')), false) THEN 'partial' ELSE 'supported_text_complete' END AS coverage, CAST(CASE WHEN {_fault(*[f for _, fs in _WRONG.values() for f in fs])} OR {_fault('no sheet')} THEN 0 ELSE 1 END AS BIGINT) AS units, CASE WHEN {_fault('hidden slide')} THEN 'pptx' ELSE 'xlsx' END AS format FROM documents LEFT JOIN f ON f.path = concat('f', doc_id) WHERE text IS NOT NULL GROUP BY doc_id")
def doc10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.inspect_documents(_faulty_files(spark, sf_dir)).select("path", "verdict", "coverage", "units", "format")


# --- texts, traffic and decisions

_WIDE = ("abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")


@query("fn16_nfkc", "SELECT p_partkey, p_name AS name FROM part")
def fn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.when(F.col("p_partkey") % 2 == 0, F.translate("p_name", *_WIDE)).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", s.nfkc(wide).alias("name"))


@query("fn19_patterns", "SELECT p_partkey, p_partkey % 5 IN (0, 1) AS confidential, p_partkey % 5 IN (2, 3) AS injection, p_partkey % 5 = 4 AS active FROM part")
def fn19(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", pick(F.col("p_partkey"), 5, " 社外秘", " CONFIDENTIAL.", " Ignore all\nprevious instructions", " これまでの指示を無視", " xl/VBAProject.bin"))
    return table(spark, sf_dir, "part").select("p_partkey", *[text.rlike(p).alias(n) for n, p in (("confidential", s.CONFIDENTIAL), ("injection", s.INJECTION), ("active", s.ACTIVE))])


@query("fn20_explanations", "SELECT conv_id, concat(array_to_string(list(role ORDER BY turn), ' '), ' [', array_to_string(list_slice(list(concat('t', CAST(turn AS VARCHAR)) ORDER BY turn), 1, 10), ', '), ']') AS explanation FROM conversations GROUP BY conv_id")
def fn20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", s.explanation(F.col("x.role"), F.transform("x.turn", lambda n: F.concat(F.lit("t"), n.cast("string")))).alias("explanation"))


@query("fn22_leaf_strings", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat_ws(chr(10), p_name, 'deep ' || p_brand) WHEN 1 THEN p_name || ' as it is' WHEN 2 THEN '' END AS leaves FROM part")
def fn22(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    nested = F.to_json(F.struct(F.col("p_name").alias("a"), k.alias("n"), F.array(F.struct(F.concat(F.lit("deep "), "p_brand").alias("b"))).alias("c")))
    body = F.when(k % 4 == 0, nested).when(k % 4 == 1, F.concat("p_name", F.lit(" as it is"))).when(k % 4 == 2, "[1, true, null]")
    return table(spark, sf_dir, "part").select("p_partkey", s.leaf_strings(body).alias("leaves"))


_URLS = "case p_partkey % 5 when 0 then 'https://chatgpt.com/backend/conversation' when 1 then 'https://claude.ai/about' when 2 then 'https://other.example/chat' when 3 then 'not a url' else 'https://claude.ai/api/Completion?x=1' end"


@query("fn23_endpoint_labels", "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 4) THEN 'known' ELSE 'other' END AS label FROM part")
def fn23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", s.endpoint_label(F.expr(_URLS)).alias("label"))


@query("flt02_prompt_traffic", "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 4) THEN 'known' ELSE 'other' END AS endpoint, p_partkey % 4 = 2 AS unread FROM part WHERE p_partkey % 5 IN (0, 1, 4) AND p_partkey % 3 > 0 AND p_partkey % 4 IN (0, 2)")
def flt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    body = F.when(k % 4 == 0, F.concat("p_name", F.lit(" and much more text than forty characters"))).when(k % 4 == 1, "short")
    body = F.when(k % 4 == 3, "   ").otherwise(body)
    traffic = table(spark, sf_dir, "part").select("p_partkey", F.expr(_URLS).alias("url"), pick(k, 3, "GET", "post", "PUT").alias("method"), body.alias("body"))
    return content.prompt_traffic(traffic).select("p_partkey", "endpoint", F.col("text").isNull().alias("unread"))


@query("det25_traffic_decisions", "SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1) THEN 'block' WHEN p_partkey % 4 = 0 THEN 'confirm' WHEN p_partkey % 6 = 2 THEN 'block' WHEN p_partkey % 6 = 3 THEN 'confirm' ELSE 'allow' END AS action, p_partkey % 6 > 1 AND (p_partkey % 4 = 0 OR p_partkey % 6 = 3) AS override, 24 AS rules FROM part")
def det25(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    outcome = pick(k, 6, None, "error", "block", "review", "allow", "no_findings")
    action, override, shown = content.traffic_decision(outcome, F.when(k % 4 > 0, F.lit(True)), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: i.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", action.alias("action"), override.alias("override"), F.size(shown).alias("rules"))


_DECIDED = "SELECT event_id, action, rule_ids, CASE WHEN regexp_matches(rule_ids, 'PG-00[1237]') THEN 'block' WHEN rule_ids <> '' THEN 'review' ELSE 'allow' END AS decision FROM d"
_MESSAGES = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v[0].replace(chr(39), chr(39) * 2)}'" for k, v in content.RULES.items()) + " END"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.preflight(t.requests(spark, sf_dir), t.grants(spark))


@query("det23_replayed_history", t.with_tables("requests", more=_PREFLIGHT, sql=f"SELECT event_id, decision, 'historical_execution_unknown' AS state FROM ({_DECIDED})"))
def det23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.replay(t.requests(spark, sf_dir), t.grants(spark)).select("event_id", "decision", "state")


@query("fn24_decision_findings", t.with_tables("requests", more=_PREFLIGHT, sql=f"SELECT concat('F-', substr(sha256(concat('[\"PREFLIGHT\",[\"', event_id, '\"]]')), 1, 14)) AS id, CASE decision WHEN 'block' THEN 'P1' ELSE 'P2' END AS priority, rule_ids AS reasons, event_id AS evidence_ids FROM ({_DECIDED}) WHERE decision <> 'allow'"))
def fn24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(content.decision_findings(_decisions(spark, sf_dir)).select("id", "priority", "reasons", "evidence_ids"))


@query("fn25_decision_reports", t.with_tables("requests", more=_PREFLIGHT, sql=f"SELECT event_id, CASE WHEN rule_ids = '' THEN 'no rule applies to what was supplied' ELSE array_to_string([{_MESSAGES} FOR x IN string_split(rule_ids, ',')], ',') END AS messages FROM ({_DECIDED})"))
def fn25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(content.report(_decisions(spark, sf_dir)).select("event_id", "messages"))


@query("val09_request_problems", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'bad_event_id' END, CASE WHEN doc_id % 5 = 0 THEN 'bad_action' END, CASE WHEN doc_id % 6 = 0 THEN 'bad_data_class' END, CASE WHEN doc_id % 11 = 0 OR text IS NULL THEN 'text_too_long' END, CASE WHEN doc_id % 5 > 0 AND doc_id % 4 >= 2 AND doc_id % 3 = 0 THEN 'tool_only_for_agents' END) AS problems FROM documents WHERE doc_id % 5 > 0 OR doc_id % 4 < 2")
def val09(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where("doc_id % 5 > 0 or doc_id % 4 < 2").select("doc_id", F.concat(F.when(k % 7 == 0, "ev-").otherwise("EV-"), k.cast("string")).alias("event_id"), F.when(k % 5 == 0, "mail.read").otherwise(pick(k, 4, "ai.prompt", "mail.send", "agent.read", "agent.execute")).alias("action"), F.when(k % 6 > 0, "public").alias("data_class"), F.when(k % 11 == 0, F.repeat(F.lit("x"), content.TEXT_BYTES + 1)).otherwise(F.substring("text", 1, 1000)).alias("text"), F.when((k % 4 >= 2) & (k % 3 > 0), "reader").alias("tool"))
    return joined(content.request_problems(rows).select("doc_id", "problems"))


@query("val10_grant_problems", "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'action_needs_a_person' END, CASE WHEN p_partkey % 4 = 0 THEN 'class_can''t_be_granted' END, CASE WHEN p_partkey % 10 < 2 AND count(*) OVER (PARTITION BY p_partkey % 3, CASE WHEN p_partkey % 10 < 2 THEN p_partkey - p_partkey % 10 + 2 ELSE p_partkey END) > 1 THEN 'repeated_grant' WHEN p_partkey % 10 = 2 AND count(*) OVER (PARTITION BY p_partkey % 3, CASE WHEN p_partkey % 10 < 2 THEN p_partkey - p_partkey % 10 + 2 ELSE p_partkey END) > 1 THEN 'repeated_grant' END) AS problems FROM part")
def val10(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    to = F.when(k % 10 < 2, k - k % 10 + 2).otherwise(k)
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(k, 3, "agent.write", "ai.prompt", "agent.read").alias("action"), F.concat(F.lit("https://h.example/"), to.cast("string")).alias("destination"), F.array(F.lit("public"), F.when(k % 4 == 0, "restricted").otherwise("internal")).alias("data_classes"), F.lit(None).cast("string").alias("tool"))
    return joined(content.grant_problems(rows).select("p_partkey", "problems"))


@query("src15_corpus_with_parts", f"WITH v AS (SELECT d.lang AS category, regexp_matches(d.text, '{_SECRET_RE}') OR regexp_matches(d.text, '{_PERSONAL_RE}') AS hit, l.toxic = 1 AS want FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL) SELECT category, count(*) AS total, count(*) FILTER (WHERE hit) AS detected, count(*) FILTER (WHERE want AND NOT hit) AS missed FROM v GROUP BY category")
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").join(table(spark, sf_dir, "labels"), "doc_id")
    half = (F.length("text") / 2).cast("int")
    parts = F.when(F.col("doc_id") % 2 == 1, F.array(F.expr("left(text, cast(length(text) / 2 as int))"), F.substring("text", half + 1, F.length("text"))))
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), F.when(F.col("toxic") == 1, "detect").otherwise("clean").alias("expect"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"), parts.alias("parts"))
    per, _, _ = content.measure(content.read_corpus(spark, landing.lines(rows, F.to_json(F.struct("*")))))
    return per.drop("false_alarms")


# --- posture, transfers and rules

_DENSE = {"dense": "SELECT * REPLACE (915148800 + (at - 694224000) // 60 AS at) FROM dlp"}


@query("det08_repeated_transfers", t.with_tables("dlp", more=_DENSE | {"firsts": "SELECT * FROM dense QUALIFY row_number() OVER (PARTITION BY source, event_id ORDER BY at) = 1", "lagged": "SELECT actor, at, source, event_id, lag(at, 2) OVER w AS start, concat_ws(',', lag(event_id, 2) OVER w, lag(event_id) OVER w, event_id) AS e FROM firsts WHERE tenant IN ('personal', 'unknown') WINDOW w AS (PARTITION BY actor ORDER BY at, source, event_id)"}, sql="SELECT 'DLP-002' AS rule, actor, e AS evidence_ids FROM lagged WHERE at - start <= 86400 QUALIFY row_number() OVER (PARTITION BY actor ORDER BY at, source, event_id) = 1"))
def det08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates are taken sixty times as dense, so that actors have three transfers in a day."""
    dense = t.dlp(spark, sf_dir).withColumn("at", F.lit(915_148_800) + F.floor((F.col("at") - 694_224_000) / 60))
    return joined(posture.repeated_transfers(dense)).select("rule", "actor", "evidence_ids")


@query("det17_feed_freshness", f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'published_at_fallback' ELSE 'fetched_at' END AS basis, {t.NOW} - c_custkey * 600 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 300 END AS basis_at, c_custkey * 600 - CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 300 END <= 172800 AS fresh FROM customer")
def det17(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    feeds = table(spark, sf_dir, "customer").select("c_custkey", (t.NOW - k * 600).alias("published_at"), F.when(k % 3 > 0, t.NOW - k * 600 + 300).alias("fetched_at"))
    fresh = posture.kev_freshness(feeds.select("published_at", "fetched_at"), t.NOW)
    shift = F.when(F.col("basis") == "fetched_at", 300).otherwise(0)
    return fresh.select(F.expr("cast(0 as bigint)").alias("z"), "*").select(((t.NOW - F.col("basis_at") + shift) / 600).cast("long").alias("c_custkey"), "basis", "basis_at", "fresh")


def _text_hmac(kind: str, value: str) -> str:
    return hmac_sql(f"encode('{kind}') || unhex('00') || encode({value})")


@query("det18_risky_assets", t.with_tables("inventory", "advisories", more=_POSTURE, sql=f"SELECT {_text_hmac('organization', chr(39) + 'org0' + chr(39))} AS organization, {_text_hmac('org0:asset', 'id')} AS asset FROM per WHERE hits > 0 AND exposed AND (hot OR sensitive)"))
def det18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posture.risky_assets(_posture(spark, sf_dir), KEY, "org0")


@query("val13_feed_problems", "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'bad_cve' END, CASE WHEN p_partkey % 3 = 0 THEN 'bad_source' END, CASE WHEN p_partkey % 7 = 0 THEN 'bad_vendor' END) AS problems, CASE WHEN p_partkey % 2 = 0 THEN 'bad_version' ELSE '' END AS inventory_problems, CASE WHEN p_partkey % 11 = 0 THEN 'bad_time' ELSE '' END AS time_problems FROM part")
def val13(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p-"), k.cast("string")).alias("id"), F.when(k % 5 == 0, "CVE-25-1").otherwise("CVE-2025-10001").alias("cve"), F.when(k % 3 == 0, "http://a.example").otherwise("https://a.example").alias("source"), F.when(k % 7 > 0, F.col("p_type")).alias("vendor"), F.col("p_brand").alias("product"), F.when(k % 2 == 0, "").otherwise("1.0").alias("version"), (t.NOW + F.when(k % 11 == 0, 61).otherwise(60)).alias("observed_at"))
    rows = posture.advisory_problems(rows).withColumn("_a", F.array_join("problems", ",")).withColumn("vendor", F.lit("v"))
    rows = posture.inventory_problems(rows).withColumn("_i", F.array_join("problems", ","))
    return posture.feed_time_problems(rows, t.NOW).select("p_partkey", F.col("_a").alias("problems"), F.col("_i").alias("inventory_problems"), F.array_join("problems", ",").alias("time_problems"))


# --- journal and results


_PAYLOAD = '{"decision":"allow","rule_ids":["PG-006"]}'
_LINKED = {"linked": f"SELECT *, sha256(CAST(seq - 2 AS VARCHAR)) AS prev, '{_PAYLOAD}' AS payload FROM journal"}


@query("aud02_expected_macs", t.with_tables(more=_JOURNAL | _LINKED, sql="SELECT seq, " + hmac_sql("encode(concat('[', CAST(seq AS VARCHAR), ',\"', at, '\",\"', action, '\",', CAST(to_json(payload) AS VARCHAR), ',\"', prev, '\"]'))") + " AS want FROM linked"))
def aud02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.expected_macs(_journal(spark, sf_dir), KEY).select("seq", "want")


@query("aud02_from_an_anchor", "SELECT o_orderkey + 1 AS seq, CASE WHEN o_orderkey % 500 = 7 THEN 'gap' ELSE 'broken_link' END AS problem FROM orders WHERE o_orderkey >= 100 AND (o_orderkey % 500 = 7 OR o_orderkey % 500 = 300)")
def aud02_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 500th row is missing and the row after it has no predecessor; others have a wrong link."""
    j = _journal(spark, sf_dir).where("seq % 500 <> 7").withColumn("prev", F.when(F.col("seq") % 500 == 301, F.lit("0" * 64)).otherwise(F.col("prev")))
    anchor = (100, "8c1f1046219ddd216a023f792356ddf127fce372a72ec9b4cdac989ee5b0b455")
    return audit.chain_problems(j, KEY, anchor).where("problem in ('gap', 'broken_link')")


def _pseudonym(namespace: str, value: str) -> str:
    return f"concat('{namespace}-', substr({_text_hmac(namespace, value)}, 1, 24))"


@query("aud04_metadata_entries", "SELECT 'decision' AS action, concat('{\"actor\":\"', " + _pseudonym("actor", "c_name") + ", '\",\"decision\":\"', CASE c_custkey % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'review' ELSE 'block' END, '\",\"rule_ids\":[\"PG-001\",\"PG-002\"],\"target\":\"', " + _pseudonym("target", "CAST(c_custkey AS VARCHAR)") + ", '\"}') AS payload FROM customer")
def aud04(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("actor"), k.cast("string").alias("target"), pick(k, 3, "allow", "review", "block").alias("decision"), F.array(F.lit("PG-001"), F.lit("PG-002")).alias("rule_ids"))
    return audit.entries(rows, KEY)


@query("aud05_config_changes", "SELECT 'rules.configured' AS action, '2030-01-01T00:00:00Z' AS at, 'ffff' AS digest FROM orders LIMIT 1")
def aud05(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"))
    return audit.config_change(history, "ffff", "2030-01-01T00:00:00Z")


@query("flt04_newest_observations", t.with_tables(more=_JOURNAL, sql="SELECT seq, at FROM (SELECT * FROM journal ORDER BY seq DESC LIMIT 10000) WHERE action = 'ingest'"))
def flt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.newest(_journal(spark, sf_dir), action="ingest").select("seq", "at")


@query("snk04_whole_export", t.with_tables("reads", "assets", sql="SELECT 'reads' AS frame, id FROM reads UNION ALL SELECT 'assets', id FROM assets"))
def snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing.folder(spark)
    sinks.export({"reads": t.file_access(spark, sf_dir), "assets": t.assets(spark, sf_dir)}, path, 2_000_000_000)
    back = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("frame"), "id") for name in ("reads", "assets")]
    return back[0].unionAll(back[1])


@query("snk06_saved_rules", t.with_tables("reads", more=_SWEEP, sql="SELECT window_seconds, threshold AS distinct_file_threshold, 1800 AS login_lookback_seconds FROM (SELECT *, alerts - tp AS fp FROM cells) WHERE tp >= 1 ORDER BY fp, threshold, window_seconds DESC LIMIT 1"))
def snk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import RuleConfig

    path = landing.folder(spark)
    sinks.write_rules(evaluate.recommendation(_sweep(spark, sf_dir), 1), RuleConfig(), path)
    return spark.read.json(path).select(*[F.col(c).cast("long").alias(c) for c in ("window_seconds", "distinct_file_threshold", "login_lookback_seconds")])


@query("join15_current_snapshot", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AND o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def join15(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), "l_linenumber")
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("at")).join(lines.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    return sinks.current(lines, history).withColumnRenamed("snapshot_id", "l_orderkey")


#: The sweep's tables under names that the scores don't use.
_SWEPT = {re.sub("$", "_s", k): re.sub(r"\b(counts|peaks|marks|cells)\b", r"\1_s", v) for k, v in _SWEEP.items()}
_TOTAL = {"total": "SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(alerts - tp) AS BIGINT) AS fp, count(*) FILTER (WHERE expected AND tp = 0) AS missed, count(*) FILTER (WHERE expected) AS expected FROM scored"}


@query("evl06_observations", t.with_tables("reads", "logins", more=_BULK | _EVL | _TOTAL | _SWEPT | {"best": "SELECT * FROM cells_s WHERE tp >= 1 ORDER BY alerts - tp, threshold, window_seconds DESC LIMIT 1"}, sql="SELECT concat(tp, ' true and ', fp, ' false alerts; ', missed, ' of ', expected, ' expected detections missed.') AS sentence FROM total UNION ALL SELECT 'More than half of the alerts are false.' FROM total WHERE tp < fp UNION ALL SELECT concat('Recommended: threshold ', threshold, ', window ', window_seconds, ' s.') FROM best"))
def evl06(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = evaluate.observations(evaluate.totals(_scored(spark, sf_dir)), evaluate.recommendation(_sweep(spark, sf_dir), 1))
    return spark.createDataFrame([(x,) for x in sentences], "sentence string")


@query("snk02_markdown_report", t.with_tables("reads", "logins", more=_BULK | _EVL | _TOTAL | _SWEPT, sql="SELECT concat('| ', rule, ' | ', CAST(sum(alerts) AS BIGINT), ' | ', CAST(sum(tp) AS BIGINT), ' | ', CAST(sum(alerts - tp) AS BIGINT), ' | ', count(*) FILTER (WHERE expected AND tp = 0), ' |') AS line FROM scored GROUP BY rule UNION ALL SELECT concat('| ', window_seconds, ' | ', threshold, ' | ', alerts, ' | ', tp, ' | ', alerts - tp, ' |') FROM cells_s UNION ALL SELECT concat('| missed | ', missed, ' |') FROM total"))
def snk02(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    per_rule = scored.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("alerts", "tp", "fp", "fn")])
    report = sinks.markdown(evaluate.totals(scored), per_rule, _sweep(spark, sf_dir))
    return spark.createDataFrame([(x,) for x in report.splitlines() if re.match(r"\| (AS-|[0-9]|missed)", x)], "line string")


# --- streams, drained


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once its source is drained."""
    spark, path = stream.sparkSession, landing.folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}_state")
    if mode == "append":
        writer.format("parquet").option("path", path).trigger(availableNow=True).start().awaitTermination()
    else:
        writer.foreachBatch(lambda df, _: df.write.mode("append").parquet(path)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _stream(df: DataFrame) -> DataFrame:
    """The rows as a stream of the files that they are landed in."""
    path = landing.folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


_READ_SCHEMA = "id string, at long, actor string, session string, asset_id string, file_id string, sensitive boolean, bytes_read long"


@query("str01_watched_exports", t.with_tables("reads", sql="SELECT id, at, actor, file_id FROM reads"))
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, path = landing.folder(spark), landing.folder(spark)
    t.file_access(spark, sf_dir).write.json(source)
    for _ in range(2):  # unchanged exports add nothing
        streams.watch(spark, source, _READ_SCHEMA, path, f"{path}_state", once_only=True).awaitTermination()
    return streams.ingested(spark, path, _READ_SCHEMA).select("id", "at", "actor", "file_id")


@query("str02_overlapping_polls", t.with_tables("logins", sql="SELECT id, at, actor FROM logins"))
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = t.logins(spark, sf_dir)
    return _drained(streams.once(_stream(logins.unionAll(logins.where("at % 3 = 0"))), "40 days")).select("id", "at", "actor")


@query("str03_ingested_conflicts", t.with_tables("reads", sql="SELECT id FROM reads WHERE CAST(substr(id, 4) AS BIGINT) % 3 = 2"))
def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imports import _stored

    source, path = landing.folder(spark), landing.folder(spark)
    reads = t.file_access(spark, sf_dir)
    streams.ingest(_stored(reads), path)
    reads.write.json(source)
    streams.watch(spark, source, _READ_SCHEMA, path, f"{path}_state", once_only=True).awaitTermination()
    return streams.ingested(spark, path, "id string", conflicts=True)


@query("str04_transfers_on_arrival", t.with_tables("dlp", sql="SELECT 'DLP-001' AS rule, source, actor, event_id AS evidence_ids FROM dlp WHERE tenant <> 'managed' AND data_class IN ('confidential', 'restricted')"))
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    dlp = t.dlp(spark, sf_dir)
    found = streams.sensitive_transfers(_stream(dlp.unionAll(dlp.where("at % 7 = 0"))), "4000 days")
    return joined(_drained(found).select("rule", "source", "actor", "evidence_ids"))


@query("det03_on_arrival", t.with_tables("logins", sql="SELECT actor, gateway_id, at, id AS evidence_ids FROM logins WHERE success AND privileged IS TRUE AND (device_trusted IS FALSE OR approved IS FALSE)"))
def det03_on_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query whose failures are counted by kind; none may have ended it."""
    watcher = streams.Failures()
    spark.streams.addListener(watcher)
    found = _drained(streams.identity(_stream(t.logins(spark, sf_dir)), CONFIG))
    spark.streams.removeListener(watcher)
    if watcher.kinds:
        raise RuntimeError(f"the stream failed: {dict(watcher.kinds)}")
    return joined(found.select("actor", "gateway_id", "at", "evidence_ids"))


_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _with_state(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """run() with the state store that transformWithState needs."""
    old = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(_ROCKS[0], old) if old else spark.conf.unset(_ROCKS[0])


@query("det04_with_state", t.with_tables("reads", more=_BULK, sql="SELECT actor, session, asset_id, n AS distinct_files FROM peaks"))
def det04_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run() -> DataFrame:
        found = streams.bulk_access(_stream(t.file_access(spark, sf_dir)), CONFIG, "40 days")
        return _drained(found, "update").groupBy("actor", "session", "asset_id").agg(F.max("distinct_files").alias("distinct_files"))

    return _with_state(spark, run)


class _TenPolls(threading.Event):
    """A stop that comes after ten polls at the latest."""

    left = 10

    def wait(self, timeout: float | None = None) -> bool:
        self.left -= 1
        if self.left <= 0:
            self.set()
        return super().wait(timeout)


@query("str05_supervised_polling", t.with_tables("reads", sql="SELECT 'ingested' AS what, count(*) AS n FROM reads UNION ALL SELECT 'poll_failed ValueError', 2"))
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that fails twice: both failures are journal rows, and the third poll reads what they left."""
    source, path, stop, turns = landing.folder(spark), landing.folder(spark), _TenPolls(), []
    t.file_access(spark, sf_dir).write.json(source)

    def store(df: DataFrame, to: str) -> None:
        turns.append(1)
        if len(turns) < 3:
            raise ValueError("token=secret must not be kept")
        streams.ingest(df, to)
        stop.set()

    streams.keep_watching(spark, source, _READ_SCHEMA, path, f"{path}_state", f"{path}_journal", 0.01, stop, store)
    failed = spark.read.schema("action string, error_type string").parquet(f"{path}_journal")
    failed = failed.groupBy(F.concat_ws(" ", "action", "error_type").alias("what")).agg(F.count("*").alias("n"))
    return streams.ingested(spark, path, "id string").agg(F.lit("ingested").alias("what"), F.count("*").alias("n")).unionAll(failed)


@query("str06_silent_sources", _STALE)
def str06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What det21 finds in batch, from event-time timers that one tick drives."""
    nation = table(spark, sf_dir, "nation")
    expected = nation.select(F.concat(F.lit("src"), (F.col("n_nationkey") % 8).cast("string")).alias("source"), F.lit(t.NOW).cast("long").alias("at")).distinct()
    tick = nation.limit(1).select(F.lit(t.NOW).cast("long").alias("at"))

    def run() -> DataFrame:
        found = streams.silent_sources(_stream(t.control_events(spark, sf_dir).select("source", "at")), _stream(expected), _stream(tick))
        last = _drained(found, "update").groupBy("source").agg(F.max_by(F.struct("state", "last_seen"), F.struct("at", "state")).alias("x"))
        return last.where("x.state = 'silent'").select("source", "x.last_seen")

    return _with_state(spark, run)
