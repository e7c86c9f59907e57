"""Mapping profiles: which source column gives which typed field, checked strictly and compiled into expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..schemas import KINDS, PATCH_STATES

#: Targets of each record: the kind of value, and whether a row without it is skipped.
TARGETS = {
    "login": {"id": ("id", False), "at": ("time", True), "actor": ("opaque", True), "session": ("opaque", True), "gateway_id": ("id", True), "success": ("bool", True), "privileged": ("bool", False), "device_trusted": ("bool", False), "approved": ("bool", False)},
    "file_access": {"id": ("id", False), "at": ("time", True), "actor": ("opaque", True), "session": ("opaque", True), "asset_id": ("id", True), "file_id": ("opaque", True), "sensitive": ("bool", False), "bytes_read": ("int", False)},
    "asset": {"id": ("id", True), "kind": ("enum", True), "observed_at": ("time", True), "patch_state": ("enum", True), "internet_exposed": ("bool", False), "privileged_path": ("bool", False), "sensitive_path": ("bool", False), "vulnerability_reference": ("id", False), "vulnerability_cvss": ("number", False), "vulnerability_known_exploited": ("bool", False)},
}
PREFIX = {"login": "lg", "file_access": "fa", "asset": "as"}
ENUMS = {"kind": KINDS, "patch_state": PATCH_STATES}
TYPES = {"id": "string", "opaque": "string", "enum": "string", "time": "long", "bool": "boolean", "int": "long", "number": "double"}
ENCODINGS = ["utf-8", "utf-8-sig", "cp932", "shift_jis", "euc_jp", "latin-1"]
_WORD_LISTS = ("true", "false", "true_contains", "false_contains")
_KEYS = {"field", "const", "derive", "map", "default", "time", "timezone", *_WORD_LISTS}


class ProfileError(ValueError):
    """A profile that isn't one."""


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ProfileError(what)


@dataclass(frozen=True)
class Profile:
    name: str
    format: str
    record: str
    map: dict[str, dict] = field(hash=False)
    delimiter: str = ","
    encoding: str = "utf-8"
    skip_rows: int = 0

    @classmethod
    def load(cls, raw: dict) -> Profile:
        """A checked profile; unknown keys are errors, and a missing id derives from a row's content."""
        _require(isinstance(raw, dict), "a profile is an object")
        known = {"profile_version", "name", "description", "format", "record", "map", "delimiter", "encoding", "skip_rows"}
        _require(not set(raw) - known and {"profile_version", "name", "format", "record", "map"} <= set(raw), "missing or unknown profile keys")
        _require(raw["profile_version"] == 1 and not isinstance(raw["profile_version"], bool), "profile_version is 1")
        _require(isinstance(raw["name"], str) and bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9 _.:/-]{0,79}", raw["name"])), "bad name")
        _require(raw["format"] in ("csv", "jsonl") and raw["record"] in TARGETS, "bad format or record")
        delimiter, encoding, skip = raw.get("delimiter", ","), raw.get("encoding", "utf-8"), raw.get("skip_rows", 0)
        _require(isinstance(delimiter, str) and len(delimiter) == 1 and delimiter not in "\r\n", "delimiter is one character")
        _require(encoding in ENCODINGS, "unsupported encoding")
        _require(isinstance(skip, int) and not isinstance(skip, bool) and 0 <= skip <= 100, "skip_rows is 0 to 100")
        targets = TARGETS[raw["record"]]
        _require(isinstance(raw["map"], dict) and not set(raw["map"]) - set(targets), "unknown target")
        _require(all(t in raw["map"] for t, (_, needed) in targets.items() if needed), "a required target isn't mapped")
        spec = {t: cls._spec(t, targets[t][0], x) for t, x in raw["map"].items()}
        spec.setdefault("id", {"derive": "content"})
        return cls(raw["name"], raw["format"], raw["record"], spec, delimiter, encoding, skip)

    @staticmethod
    def _spec(target: str, kind: str, raw: dict) -> dict:
        _require(isinstance(raw, dict) and bool(raw) and not set(raw) - _KEYS, f"{target}: unknown keys")
        _require(sum(k in raw for k in ("field", "const", "derive")) == 1, f"{target}: one of field, const and derive")
        _require("derive" not in raw or (target == "id" and raw["derive"] == "content"), f"{target}: only an id derives, from content")
        for k in _WORD_LISTS:
            _require(k not in raw or (kind == "bool" and isinstance(raw[k], list) and 0 < len(raw[k]) <= 64 and all(isinstance(w, str) and 0 < len(w) <= 200 for w in raw[k])), f"{target}: bad {k}")
        if "map" in raw:
            _require(isinstance(raw["map"], dict) and 0 < len(raw["map"]) <= 64 and all(isinstance(x, str) for kv in raw["map"].items() for x in kv), f"{target}: bad map")
            _require(kind != "enum" or set(raw["map"].values()) <= set(ENUMS[target]), f"{target}: map to listed values")
        _require(kind == "time" or not {"time", "timezone"} & set(raw), f"{target} isn't a time")
        form = raw.get("time", "iso8601")
        _require(form in ("iso8601", "epoch_seconds", "epoch_millis") or "%" in form, f"{target}: bad time form")
        _require(kind != "enum" or bool({"map", "const", "default"} & set(raw)), f"{target}: map, const or default")
        return dict(raw)

    @property
    def targets(self) -> dict[str, tuple[str, bool]]:
        return TARGETS[self.record]

    def raw_value(self, target: str, lookup) -> Column:
        """The source text of a target; `lookup` turns a field name into a column."""
        x = self.map.get(target, {})
        if "const" in x:
            return F.lit(None if x["const"] is None else str(x["const"]).lower() if isinstance(x["const"], bool) else str(x["const"]))
        return lookup(x["field"]) if "field" in x else F.lit(None).cast("string")

    def value(self, target: str, text: Column) -> Column:
        """The typed value of a target from its trimmed source text; null where it is unknown."""
        kind, x = self.targets[target][0], self.map.get(target, {})
        if kind == "time":
            out = s.epoch(text, x.get("time", "iso8601"), x.get("timezone"), trimmed=True)
        elif kind == "bool":
            out = s.tri_state(text, *[x.get(k) for k in _WORD_LISTS], trimmed=True)
        elif kind == "int":
            out = s.bounded_long(text, 0, 10**12, trimmed=True)
        elif kind == "number":
            out = s.bounded_double(text, 0, 10, trimmed=True)
        else:
            out = s.mapped(text, x["map"], trimmed=True) if "map" in x else text
            out = s.slug(out, trimmed="map" not in x) if kind == "id" else out
        if x.get("default") is not None:
            out = F.coalesce(out, F.lit(x["default"]))
        return out.cast(TYPES[kind])


#: The profiles that come with the engine.
BUILT_IN = {
    "generic-asset-csv": {
        "profile_version": 1, "name": "generic-asset-csv", "format": "csv", "record": "asset",
        "map": {
            "id": {"field": "asset_id"},
            "kind": {"field": "type", "map": {"vpn": "vpn", "firewall": "vpn", "server": "server", "fileserver": "server", "saas": "saas", "endpoint": "endpoint", "pc": "endpoint"}, "default": "unknown"},
            "observed_at": {"field": "observed_at", "time": "iso8601", "timezone": "+09:00"},
            "patch_state": {"field": "patch", "map": {"pending": "pending", "未適用": "pending", "applied": "applied", "適用済": "applied", "n/a": "not_applicable", "対象外": "not_applicable"}, "default": "unknown"},
            "internet_exposed": {"field": "exposed", "true": ["yes", "true", "1", "公開"], "false": ["no", "false", "0", "非公開"]},
            "privileged_path": {"field": "admin_path", "true": ["yes", "true", "1", "あり"], "false": ["no", "false", "0", "なし"]},
            "sensitive_path": {"field": "sensitive_path", "true": ["yes", "true", "1", "あり"], "false": ["no", "false", "0", "なし"]},
            "vulnerability_reference": {"field": "advisory"},
            "vulnerability_cvss": {"field": "cvss"},
            "vulnerability_known_exploited": {"field": "kev", "true": ["yes", "true", "1"], "false": ["no", "false", "0"]},
        },
    },
    "generic-auth-csv": {
        "profile_version": 1, "name": "generic-auth-csv", "format": "csv", "record": "login",
        "map": {
            "id": {"field": "event_id"},
            "at": {"field": "timestamp", "time": "iso8601", "timezone": "+09:00"},
            "actor": {"field": "user"},
            "session": {"field": "session_id"},
            "gateway_id": {"field": "gateway"},
            "success": {"field": "result", "true": ["success", "accept", "成功"], "false": ["failure", "reject", "denied", "失敗"]},
            "privileged": {"field": "account_type", "true": ["admin", "root", "maintenance", "保守"], "false": ["user", "standard", "一般"]},
            "device_trusted": {"field": "device_state", "true": ["managed", "compliant", "管理端末"], "false": ["unmanaged", "noncompliant", "非管理端末"]},
            "approved": {"field": "change_ticket", "true_contains": ["CHG-", "WORK-"], "false": ["none", "なし", "-"]},
        },
    },
    "generic-file-access-jsonl": {
        "profile_version": 1, "name": "generic-file-access-jsonl", "format": "jsonl", "record": "file_access",
        "map": {
            "at": {"field": "ts", "time": "epoch_millis"},
            "actor": {"field": "user.id"},
            "session": {"field": "session"},
            "asset_id": {"field": "host"},
            "file_id": {"field": "path"},
            "sensitive": {"field": "label", "true": ["confidential", "restricted", "機密"], "false": ["public", "internal", "公開"]},
            "bytes_read": {"field": "bytes"},
        },
    },
    "okta-system-log-jsonl": {
        "profile_version": 1, "name": "okta-system-log-jsonl", "format": "jsonl", "record": "login",
        "map": {
            "id": {"field": "uuid"},
            "at": {"field": "published", "time": "iso8601"},
            "actor": {"field": "actor.alternateId"},
            "session": {"field": "authenticationContext.externalSessionId"},
            "gateway_id": {"const": "okta-idp"},
            "success": {"field": "outcome.result", "true": ["SUCCESS"], "false": ["FAILURE"]},
        },
    },
    "windows-security-logon-csv": {
        "profile_version": 1, "name": "windows-security-logon-csv", "format": "csv", "record": "login", "encoding": "utf-8-sig",
        "map": {
            "at": {"field": "TimeCreated", "time": "%Y-%m-%d %H:%M:%S", "timezone": "+09:00"},
            "actor": {"field": "TargetUserName"},
            "session": {"field": "TargetLogonId"},
            "gateway_id": {"field": "WorkstationName"},
            "success": {"field": "EventID", "true": ["4624"], "false": ["4625"]},
        },
    },
}


def built_in(name: str) -> Profile:
    return Profile.load(BUILT_IN[name])
