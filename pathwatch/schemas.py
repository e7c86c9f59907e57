"""Typed frames. Times are whole epoch seconds; a null means unknown."""

from __future__ import annotations

ASSETS = "id string, kind string, patch_state string, observed_at long, internet_exposed boolean, privileged_path boolean, sensitive_path boolean, vulnerability struct<reference:string,cvss:double,known_exploited:boolean>"
LOGINS = "id string, at long, actor string, session string, gateway_id string, success boolean, privileged boolean, device_trusted boolean, approved boolean"
FILE_ACCESS = "id string, at long, actor string, session string, asset_id string, file_id string, sensitive boolean, bytes_read long"
PROVENANCE = "label string, sha256 string, rows_read long, rows_imported long, connector string, verified boolean"
CONTROL_EVENTS = "id string, organization string, source string, at long, kind string, actor string, result string, session string, asset string, target string, channel string, target_type string, data_class string, bytes long, privileged boolean, mfa boolean, device_trusted boolean"
BASELINES = "organization string, actor string, until long, samples array<long>"
DLP = "event_id string, source string, at long, actor string, operation string, tenant string, data_class string, bytes long, outcome string"
INVENTORY = "id string, vendor string, product string, version string, internet_exposed boolean, privileged_path boolean, sensitive_path boolean"
ADVISORIES = "vendor string, product string, cve string, introduced string, fixed string, source string"
CONTROLS = "asset_id string, observed_at long, mfa_required boolean, admin_public boolean, supported boolean"
MANIFEST = "id string, sha256 string, permissions array<string>, publisher string"
REQUESTS = "event_id string, action string, destination string, text string, data_class string, tool string"
GRANTS = "action string, destination string, data_classes array<string>, tool string"
AUDIT = "seq long, at string, action string, payload string, prev string, mac string"

KINDS = ["vpn", "server", "saas", "endpoint", "unknown"]
PATCH_STATES = ["pending", "applied", "unknown", "not_applicable"]
DATA_CLASSES = ["public", "internal", "confidential", "restricted", "unknown"]
EVENT_KINDS = ["vpn_login", "idp_login", "file_read", "egress", "privilege_change", "collector_heartbeat"]
CHANNELS, TARGET_TYPES = ["vpn", "idp", "filesystem", "ai", "cloud", "usb", "unknown"], ["organization", "personal", "unknown"]
RESULTS = ["success", "failure", "blocked", "unknown"]
OPERATIONS, TENANTS, OUTCOMES = ["upload", "usb", "sync", "download"], ["managed", "personal", "unknown"], ["blocked", "allowed", "unknown"]
PERMISSIONS = ["read", "write", "network", "execute", "delete", "share"]
