"""The tunables of the detection rules, their bounds, and the digest that every finding carries."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields

#: Lower and upper bound of each tunable.
BOUNDS = {
    "window_seconds": (10, 86_400),
    "distinct_file_threshold": (2, 1_000_000),
    "login_lookback_seconds": (0, 604_800),
    "sensitive_file_minimum": (0, 1_000_000),
    "stale_asset_hours": (1, 8_760),
    "cvss_priority_threshold": (0, 10),
}
RULE_VERSION = "2026-09-12.2"


@dataclass(frozen=True)
class RuleConfig:
    window_seconds: int = 300
    distinct_file_threshold: int = 100
    login_lookback_seconds: int = 1800
    sensitive_file_minimum: int = 1
    stale_asset_hours: int = 24
    cvss_priority_threshold: float = 7.0
    identity_conditions: str = "any"

    @property
    def digest(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(body.encode()).hexdigest()[:16]

    @classmethod
    def load(cls, raw: dict) -> RuleConfig:
        """Checked, never clamped: unknown keys, wrong types and values out of bounds raise ValueError."""
        unknown = set(raw) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown rule settings: {sorted(unknown)}")
        for name, (low, high) in BOUNDS.items():
            if name in raw:
                value = raw[name]
                kinds = (int, float) if name == "cvss_priority_threshold" else (int,)
                if isinstance(value, bool) or not isinstance(value, kinds) or not low <= value <= high:
                    raise ValueError(f"{name} must be {low} to {high}")
        if raw.get("identity_conditions", "any") not in ("any", "both"):
            raise ValueError("identity_conditions must be any or both")
        raw = dict(raw)
        if "cvss_priority_threshold" in raw:
            raw["cvss_priority_threshold"] = float(raw["cvss_priority_threshold"])
        config = cls(**raw)
        if config.sensitive_file_minimum > config.distinct_file_threshold:
            raise ValueError("sensitive_file_minimum exceeds distinct_file_threshold")
        return config
