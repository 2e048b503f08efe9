"""Configuration of an inspection: rules, severities, options, suppressions. Small, and kept on the driver."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

#: The rules in their order, with default severity and options (name: default, least, most).
RULES: dict[str, tuple[str, dict[str, tuple[float, float, float]]]] = {
    "fonts/allowed": ("off", {}),
    "layout/outside-slide": ("warning", {"tolerancePt": (2, 0, 10000), "minOutsideRatio": (0.05, 0, 1)}),
    "layout/text-occluded": ("off", {"minOccludedRatio": (0.2, 0, 1)}),
    "layout/text-overlap": ("warning", {"minOverlapRatio": (0.2, 0, 1)}),
    "package/broken-relationship": ("error", {}),
    "package/malformed-xml": ("error", {}),
    "package/missing-media": ("error", {}),
    "text/autofit-enabled": ("warning", {}),
    "text/autofit-scale-below-minimum": ("error", {"defaultPt": (12, 1, 4000), "titlePt": (20, 1, 4000)}),
    "text/min-font-size": ("error", {"defaultPt": (12, 1, 4000), "titlePt": (20, 1, 4000)}),
}
SELECTORS = ("file", "slide", "slideId", "shapeIds", "part")
SEVERITIES = ("off", "warning", "error")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    rules: dict[str, tuple[str, dict[str, Any]]]
    fail_on: str = "error"
    ignore: tuple[dict[str, Any], ...] = field(default=())
    #: Severities that the digest names for rules that are off.
    resting: dict[str, str] = field(default_factory=dict)

    def enabled(self) -> dict[str, tuple[str, dict[str, Any]]]:
        return {k: v for k, v in self.rules.items() if v[0] != "off"}


def _options(rule: str, given: Any) -> dict[str, Any]:
    if not isinstance(given, dict):
        raise ConfigError(f"{rule}: options must be an object")
    if rule == "fonts/allowed":
        extra = set(given) - {"families", "unresolved"}
        families, unresolved = given.get("families"), given.get("unresolved", "ignore")
        if extra or not isinstance(families, list) or not families or not all(isinstance(f, str) and f.strip() for f in families):
            raise ConfigError(f"{rule}: families must be a list of names")
        if len({f.strip().lower() for f in families}) != len(families) or unresolved not in ("ignore", "warning", "error"):
            raise ConfigError(f"{rule}: families must differ, and unresolved be ignore, warning or error")
        return {"families": [f.strip() for f in families], "unresolved": unresolved}
    known = RULES[rule][1]
    if set(given) - set(known):
        raise ConfigError(f"{rule}: unknown option {sorted(set(given) - set(known))[0]}")
    out = {}
    for name, (default, least, most) in known.items():
        value = given.get(name, default)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not least <= value <= most:
            raise ConfigError(f"{rule}: {name} must be a number from {least} to {most}")
        out[name] = value
    return out


def _suppression(given: Any) -> dict[str, Any]:
    if not isinstance(given, dict) or set(given) - {"rule", "reason", *SELECTORS}:
        raise ConfigError("a suppression has an unknown key")
    if given.get("rule") not in RULES or not set(given) & set(SELECTORS):
        raise ConfigError("a suppression needs a known rule and a selector")
    out = dict(given)
    if "shapeIds" in out:
        ids = out["shapeIds"]
        if not isinstance(ids, list) or not ids or not all(isinstance(i, int) and i >= 0 for i in ids) or len(set(ids)) != len(ids):
            raise ConfigError("shapeIds must be different ids")
        out["shapeIds"] = sorted(ids)
    return out


def resolve(given: dict[str, Any] | None = None, fail_on: str | None = None) -> Config:
    """The configuration that a file's content stands for; None is the recommended one. fail_on beats the file's."""
    given = {"extends": ["recommended"]} if given is None else given
    if set(given) - {"extends", "failOn", "rules", "ignore", "$schema"}:
        raise ConfigError("unknown key in the configuration")
    if given.get("extends", []) not in ([], ["recommended"]):
        raise ConfigError("extends can only be recommended")
    level = fail_on or given.get("failOn", "error")
    if level not in ("error", "warning"):
        raise ConfigError("failOn must be error or warning")
    recommended = given.get("extends") == ["recommended"]
    start = {"fonts/allowed": {"families": [], "unresolved": "ignore"}}
    rules = {r: (s if recommended else "off", start.get(r) or {k: v[0] for k, v in o.items()}) for r, (s, o) in RULES.items()}
    resting = {r: "error" if s == "off" else s for r, (s, _) in RULES.items()}
    for rule, value in given.get("rules", {}).items():
        severity, options = (value, {}) if isinstance(value, str) else value if isinstance(value, list) and len(value) == 2 else (None, None)
        if rule not in RULES or severity not in SEVERITIES:
            raise ConfigError(f"unknown rule or severity: {rule}")
        plain_off = severity == "off" and isinstance(value, str)
        rules[rule] = (severity, rules[rule][1] if plain_off else _options(rule, options))
        resting[rule] = "error"
    return Config(rules, level, tuple(_suppression(s) for s in given.get("ignore", [])), resting)


def digest(config: Config) -> str:
    """SHA-256 of the configuration's canonical JSON."""
    rules = [{"ruleId": k, "enabled": s != "off", "severity": config.resting[k] if s == "off" else s, "options": dict(sorted(o.items()))} for k, (s, o) in sorted(config.rules.items())]
    body = {"schemaVersion": 1, "failOn": config.fail_on, "rules": rules, "ignore": [dict(sorted(i.items())) for i in config.ignore]}
    return hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
