"""Endpoint rules: YAML texts to plain dictionaries, the built-in ones among them."""

from __future__ import annotations

import warnings
from pathlib import Path

FOLDER = Path(__file__).parent / "builtin"
READ = {
    "": {"name", "description", "version", "enabled", "priority", "type", "scope", "locate", "extract", "build"},
    "scope": {"packageIncludes", "packageExcludes", "fileNamePatterns"},
}
#: Known to the format, without effect on any result.
WITHOUT_EFFECT = {"context", "classAnnotations", "required", "optional", "onSuccess"}


def parse(text: str) -> dict | None:
    """A rule with its defaults, or none if the text is no rule."""
    import yaml

    try:
        rule = yaml.safe_load(text)
    except yaml.YAMLError:
        return None
    if not isinstance(rule, dict) or not rule.get("name") or not isinstance(rule.get("extract"), dict):
        return None
    for part, keys in READ.items():
        for key in (rule.get(part) or {} if part else rule).keys() - keys:
            warnings.warn(f"rule {rule['name']}: {key} has no effect", stacklevel=2)
    return {"version": "1.0", "enabled": True, "priority": 100, "scope": None, "build": None, "locate": {}} | rule


def load_file(path) -> dict | None:
    try:
        return parse(Path(path).read_text(encoding="utf-8"))
    except OSError:
        return None


def arrange(rules: list[dict | None]) -> list[dict]:
    """The first of each name, enabled ones only, by priority from high to low and then by name."""
    first: dict[str, dict] = {}
    for r in rules:
        if r is not None:
            first.setdefault(r["name"], r)
    return sorted((r for r in first.values() if r["enabled"]), key=lambda r: (-r["priority"], r["name"]))


def load(folder=FOLDER) -> list[dict]:
    return arrange([load_file(p) for p in sorted(Path(folder).glob("*.yaml"))])


def all_rules(folder=FOLDER) -> list[dict]:
    """Disabled ones too."""
    return [r for p in sorted(Path(folder).glob("*.yaml")) if (r := load_file(p))]


#: What a rule's type builds when it says nothing itself.
DEFAULT_BUILD = {
    "http-inbound": {"endpointType": "HTTP", "direction": "inbound", "isExternal": False, "httpMethod": "${httpMethod}", "path": "${path}"},
    "http-outbound": {"endpointType": "HTTP", "direction": "outbound", "isExternal": True, "httpMethod": "${httpMethod}", "path": "${path}", "parseLevel": "auto"},
    "kafka-producer": {"endpointType": "MQ", "direction": "outbound", "isExternal": True, "topic": "${topic}", "operation": "PRODUCE"},
    "kafka-consumer": {"endpointType": "MQ", "direction": "inbound", "isExternal": False, "topic": "${topic}", "operation": "CONSUME"},
    "redis-access": {"endpointType": "REDIS", "direction": "outbound", "isExternal": True, "keyPattern": "${keyPattern}"},
    "db-access": {"endpointType": "DB", "direction": "outbound", "isExternal": True, "tableName": "${tableName}"},
}


def build_of(rule: dict) -> dict | None:
    return rule.get("build") or DEFAULT_BUILD.get((rule.get("type") or "").lower())


def traced_arguments(rules: list[dict]) -> tuple[list[str] | None, list[int]]:
    """Method names (None: any) and argument numbers whose values the rules ask for."""
    names: set[str] | None = set()
    numbers: set[int] = set()
    for r in rules:
        at = [int(c["from"][9:-1]) for c in r["extract"].values() if str(c.get("from", "")).startswith("argument[") and c.get("trace") == "auto"]
        if not at:
            continue
        numbers.update(at)
        own = [w["methodName"]["in"] for w in r["locate"].get("where") or [] if (w.get("methodName") or {}).get("in")]
        names = names | set(own[0]) if own and names is not None else None
    return sorted(names) if names is not None else None, sorted(numbers)
