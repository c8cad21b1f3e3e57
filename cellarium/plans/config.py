"""Settings: word lists and bounds from a YAML file, over the fixed values of the contract."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from typing import Any

from ..functions.constants import ANCHORS, IGNORED_SHEETS, RATE_ANCHORS, TARGET_SHEETS

NAMES = ("config.yaml", "config.yml")


@dataclass(frozen=True)
class Config:
    anchors: dict[str, tuple[str, ...]] = field(default_factory=lambda: {**ANCHORS, "labour_rate": RATE_ANCHORS})
    ignored_sheets: tuple[str, ...] = IGNORED_SHEETS
    target_sheets: tuple[str, ...] = TARGET_SHEETS
    least_cycle: float = 5.0
    most_cycle: float = 300.0
    tables: bool = True


def find(path: str | None) -> str | None:
    """The path given, else a settings file of the working folder; null: defaults."""
    if path:
        return path if os.path.isfile(path) else None
    return next((n for n in NAMES if os.path.isfile(n)), None)


def load(path: str | None = None) -> Config:
    """Settings of the file; a missing or unreadable file, or one of another shape, gives the defaults."""
    found = find(path)
    if not found:
        return Config()
    try:
        import yaml
    except ImportError:
        return Config()
    try:
        with open(found, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
    except (OSError, UnicodeDecodeError, yaml.YAMLError):
        return Config()
    return parse(raw)


def _words(x: Any) -> tuple[str, ...] | None:
    return tuple(str(w).strip().lower() for w in x if str(w).strip()) if isinstance(x, list) else None


def parse(raw: Any) -> Config:
    """Settings of a mapping, under ``extraction`` or at its top; what it lacks stays as it is."""
    if not isinstance(raw, dict):
        return Config()
    body = raw.get("extraction") if isinstance(raw.get("extraction"), dict) else raw
    out = Config()
    given = body.get("anchors") if isinstance(body.get("anchors"), dict) else {}
    given = given | ({"quote": body["quote_id"]} if isinstance(body.get("quote_id"), dict) else {})
    anchors = dict(out.anchors)
    for name, value in given.items():
        words = _words(value.get("keywords", value.get("anchors")) if isinstance(value, dict) else value)
        if words:
            anchors[name] = words
    out = replace(out, anchors=anchors)
    part = lambda d, k: d.get(k) if isinstance(d.get(k), dict) else {}
    for name, key in (("ignored_sheets", "ignore"), ("target_sheets", "target_keywords")):
        words = _words(part(body, "sheets").get(key))
        if words:
            out = replace(out, **{name: words})
    cycle = part(part(body, "bounds"), "cycle_time_sec")
    for name, key in (("least_cycle", "min"), ("most_cycle", "max")):
        if isinstance(cycle.get(key), (int, float)):
            out = replace(out, **{name: float(cycle[key])})
    return replace(out, tables=bool(part(body, "grid_matrix").get("enabled", True)))
