"""Settings: nested defaults under what a file or a caller gives."""

from __future__ import annotations

import json
from typing import Any


def merged(defaults: dict[str, Any], given: dict[str, Any] | None) -> dict[str, Any]:
    """The defaults with what is given, level by level; a value that is no dictionary replaces the default whole."""
    out = dict(defaults)
    for key, value in (given or {}).items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else value
    return out


def loaded(path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """Defaults under a JSON file, or a YAML one where the optional yaml is installed; a file that isn't there changes nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        return merged(defaults, None)
    if path.endswith((".yaml", ".yml")):
        import yaml

        return merged(defaults, yaml.safe_load(text))
    return merged(defaults, json.loads(text))
