"""Run settings: flat files of ``key: value`` with typed overrides, and ``KEY=value`` files."""

from __future__ import annotations

import json
import os


def typed(text: str) -> object:
    """A scalar or a list as its Python value; other text stays text."""
    text = text.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("", "null", "~"):
        return None
    for kind in (int, float, json.loads):
        try:
            return kind(text)
        except ValueError:
            continue
    if text.startswith("[") and text.endswith("]"):
        return [typed(x) for x in text[1:-1].split(",") if x.strip()]
    return text.strip("\"'")


def read_settings(lines: list[str], overrides: list[str] = ()) -> dict[str, object]:
    """Settings of a flat file; an override ``key=value`` must name one of them."""
    found: dict[str, object] = {}
    for line in lines:
        body = line.split(" #", 1)[0].rstrip()
        if body and not body.startswith("#"):
            key, _, value = body.partition(":")
            found[key.strip()] = typed(value)
    for item in overrides:
        key, _, value = item.partition("=")
        if key not in found:
            raise KeyError(key)
        found[key] = typed(value)
    return found


def write_settings(settings: dict[str, object]) -> str:
    return "".join(f"{k}: {json.dumps(v) if isinstance(v, (list, bool)) or v is None else v}\n" for k, v in settings.items())


def read_environment(lines: list[str]) -> dict[str, str]:
    """``KEY=value`` lines; blank lines and comments are skipped; what is set already stays."""
    found = {}
    for line in lines:
        if line.strip() and not line.lstrip().startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            found[key.strip()] = os.environ.get(key.strip(), value.strip())
    return found
