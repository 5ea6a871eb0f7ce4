"""Settings: defaults, then a JSON or YAML file if there is one, then what the caller gives."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """over in base; nested mappings are merged by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def scalar(text: str) -> Any:
    """A YAML scalar: quoted text, null, a boolean, a number, or else text."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    known = {"": None, "null": None, "~": None, "true": True, "false": False}
    if text.lower() in known:
        return known[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_yaml(text: str) -> dict[str, Any]:
    """Mappings nested by indentation, with scalars and lists of scalars: what settings files hold."""
    comment = re.compile(r"""^((?:[^#"']|"[^"]*"|'[^']*')*?)(?:(?:^|\s)#.*)?$""")
    lines = []
    for raw in text.splitlines():
        line = comment.sub(r"\1", raw).rstrip()
        if line.strip():
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, depth: int) -> tuple[Any, int]:
        if lines[at][1].startswith("- "):
            items = []
            while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
                items.append(scalar(lines[at][1][2:]))
                at += 1
            return items, at
        out: dict[str, Any] = {}
        while at < len(lines) and lines[at][0] == depth:
            name, colon, rest = lines[at][1].partition(":")
            if not colon:
                raise ValueError(f"a setting needs a colon: {lines[at][1]!r}")
            at += 1
            if not rest.strip() and at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("- "))):
                out[str(scalar(name))], at = block(at, lines[at][0])
            else:
                out[str(scalar(name))] = scalar(rest)
        return out, at

    if not lines:
        return {}
    own, at = block(0, lines[0][0])
    if at < len(lines) or not isinstance(own, dict):
        raise ValueError("settings are mappings whose lines are indented alike")
    return own


def load_config(defaults: Mapping[str, Any], path: str | None = None, text: str | None = None, **given: Any) -> dict[str, Any]:
    """A file that isn't there leaves the defaults; ``text`` is a file's content that was read elsewhere."""
    if text is None:
        text = Path(path).read_text() if path and Path(path).exists() else ""
    own = json.loads(text) if text.lstrip().startswith("{") else parse_yaml(text)
    return merged(merged(defaults, own), given)


def flat(settings: Mapping[str, Any], prefix: str = "") -> dict[str, str]:
    """Settings by dotted name, as text: JSON unless they are text already."""
    out: dict[str, str] = {}
    for k, v in settings.items():
        if isinstance(v, Mapping):
            out |= flat(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = v if isinstance(v, str) else json.dumps(v)
    return out
