"""Paths into records: dotted keys, ``[i]``, ``["quoted.key"]``, ``$`` for the root (D3)."""

from __future__ import annotations

import re

_STEP = re.compile(r"""\.?([^.\[\]"]+)|\[(-?\d+)\]|\["((?:[^"\\]|\\.)*)"\]""")


def parse_path(path: str) -> list[str | int]:
    """Keys (str) and array places (int); an empty list is the whole record."""
    text = path.strip()
    if text.startswith("$"):
        text = text[1:]
    steps: list[str | int] = []
    at = 0
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise ValueError(f"not a path: {path!r} at {at}")
        key, place, quoted = m.groups()
        steps.append(int(place) if place is not None else quoted.replace('\\"', '"') if quoted is not None else key)
        at = m.end()
    return steps


def json_path(steps: list[str | int]) -> str:
    """The steps as a JSONPath literal for ``variant_get``."""
    out = "$"
    for s in steps:
        out += f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']"
    return out
