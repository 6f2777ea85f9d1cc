"""A plain-Python model of detection, resolution and numbering, to hold the Spark expressions against."""

from __future__ import annotations

import re

from veilstone.functions.registry import Registry


def redact(text: str, registry: Registry, consistent: bool = True, seen: dict | None = None) -> tuple[str, list[tuple]]:
    found = []
    for k, d in enumerate(registry.detectors):
        found += [(m.start(), -d.priority, k, m.end(), d.label, m[0]) for m in re.finditer(d.regex, text)]
    kept: list[tuple] = []
    for s in sorted(found):
        if not kept or s[0] >= kept[-1][3]:
            kept.append(s)
        elif s[1] < kept[-1][1]:
            kept[-1] = s
    numbers, given, out, at = {} if seen is None else seen, {}, "", 0
    entities = []
    for start, _, _, end, label, value in kept:
        held = numbers.setdefault(label, {})
        if consistent:
            token = f"[{label}_{held.setdefault(value, len(held) + 1)}]"
        else:
            given[label] = given.get(label, 0) + 1
            token = f"[{label}_{given[label]}]"
        out += text[at:start] + token
        at = end
        entities.append((start, end, label, value, token))
    return out + text[at:], entities
