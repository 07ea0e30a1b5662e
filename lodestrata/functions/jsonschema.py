"""A subset of JSON Schema, compiled to rules by place: type, enum, anyOf, required, additionalProperties, items.

A schema becomes a table from places (``("skills", EACH, "name")``) to the tests that values there
must pass. A document is then walked once, level by level, and every value meets the tests of its place.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

#: Stands for every element of a list in a place.
EACH = object()
#: Names of the types and what they stand for.
KINDS: dict[str, Callable[[object], bool]] = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool), "integer": lambda v: type(v) is int, "number": lambda v: type(v) in (int, float),
}


def _kind(allowed: tuple[str, ...]):
    return lambda v: [] if any(KINDS[k](v) for k in allowed) else [f"expected {' or '.join(allowed)}"]


def _one_of(values: list):
    return lambda v: [] if v in values else [f"{json.dumps(v)} is not allowed"]


def _keys(required: list[str], known: frozenset[str] | None):
    def test(v) -> list[str]:
        if not isinstance(v, dict):
            return []
        return [f"missing {k}" for k in required if k not in v] + [f"unknown {k}" for k in v if known is not None and k not in known]

    return test


def _alternatives(options: list[Schema]):
    return lambda v: [] if any(not o.errors(v) for o in options) else ["matches no alternative"]


class Schema:
    """Tests by place; ``errors`` lists what a parsed value breaks, nearest to the root first."""

    def __init__(self, schema: dict):
        self.tests: dict[tuple, list] = {}
        waiting = deque([((), schema)])
        while waiting:
            place, part = waiting.popleft()
            own = self.tests.setdefault(place, [])
            if "anyOf" in part:
                own.append(_alternatives([Schema(o) for o in part["anyOf"]]))
                continue
            if "type" in part:
                own.append(_kind(tuple([part["type"]] if isinstance(part["type"], str) else part["type"])))
            if "enum" in part:
                own.append(_one_of(part["enum"]))
            parts = part.get("properties", {})
            own.append(_keys(part.get("required", []), None if part.get("additionalProperties", True) else frozenset(parts)))
            waiting.extend(((*place, k), p) for k, p in parts.items())
            if "items" in part:
                waiting.append(((*place, EACH), part["items"]))

    def errors(self, document) -> list[str]:
        found = []
        waiting = deque([((), "$", document)])
        while waiting:
            place, name, value = waiting.popleft()
            broken = next((b for test in self.tests[place] if (b := test(value))), [])
            found += [f"{name}: {b}" for b in broken]
            if any(b.startswith(("expected", "matches")) for b in broken):
                continue
            inner = value.items() if isinstance(value, dict) else ()
            waiting.extend(((*place, k), f"{name}.{k}", v) for k, v in inner if (*place, k) in self.tests)
            if isinstance(value, list) and (*place, EACH) in self.tests:
                waiting.extend(((*place, EACH), f"{name}[{i}]", v) for i, v in enumerate(value))
        return found

    def errors_of_text(self, text: str | None) -> list[str]:
        """The errors of a JSON text; one that can't be parsed, or null, has one."""
        try:
            return self.errors(json.loads(text))
        except (TypeError, ValueError):
            return ["$: invalid JSON"]


def schema_errors(value, schema: dict) -> list[str]:
    """What is wrong with a parsed value; an empty list if it conforms."""
    return Schema(schema).errors(value)


def document_errors(text: str | None, schema: dict) -> list[str]:
    return Schema(schema).errors_of_text(text)
