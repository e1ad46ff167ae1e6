"""Values held against JSON schemas.

All assertion keywords of draft 2020-12 but ``unevaluatedItems``, ``unevaluatedProperties``
and references beyond the schema itself, and of earlier drafts ``definitions``, ``dependencies``,
``additionalItems`` and lists as ``items``. ``format`` and other annotations assert nothing.
Anything else is reported as a keyword that isn't known: a value is only valid if the whole
schema could be applied.

Numbers are compared as decimals with the digits they are written with in their shortest form,
so 0.3 is a multiple of 0.1. ``$ref`` may be recursive as long as the value gets smaller.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import Decimal
from urllib.parse import unquote

import regex

#: A schema's pattern may take so long for a value.
PATTERN_SECONDS = 1.0

# Keywords that assert something, and those that don't.
ASSERTIONS = frozenset(
    "$ref $defs definitions type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern minItems maxItems uniqueItems items prefixItems additionalItems"
    " contains minContains maxContains properties patternProperties additionalProperties propertyNames required minProperties maxProperties dependentRequired dependentSchemas dependencies"
    " allOf anyOf oneOf not if then else".split()
)
ANNOTATIONS = frozenset("$schema $id $anchor $comment $vocabulary title description default examples example deprecated readOnly writeOnly format contentEncoding contentMediaType contentSchema nullable strict".split())


def canonical(value) -> str:
    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                return None
            return int(v) if v == int(v) and abs(v) < 1 << 53 else v
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return valid_text(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def valid_text(text: str) -> str:
    """The text with halves of surrogate pairs escaped, as UTF-8 can't hold them."""
    return text.encode("utf-8", "backslashreplace").decode()


def loads(text: str):
    """JSON without NaN and infinities, which are no JSON: they raise ValueError."""

    def refuse(name: str):
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: _number(v) and v == int(v), "number": _number, "null": lambda v: v is None,
}
_BOUNDS = {
    "minimum": lambda a, b: a >= b, "maximum": lambda a, b: a <= b, "exclusiveMinimum": lambda a, b: a > b, "exclusiveMaximum": lambda a, b: a < b, "multipleOf": lambda a, b: b != 0 and a % b == 0,
}


def violations(value, schema, path: str = "$", root=None) -> list[str]:
    """Where a value departs from a JSON schema, and keywords of the schema that aren't known."""
    return [*_found(value, schema, path, schema if root is None else root, frozenset())]


def _ok(value, schema, root, open_refs) -> bool:
    return next(_found(value, schema, "$", root, open_refs), None) is None


def _pointed(ref: str, root):
    if not ref.startswith("#"):
        raise LookupError(ref)
    node = root
    for part in filter(None, ref[1:].split("/")):
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        node = node[int(part)] if isinstance(node, list) else node[part]
    return node


def _matches(pattern: str, text: str) -> bool:
    return regex.search(pattern, text, timeout=PATTERN_SECONDS) is not None


def _found(value, schema, path: str, root, open_refs: frozenset) -> Iterator[str]:
    if schema is True or schema is None:
        return
    if schema is False:
        yield f"{path}: nothing is allowed"
        return
    if not isinstance(schema, dict):
        yield f"{path}: the schema is neither an object nor a boolean"
        return
    for k in schema:
        if k not in ASSERTIONS and k not in ANNOTATIONS and not k.startswith("x-"):
            yield f"{path}: keyword {k} is not known"
    if "$ref" in schema:
        ref = str(schema["$ref"])
        try:
            target = _pointed(ref, root)
        except (LookupError, ValueError, TypeError):
            yield f"{path}: {ref} leads nowhere"
            return
        if (ref, id(value)) in open_refs:
            yield f"{path}: {ref} leads to itself"
            return
        yield from _found(value, target, path, root, open_refs | {(ref, id(value))})
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(k in _TYPES and _TYPES[k](value) for k in kinds) and not (value is None and schema.get("nullable") is True):
        yield f"{path}: not of type {'/'.join(kinds)}"
        return
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        yield f"{path}: not in enum"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        yield f"{path}: not the constant"
    if _number(value):
        own = Decimal(repr(value))
        for k, test in _BOUNDS.items():
            if _number(schema.get(k)) and not test(own, Decimal(repr(schema[k]))):
                yield f"{path}: {k}"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            yield f"{path}: length"
        if "pattern" in schema and not _matches(schema["pattern"], value):
            yield f"{path}: pattern"
    if isinstance(value, list):
        yield from _of_list(value, schema, path, root, open_refs)
    if isinstance(value, dict):
        yield from _of_object(value, schema, path, root, open_refs)
    for k in schema.get("allOf", []):
        yield from _found(value, k, path, root, open_refs)
    if "anyOf" in schema and not any(_ok(value, k, root, open_refs) for k in schema["anyOf"]):
        yield f"{path}: anyOf"
    if "oneOf" in schema and sum(_ok(value, k, root, open_refs) for k in schema["oneOf"]) != 1:
        yield f"{path}: oneOf"
    if "not" in schema and _ok(value, schema["not"], root, open_refs):
        yield f"{path}: not"
    if "if" in schema:
        yield from _found(value, schema.get("then" if _ok(value, schema["if"], root, open_refs) else "else"), path, root, open_refs)


def _of_list(value: list, schema: dict, path: str, root, open_refs: frozenset) -> Iterator[str]:
    if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", math.inf):
        yield f"{path}: number of items"
    if schema.get("uniqueItems") and len({canonical(v) for v in value}) < len(value):
        yield f"{path}: items repeat"
    first, rest = schema.get("prefixItems", []), schema.get("items")
    if isinstance(rest, list):  # as earlier drafts have it
        first, rest = rest, schema.get("additionalItems")
    for k, v in enumerate(value):
        yield from _found(v, first[k] if k < len(first) else rest, f"{path}[{k}]", root, open_refs)
    if "contains" in schema:
        n = sum(_ok(v, schema["contains"], root, open_refs) for v in value)
        if n < schema.get("minContains", 1) or n > schema.get("maxContains", math.inf):
            yield f"{path}: contains"


def _of_object(value: dict, schema: dict, path: str, root, open_refs: frozenset) -> Iterator[str]:
    known, patterns = schema.get("properties") or {}, schema.get("patternProperties") or {}
    if len(value) < schema.get("minProperties", 0) or len(value) > schema.get("maxProperties", math.inf):
        yield f"{path}: number of properties"
    for k in schema.get("required", []):
        if k not in value:
            yield f"{path}.{k}: missing"
    for k, v in value.items():
        own = [known[k]] if k in known else []
        own += [s for p, s in patterns.items() if _matches(p, k)]
        for s in own or [schema.get("additionalProperties")]:
            yield from _found(v, s, f"{path}.{k}", root, open_refs)
        if "propertyNames" in schema and not _ok(k, schema["propertyNames"], root, open_refs):
            yield f"{path}.{k}: name"
    needs = {**schema.get("dependencies", {}), **schema.get("dependentRequired", {})}
    for k, more in needs.items():
        if k in value and isinstance(more, list):
            for name in more:
                if name not in value:
                    yield f"{path}.{name}: missing with {k}"
    for k, more in {**schema.get("dependencies", {}), **schema.get("dependentSchemas", {})}.items():
        if k in value and not isinstance(more, list):
            yield from _found(value, more, path, root, open_refs)
