"""Records of any nesting, as JSON text, to flat columns.

The text is parsed to VARIANT. One aggregation merges what all rows hold into one schema
(``schema_of_variant_agg``, combined map-side), whose objects are walked down to their
leaves; each leaf becomes a column named by its path, joined by ``_``. Names that clash
are told apart as ``name``, ``name_i``, ``name_ii`` (``namei`` where there is a ``_``
already), in the order of the paths. Where a key holds an object in some rows and something
else in others, another aggregation looks into these objects: then the key's own column
has the other values, and the columns below it the objects'.

Types: whole numbers, decimals, floats, booleans and texts as the rows have them; lists of
these as arrays; lists of objects, and values of mixed kinds, as JSON text. Defined results:
a null text, and one that is no JSON object, gives null columns (``bad`` names a column that
keeps such texts); an empty object is like a missing one; a key that is null in all rows
gives a text column of nulls; an empty table gives no columns besides the kept ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

_SIMPLE = re.compile(r"BIGINT|DOUBLE|FLOAT|STRING|BOOLEAN|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+, ?\d+\)")


def next_name(name: str, taken) -> str:
    """name, name_i, name_ii, ...: the first that is not taken."""
    while name in taken:
        name += "i" if "_" in name else "_i"
    return name


def _closing(text: str, at: int) -> int:
    """Place of the > that closes the < before ``at``, past quoted names."""
    depth, quoted = 1, False
    for k in range(at, len(text)):
        if text[k] == "`":
            quoted = not quoted
        elif not quoted:
            depth += (text[k] == "<") - (text[k] == ">")
            if depth == 0:
                return k
    raise ValueError(text)


def fields(schema: str) -> Iterator[tuple[str, str]]:
    """(key, schema) of what OBJECT<key: schema, ...> has."""
    body, at = schema[schema.index("<") + 1 : -1], 0
    while at < len(body):
        if body[at] == "`":
            end = at + 1
            while body[end] != "`" or body[end + 1 : end + 2] == "`":
                end += 2 if body[end] == "`" else 1
            key, at = body[at + 1 : end].replace("``", "`"), end + 1
        else:
            end = body.index(":", at)
            key, at = body[at:end], end
        at += 2  # ": "
        end = at
        while end < len(body) and body[end] != ",":
            end = _closing(body, end + 1) + 1 if body[end] == "<" else body.index(")", end) + 1 if body[end] == "(" else end + 1
        yield key, body[at:end]
        at = end + 2  # ", "


def leaves(schema: str, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path, schema) of all that is no object."""
    if schema.startswith("OBJECT<"):
        for key, inner in fields(schema):
            yield from leaves(inner, (*path, key))
    elif path:
        yield path, schema


def json_path(path: Sequence[str]) -> str:
    out = ["$"]
    for key in path:
        if "'" in key and '"' in key:
            raise ValueError(f"a key with both kinds of quotes can't be addressed: {key}")
        out.append(f'["{key}"]' if "'" in key else f"['{key}']")
    return "".join(out)


def _at(value: str, path: Sequence[str], kind: str = "variant") -> Column:
    return F.try_variant_get(F.col(value), json_path(path), kind)


def merged_leaves(df: DataFrame, value: str) -> list[tuple[tuple[str, ...], str]]:
    """All leaves of the rows' objects in a VARIANT column, by path; one aggregation, and one more for each level of keys of mixed kinds."""
    found: dict[tuple[str, ...], str] = {}
    mixed: list[tuple[str, ...]] = [()]
    while mixed:
        objects = [_object_at(value, p) for p in mixed]
        row = df.agg(*(F.schema_of_variant_agg(o).alias(f"s{k}") for k, o in enumerate(objects))).first()
        below = [(p, s) for p, s in zip(mixed, row) if s is not None and s.startswith("OBJECT<")]
        mixed = []
        for path, schema in below:
            for leaf, kind in leaves(schema, path):
                found[leaf] = kind
                if kind == "VARIANT":
                    mixed.append(leaf)
    return sorted(found.items())


def _object_at(value: str, path: Sequence[str]) -> Column:
    own = _at(value, path) if path else F.col(value)
    return F.when(F.schema_of_variant(own).startswith("OBJECT"), own)


def _typed(value: str, path: Sequence[str], kind: str) -> Column:
    if _SIMPLE.fullmatch(kind):
        return _at(value, path, kind)
    if kind.startswith("ARRAY<") and _SIMPLE.fullmatch(kind[6:-1]):
        return _at(value, path, kind)
    own = _at(value, path)
    text = F.when(F.schema_of_variant(own).isin("STRING", "VOID"), _at(value, path, "string")).otherwise(F.to_json(own))
    return text if kind != "VARIANT" else F.when(~F.schema_of_variant(own).startswith("OBJECT"), text)


def flatten_json(df: DataFrame, column: str, bad: str | None = None) -> DataFrame:
    """df with the text column replaced by a column for each leaf. bad: keep texts that are no JSON object in a column of this name."""
    parsed = df.withColumn("_v", F.try_parse_json(F.col(column)))
    whole = F.schema_of_variant("_v").startswith("OBJECT")
    held = stored(parsed.select("*", F.when(whole, F.col("_v")).alias("_object")).drop("_v"), "variants")
    rest = [c for c in held.columns if c not in (column, "_object")]
    taken, columns = {*rest, *([bad] if bad else [])}, []
    for path, kind in merged_leaves(held, "_object"):
        name = next_name("_".join(path), taken)
        taken.add(name)
        columns.append(_typed("_object", path, kind).alias(name))
    kept = [F.when(F.col("_object").isNull(), F.col(column)).alias(bad)] if bad else []
    return held.select(*(F.col(f"`{c}`") for c in rest), *kept, *columns)
