"""JSON values as VARIANT: types, guarded comparisons, canonical text and paths."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import Part

NUMBER = "decimal(38,18)"


def type_name(v: Column) -> Column:
    """null, boolean, number, string, array or object; SQL NULL where there is no value."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string")).when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number")
    )


def canonical(v: Column) -> Column:
    """Text that is equal for equal values: what grouping and comparison use."""
    return F.to_json(v)


def canonical_map(m: Column) -> Column:
    """A map of values as one JSON object, keys in order."""
    keys = F.array_sort(F.map_keys(m))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(m, k))))


def number(v: Column) -> Column:
    """The value if it is a number, else NULL (strings are not read as numbers)."""
    return F.when(type_name(v) == "number", F.try_variant_get(v, "$", "double"))


def text(v: Column) -> Column:
    """A scalar as text without quotes; containers as JSON; JSON null as NULL."""
    return F.when(type_name(v) == "string", F.try_variant_get(v, "$", "string")).when(type_name(v) != "null", canonical(v))


def equals(v: Column, literal) -> Column:
    """Typed equality with a literal; numbers compare as numbers, containers by canonical text.  False, not NULL, for another type."""
    if isinstance(literal, bool):
        return (type_name(v) == "boolean") & F.coalesce(F.try_variant_get(v, "$", "boolean") == literal, F.lit(False))
    if isinstance(literal, (int, float)):
        return (type_name(v) == "number") & F.coalesce(F.try_variant_get(v, "$", "double") == float(literal), F.lit(False))
    if isinstance(literal, str):
        return (type_name(v) == "string") & F.coalesce(F.try_variant_get(v, "$", "string") == literal, F.lit(False))
    return canonical(v) == canonical_literal(literal)


def contains(v: Column, literal) -> Column:
    """Containment: an object holds each of the literal's keys with a value that contains the literal's, an array some element for each of the literal's; scalars are equal."""
    if isinstance(literal, dict):
        inside = [contains(F.try_variant_get(v, json_path([Part("name", k)]), "variant"), x) for k, x in literal.items()]
        return reduce(lambda a, b: a & b, inside, F.coalesce(type_name(v) == "object", F.lit(False)))
    if isinstance(literal, list):
        elements = F.when(type_name(v) == "array", F.try_variant_get(v, "$", "array<variant>"))
        some = lambda item: F.coalesce(F.exists(elements, lambda x: contains(x, item)), F.lit(False))
        inside = [some(item) for item in literal]
        return reduce(lambda a, b: a & b, inside, F.coalesce(type_name(v) == "array", F.lit(False)))
    if literal is None:
        return F.coalesce(type_name(v) == "null", F.lit(False))
    return F.coalesce(equals(v, literal), F.lit(False))


def depth(v: Column) -> Column:
    """Levels of containers in a value: 0 for a scalar."""
    brackets = F.regexp_replace(F.regexp_replace(canonical(v), r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda a, c: F.transform(F.array(a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)), lambda n: F.struct(n.alias("now"), F.greatest(a["most"], n).alias("most")))[0]
    return F.when(v.isNotNull(), F.aggregate(F.split(brackets, ""), start, step, lambda a: a["most"]))


def canonical_literal(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_path(parts: list[Part]) -> str:
    """A variant path of names and places."""
    out = "$"
    for p in parts:
        name = p.name.replace("\\", "\\\\").replace("'", "\\'")
        out += f"['{name}']" + (f"[{p.index}]" if p.index is not None else "")
    return out


def at_path(doc: Column, parts: list[Part], top_is_map: bool) -> Column:
    """The value at a path of a document, NULL where absent; the document is a map of values or one value."""
    if not parts:
        return doc
    if top_is_map:
        top = F.try_element_at(doc, F.lit(parts[0].name))
        rest = ([Part("name", "", parts[0].index)] if parts[0].index is not None else []) + parts[1:]
        path = "$" + (f"[{parts[0].index}]" if parts[0].index is not None else "") + json_path(parts[1:])[1:]
        return F.try_variant_get(top, path, "variant") if rest else top
    return F.try_variant_get(doc, json_path(parts), "variant")
