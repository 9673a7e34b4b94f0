"""A subset of JSON Schema, compiled once to one Catalyst expression."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pointer
from .compare import equal
from .jsontext import kind

#: Keywords that say nothing about validity here.
IGNORED = {"$schema", "$id", "title", "description", "$comment"}
KEYWORDS = {"type", "enum", "const", "required", "properties", "additionalProperties", "minimum", "maximum", "minLength", "maxLength", "maxProperties", "minProperties", "items", "minItems", "maxItems", "uniqueItems", "pattern", "allOf", "anyOf", "not", "if", "then", "else"}


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _keys(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def _step(v: Column, key: str) -> Column:
    return pointer.resolve(v, "/" + key.replace("~", "~0").replace("/", "~1"))


def valid(v: Column, schema: Any) -> Column:
    """Whether a present value fits; never null. Unknown keywords raise ValueError when compiled."""
    if schema is True or schema == {}:
        return F.lit(True)
    if schema is False:
        return F.lit(False)
    unknown = schema.keys() - KEYWORDS - IGNORED
    if unknown:
        raise ValueError(f"unsupported JSON Schema keywords {sorted(unknown)}")
    is_kind = lambda *names: F.coalesce(kind(v).isin(*names), F.lit(False))
    unless = lambda guard, test: ~guard | F.coalesce(test, F.lit(False))
    number, text, obj, array = is_kind("integer", "number"), is_kind("string"), is_kind("object"), is_kind("array")
    value, string = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    elements = F.try_variant_get(v, "$", "array<variant>")
    parts: list[Column] = []
    for word, want in schema.items():
        if word == "type":
            names = [want] if isinstance(want, str) else list(want)
            whole = F.coalesce((kind(v) == "number") & (value == F.floor(value)), F.lit(False)) if "integer" in names else F.lit(False)
            parts.append(is_kind(*(names + ["integer"] if "number" in names else names)) | whole)
        elif word in ("enum", "const"):
            options = want if word == "enum" else [want]
            parts.append(reduce(lambda a, b: a | b, [equal(v, F.parse_json(F.lit(json.dumps(x)))) for x in options]))
        elif word == "required":
            parts += [unless(obj, _step(v, k).isNotNull()) for k in want]
        elif word == "properties":
            parts += [~obj | _step(v, k).isNull() | valid(_step(v, k), s) for k, s in want.items()]
        elif word == "additionalProperties":
            if want is False:
                known = F.array(*(F.lit(k) for k in schema.get("properties", {}))).cast("array<string>")
                parts.append(unless(obj, F.size(F.array_except(_keys(v), known)) == 0))
            elif want not in (True, {}):
                raise ValueError("additionalProperties is true or false")
        elif word in ("minimum", "maximum"):
            parts.append(unless(number, value >= F.lit(float(want)) if word == "minimum" else value <= F.lit(float(want))))
        elif word in ("minLength", "maxLength"):
            parts.append(unless(text, F.length(string) >= want if word == "minLength" else F.length(string) <= want))
        elif word in ("minProperties", "maxProperties"):
            parts.append(unless(obj, F.size(_keys(v)) >= want if word == "minProperties" else F.size(_keys(v)) <= want))
        elif word in ("minItems", "maxItems"):
            parts.append(unless(array, F.size(elements) >= want if word == "minItems" else F.size(elements) <= want))
        elif word == "uniqueItems" and want:
            parts.append(unless(array, F.size(F.array_distinct(F.transform(elements, lambda x: F.to_json(x)))) == F.size(elements)))
        elif word == "items":
            parts.append(unless(array, F.forall(elements, lambda x: valid(x, want))))
        elif word == "pattern":
            parts.append(unless(text, string.rlike(want)))
        elif word == "allOf":
            parts += [valid(v, s) for s in want]
        elif word == "anyOf":
            parts.append(reduce(lambda a, b: a | b, [valid(v, s) for s in want]))
        elif word == "not":
            parts.append(~valid(v, want))
        elif word == "if":
            held = valid(v, want)
            parts += [~held | valid(v, schema.get("then", True)), held | valid(v, schema.get("else", True))]
    return _all(parts)
