"""JSON Pointers, resolved at planning time to VARIANT paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsontext import escaped_key


def steps(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError(f"not a JSON Pointer: {pointer!r}")
    return [s.replace("~1", "/").replace("~0", "~") for s in pointer[1:].split("/")]


def resolve(document: Column, pointer: str) -> Column:
    """The value at `pointer`, or SQL null where it is missing. A JSON null is not SQL null. A step
    of digits is an index into a list, or else a key; a negative one is missing."""
    value = document
    for step in steps(pointer):
        by_key = F.try_variant_get(value, "$" + escaped_key(step), "variant")
        value = F.coalesce(F.try_variant_get(value, f"$[{step}]", "variant"), by_key) if step.isdigit() and (step == "0" or step[0] != "0") else by_key
    return value


def exists(document: Column, pointer: str) -> Column:
    return resolve(document, pointer).isNotNull()


def in_documents(documents: dict[str, Column], pointer: str) -> Column:
    """As `resolve`, the first step naming one of several documents; an unknown one is missing."""
    first, *rest = steps(pointer)
    if first not in documents:
        return F.parse_json(F.lit(None).cast("string"))
    return resolve(documents[first], "".join("/" + s.replace("~", "~0").replace("/", "~1") for s in rest))
