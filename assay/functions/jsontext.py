"""Strict JSON as Catalyst expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How one whole-output fence looks, for the contract parser and for the generic one.
CONTRACT_FENCE = r"(?s)\A```(?:json)?[ \t]*\r?\n(.*)\r?\n```\z"
GENERIC_FENCE = r"(?si)\A\s*```(?:json)?[ \t]*\r?\n(.*?)\r?\n?```\s*\z"


#: Unicode's white space.
_SPACES = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.when(c.startswith("{") & c.endswith("}"), c).otherwise(F.btrim(c, F.lit(_SPACES)))


def as_list(c: Column) -> Column:
    """A text as the elements of a list, VARIANT; null if it can't be. Nothing is parsed whose first character begins no JSON value."""
    return F.when(c.rlike(r'\A[\s{\["\-0-9tfn]'), F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))))


def strict_value(c: Column, elements: Column | None = None) -> Column:
    """The one JSON value that the whole text is, as VARIANT; null if it is anything else.

    Readers ignore what follows a first value, so the text must also parse as the only element of
    a list and, if it could close that list itself, as the only field of an object. Repeated keys
    and NaN are refused. `elements`: what `as_list` makes of the text, if it is at hand.
    """
    listed = as_list(c) if elements is None else elements
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    first = F.try_variant_get(listed, "$[0]", "variant")
    whole = ~c.contains("]") | F.try_variant_get(wrapped, "$.v", "variant").isNotNull()
    return F.when(first.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull() & (F.trim(c) != "") & whole, first)


#: What VARIANT calls its types, without their parts, and what JSON calls them; all others are numbers.
_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null"}


def kind(v: Column) -> Column:
    """object, array, string, integer, number, boolean, null; SQL null if the value is missing."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    known = F.element_at(F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair)), name)
    return F.coalesce(known, F.when(v.isNotNull(), "number"))


def names(tests: list[tuple[str, Column]]) -> Column:
    """The names, in order and joined by commas, whose tests hold; names have no commas."""
    return F.concat_ws(",", *(F.when(test, F.lit(name)) for name, test in tests))


def split_names(text: Column) -> Column:
    return F.array_remove(F.split(text, ","), "")


def listed(tests: list[tuple[str, Column]]) -> Column:
    """As `names`, as an array."""
    return split_names(names(tests))


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "object", F.lit(False))


def fence_body(c: Column, pattern: str = CONTRACT_FENCE) -> Column:
    """What one fence around the whole text holds, stripped; null if there is no such fence."""
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1)))


def canonical(v: Column) -> Column:
    """Sorted keys, no spaces, non-ASCII kept. Numbers are in the engine's own form: 1.0 is 1."""
    return F.to_json(v)


def canonical_text(c: Column) -> Column:
    return F.to_json(F.try_parse_json(c))


def escaped_key(name: str) -> str:
    """A key as a step of a VARIANT path."""
    return "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def iso_text(moment: Column) -> Column:
    """A timestamp as ISO text in UTC, microseconds only where there are some; null stays null."""
    whole = F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(moment), F.lit(1_000_000))
    return F.concat(whole, F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("+00:00"))
