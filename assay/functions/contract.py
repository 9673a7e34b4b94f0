"""The action contract: which objects are valid, and which errors others have."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsontext import kind, names, split_names

# Fixed values of the contract.
DECISIONS = ["execute", "request_approval", "ask_clarification", "refuse", "no_action"]
TOOLS = ["refund_payment", "escalate_fraud_review", "cancel_subscription", "pause_subscription", "offer_retention"]
FIELDS = ["decision", "tool", "arguments", "approval_required", "policy_code", "reason_code"]
TEXT, WHOLE = "text", "whole"  # a text that is not empty; a whole number, 0 at least
ARGUMENTS = {
    "refund_payment": {"payment_id": TEXT, "amount_minor": WHOLE, "currency": ['"USD"']},
    "escalate_fraud_review": {"customer_id": TEXT, "payment_id": TEXT},
    "cancel_subscription": {"subscription_id": TEXT, "effective_mode": ['"immediate"', '"period_end"']},
    "pause_subscription": {"subscription_id": TEXT, "pause_days": ["30", "60", "90"]},
    "offer_retention": {"subscription_id": TEXT, "offer_code": ['"SAVE10_3MO"']},
}
ABSTENTIONS = ["ask_clarification", "refuse", "no_action"]


def opened(v: Column) -> Column:
    """The members of an object by key; null if it is none."""
    return F.try_variant_get(v, "$", "map<string,variant>")


#: A JSON object of exactly the contract's fields, well formed, in their order or sorted, with flat arguments of
#: plain texts, whole numbers, booleans and nulls; one space may follow a comma or colon. What matches is JSON without
#: escapes, and no key twice; an argument holds no quote, backslash, comma, colon or brace but its own quotes.
_TEXT = r'[^"\\\x00-\x1F]*'
_WORD = r'"[\w.\- ]*"'
_MEMBER = rf'(?<key>{_WORD})(?![^}}]*, ?\k<key>:): ?(?:{_WORD}|0|-?[1-9]\d{{0,17}}|true|false|null)(?:, ?(?=")|(?=\}}))'
_PARTS = {
    "decision": rf'"({_TEXT})"', "tool": rf'(null|"{_TEXT}")', "arguments": rf"\{{((?:{_MEMBER}){{0,16}})\}}", "approval_required": "(true|false)", "policy_code": rf'"({_TEXT})"', "reason_code": rf'"({_TEXT})"',
}
_PLACES = {n: i for i, n in enumerate(FIELDS)}


def plain_fields(text: Column, names: list[str] = FIELDS) -> Column:
    """The fields' texts, in the order of FIELDS, of a text that is such an object with its fields in the order
    of `names`; null if it is anything else, which `typed` opens by itself. No such text holds a line's end."""
    pattern = r"\A\{" + ", ?".join(f'"{n}": ?{_PARTS[n]}' for n in names) + r"\}\z"
    group = {n: i + 1 + (i > names.index("arguments")) for i, n in enumerate(names)}  # one more inside the arguments
    short = F.octet_length(text) < 10_000
    return F.when(short & text.startswith(f'{{"{names[0]}"'), _parted(F.regexp_replace(text, pattern, "".join(f"${group[n]}\n" for n in FIELDS))))


def _parted(text: Column) -> Column:
    """The lines of a text whose last is empty; null if it does not end with a line's end (what was split off has no other)."""
    return F.when(text.endswith("\n"), F.split(text, "\n"))


def typed(df: DataFrame, value: str, plain: str, prefix: str) -> DataFrame:
    """Add an object's fields as plain columns: each field's kind and its value as text
    (approval_required as boolean; other values than strings in canonical JSON, nothing for null);
    of the arguments `_keys` and `_pairs`, the keys in quotes and with their canonical values.

    `plain`: the column of `plain_fields`; where it is null the object (`value`: VARIANT, null if there is
    none) is opened once. `{prefix}_other`: its keys, and the arguments by key as texts and as they are.
    """
    known = F.col(plain).isNotNull()
    at = lambda n: F.get(plain, F.lit(_PLACES[n]))
    df = df.withColumn("_members", opened(F.when(~known, F.col(value))))
    member = lambda n: F.element_at("_members", F.lit(n))
    other = lambda n: F.col(f"_{n}_kind")
    df = df.withColumns({"_open": opened(member("arguments")), **{f"_{n}_kind": kind(member(n)) for n in FIELDS if n != "arguments"}})
    text = lambda n: F.when(other(n) == "string", F.try_variant_get(member(n), "$", "string")).when(other(n) != "null", F.to_json(member(n)))
    tool = at("tool")
    given = {"decision": at("decision"), "tool": F.when(tool != "null", F.substring(tool, F.lit(2), F.length(tool) - 2)), "approval_required": at("approval_required") == "true", "policy_code": at("policy_code"), "reason_code": at("reason_code")}
    kinds = {n: F.lit("string") for n in given} | {"tool": F.when(tool == "null", "null").otherwise("string"), "approval_required": F.lit("boolean")}
    df = df.withColumns({
        f"{prefix}_arguments_kind": F.when(known, "object").when(F.col("_open").isNotNull(), "object").otherwise(kind(member("arguments"))),
        **{f"{prefix}_{n}_kind": F.when(known, kinds[n]).otherwise(other(n)) for n in given},
        **{f"{prefix}_{n}": F.when(known, given[n]).otherwise(F.when(other(n) == "boolean", F.try_variant_get(member(n), "$", "boolean")) if n == "approval_required" else text(n)) for n in given},
        "_texts": F.transform_values("_open", lambda _, x: F.to_json(x)), "_keys": F.map_keys("_members"),
    }).drop("_members", *(f"_{n}_kind" for n in given))
    inner = F.replace(F.replace(at("arguments"), F.lit('": '), F.lit('":')), F.lit(', "'), F.lit(',"'))
    none = F.array().cast("array<string>")
    return df.withColumns({
        f"{prefix}_pairs": F.when(known, F.when(inner == "", none).otherwise(F.sort_array(F.split(inner, ",")))).otherwise(pairs(F.col("_texts"))),
        f"{prefix}_keys": F.when(known, F.when(inner == "", none).otherwise(F.split(F.regexp_replace(inner, r':(?:"[^"]*"|[^,"]+)', ""), ","))).otherwise(F.transform(F.map_keys("_texts"), _quoted)),
        f"{prefix}_other": F.struct(F.col("_keys").alias("keys"), F.col("_texts").alias("arguments"), F.col("_open").alias("open")),
    }).drop("_open", "_texts", "_keys")


def _quoted(key: Column) -> Column:
    return F.concat(F.lit('"'), key, F.lit('"'))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def arguments_valid(tool: Column, values: Column, members: Column) -> Column:
    """Whether a tool's arguments (maps of canonical JSON values and of VARIANTs) are exactly its own,
    of the right types and values."""
    text = lambda name: F.element_at(values, F.lit(name)).startswith('"') & (F.element_at(values, F.lit(name)) != '""')
    whole = lambda name: (kind(F.element_at(members, F.lit(name))) == "integer") & (F.element_at(values, F.lit(name)).try_cast("bigint") >= 0)
    one = lambda name, allowed: F.element_at(values, F.lit(name)).isin(*allowed)
    number = lambda name, allowed: (kind(F.element_at(members, F.lit(name))) == "integer") & one(name, allowed)
    test = lambda name, v: text(name) if v == TEXT else whole(name) if v == WHOLE else (one if v[0].startswith('"') else number)(name, v)
    own = F.sort_array(F.map_keys(values))
    fits = lambda t: reduce(lambda a, b: a & b, (test(n, v) for n, v in ARGUMENTS[t].items()), own == F.lit(sorted(ARGUMENTS[t])))
    return _by_tool(tool, fits)


def plain_arguments_valid(tool: Column, inner: Column) -> Column:
    """As `arguments_valid`, of the sorted pairs of a plain object (`plain_fields`), joined by commas."""
    look = lambda v: '"[^"]+"' if v == TEXT else r"\d+" if v == WHOLE else f"(?:{'|'.join(v)})"
    return _by_tool(tool, lambda t: inner.rlike(r"\A" + ",".join(f'"{n}":{look(v)}' for n, v in sorted(ARGUMENTS[t].items())) + r"\z"))


def _by_tool(tool: Column, fits: Callable[[str], Column]) -> Column:
    return reduce(lambda c, t: c.when(tool == t, _yes(fits(t))), TOOLS, F.when(tool.isNull(), F.lit(True))).otherwise(F.lit(False))


def errors(prefix: str, plain: str) -> Column:
    """Error codes of an object (its `typed` columns), in the order of the fields; empty if it is a
    valid contract.

    Shape errors come alone: fields are compared with each other only where each is well formed.
    """
    c = {n: F.col(f"{prefix}_{n}") for n in (*(n for n in FIELDS if n != "arguments"), *(f"{n}_kind" for n in FIELDS))}
    bad = lambda test, code: (code, test)
    there = lambda n: c[f"{n}_kind"].isNotNull()
    other, own = (lambda n: F.col(f"{prefix}_other.{n}")), F.col(f"{prefix}_pairs")
    values = F.concat(F.lit("\n"), F.array_join(F.map_values(other("arguments")), "\n"))  # no JSON text holds a line's end
    scalar = ~(values.contains("\n{") | values.contains("\n["))
    unknown = [
        bad(there("decision") & ~_yes((c["decision_kind"] == "string") & c["decision"].isin(DECISIONS)), "UNSUPPORTED_DECISION"),
        bad(there("tool") & ~_yes((c["tool_kind"] == "null") | ((c["tool_kind"] == "string") & c["tool"].isin(TOOLS))), "UNSUPPORTED_TOOL"),
    ]
    shape = [
        *(bad(~there(n), "MISSING_REQUIRED_KEY") for n in FIELDS),
        *unknown,
        bad(there("arguments") & ~_yes((c["arguments_kind"] == "object") & scalar), "INVALID_ARGUMENT_SHAPE"),
        bad(there("approval_required") & (c["approval_required_kind"] != "boolean"), "INVALID_FIELD_TYPE"),
        *(bad(there(n) & (c[f"{n}_kind"] != "string"), "INVALID_FIELD_TYPE") for n in FIELDS[4:]),
        bad(F.size(F.array_except(other("keys"), F.lit(FIELDS))) > 0, "EXTRA_FIELD"),
    ]
    d, t, flag = c["decision"], c["tool"], c["approval_required"]

    def found(tests: list[tuple[str, Column]], bare: Column, fitting: Column) -> Column:
        fits = F.when(d == "execute", t.isNotNull() & ~flag).when(d == "request_approval", t.isNotNull() & flag).otherwise(t.isNull() & ~flag & bare)
        whole = fits & fitting & (c["policy_code"] != "") & (c["reason_code"] != "")
        return names([*tests, ("CROSS_FIELD_VIOLATION", ~_yes(whole))])

    plainly = found(unknown, F.size(own) == 0, plain_arguments_valid(t, F.array_join(own, ",")))
    codes = F.when(F.col(plain).isNotNull(), plainly).otherwise(found(shape, F.size(other("arguments")) == 0, arguments_valid(t, other("arguments"), other("open"))))
    return split_names(F.replace(codes, F.lit(",CROSS_FIELD_VIOLATION"), F.lit("")))


def pair(key: Column, value: Column) -> Column:
    """An argument as text: its key in quotes with its canonical JSON value; null if it has none."""
    return F.concat(_quoted(key), F.lit(":"), value)


def pairs(arguments: Column) -> Column:
    """Arguments (a map of canonical JSON values) as a set of such texts."""
    return F.transform(F.map_entries(arguments), lambda e: pair(e["key"], e["value"]))
