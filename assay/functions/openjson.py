"""Fields removed from JSON of any shape, at any depth.

A document is opened level by level into rows, one for each value with its path; rows under a removed
field go; and texts are put together again from the deepest level up, members by key and elements
by place. All of it is joins and aggregations by document and path, in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, save
from .jsontext import kind

_NODE = "array<struct<key:string,at:int>>"


def _quoted(key: Column) -> Column:
    """A text as a JSON string."""
    text = F.to_json(F.struct(key.alias("k")))
    return F.substring(text, F.lit(6), F.length(text) - 6)


def without_fields(df: DataFrame, key: str, json: str, names: list[str]) -> DataFrame:
    """key, json: the canonical text (sorted keys, no spaces) of each document without the fields of some
    names, inside arrays too. An object or array that is left without parts stays, empty. A text that
    is no JSON, or null, gives null. Keys are unique, or rows of a key have nothing to tell them apart
    and raise; numbers are written in the engine's form.
    """
    docs = df.select(F.col(key).alias("_id"), F.try_parse_json(json).alias("_v"))
    level = save(docs.select("_id", F.array().cast(_NODE).alias("path"), "_v"), "level")
    levels = []
    while True:
        k = kind(F.col("_v"))
        nodes = level.select("_id", "path", k.alias("kind"), F.when(~k.isin("object", "array"), F.to_json("_v")).alias("text"))
        levels.append(save(nodes, "nodes"))
        step = lambda name, at: F.concat("path", F.array(F.struct(name.alias("key"), at.alias("at"))))
        members = level.where(k == "object").select("_id", "path", F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("_k", "_c"))
        members = members.where(~F.col("_k").isin(names)).select("_id", step(F.col("_k"), F.lit(None).cast("int")).alias("path"), F.col("_c").alias("_v"))
        elements = level.where(k == "array").select("_id", "path", F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("_i", "_c"))
        elements = elements.select("_id", step(F.lit(None).cast("string"), F.col("_i")).alias("path"), F.col("_c").alias("_v"))
        below = save(members.unionByName(elements), "level")
        release(level)
        level = below
        if level.isEmpty():
            break
    # From the deepest level up: each parent gets its parts' texts, sorted.
    texts = levels[-1].select("_id", "path", _closed(F.col("kind"), F.col("text"), F.array().cast("array<struct<key:string,at:int,text:string>>")).alias("text"))
    for nodes in reversed(levels[:-1]):
        last = F.element_at("path", -1)
        parts = texts.groupBy("_id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.array_sort(F.collect_list(F.struct(last["key"].alias("key"), last["at"].alias("at"), F.col("text").alias("text")))).alias("_parts"))
        own = nodes.alias("n").join(parts.alias("p"), F.col("n._id").eqNullSafe(F.col("p._id")) & (F.col("n.path") == F.col("p.path")), "left")
        texts = own.select(F.col("n._id").alias("_id"), F.col("n.path").alias("path"), _closed(F.col("kind"), F.col("n.text"), F.coalesce("_parts", F.array())).alias("text"))
    return texts.select(F.col("_id").alias(key), F.col("text").alias("json"))


def _closed(kind_: Column, text: Column, parts: Column) -> Column:
    members = F.transform(parts, lambda p: F.concat(_quoted(p["key"]), F.lit(":"), p["text"]))
    elements = F.transform(parts, lambda p: p["text"])
    return F.when(kind_ == "object", F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).when(kind_ == "array", F.concat(F.lit("["), F.array_join(elements, ","), F.lit("]"))).otherwise(text)


def content_digests(df: DataFrame, key: str, json: str, names: list[str]) -> DataFrame:
    """key, sha256: the digest of each document's canonical text without the fields of some names."""
    return without_fields(df, key, json, names).select(key, F.sha2("json", 256).alias("sha256"))


def differing(left: DataFrame, right: DataFrame, key: str, json: str, volatile: list[str]) -> DataFrame:
    """key, presence of documents that differ in more than volatile fields, or that one side lacks."""
    a, b = (content_digests(d, key, json, volatile).select(F.col(key).alias(f"_k{i}"), F.col("sha256").alias(f"_h{i}")) for i, d in enumerate((left, right)))
    there = reduce(lambda x, y: x & y, [F.col(f"_k{i}").isNotNull() for i in (0, 1)])
    return a.join(b, F.col("_k0") == F.col("_k1"), "full").where(~there | ~F.col("_h0").eqNullSafe(F.col("_h1"))).select(
        F.coalesce("_k0", "_k1").alias(key), F.when(there, "both").when(F.col("_k0").isNotNull(), "left").otherwise("right").alias("presence")
    )
