"""Benchmark decontamination by templates.

A question asked again with other numbers, names or units shares no long run of words with the
original, but it shares its template. Texts are made canonical: numbers, names and units become
typed placeholders, the rest lower-case words without punctuation. Windows of eight canonical
tokens are hash-joined between documents and benchmark items. Within one alignment of a
document with an item, the values in the slots must be consistent: one value of the item always
stands for one value of the document. Windows of inconsistent alignments don't count.

Everything is DataFrame functions. The documents' windows meet the benchmark's in one join on
their hash; only documents with a hit are read again for the values of their slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, table
from .quality import WINDOW, with_window_hashes

# Units that a number can have, and numbers in words.
UNITS = "kg|kilograms?|grams?|g|mg|lbs?|pounds?|ounces?|oz|tons?|tonnes?|km|kilomet(?:er|re)s?|met(?:er|re)s?|m|cm|mm|miles?|feet|foot|ft|inch(?:es)?|yards?|lit(?:er|re)s?|ml|gallons?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|usd|euros?|eur|cents?|percent|degrees?|mph|kmh|kw|watts?|volts?"
NUMBER_WORDS = "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion"
#: Placeholders: control characters that texts lose first.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
_SLOTS = f"[{NAME}{NUMBER}{UNIT}]"
_NAME = r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}+"
_NUMBER = rf"\d+(?:[.,:/]\d+)*|(?i:\b(?:{NUMBER_WORDS})\b)"
_UNIT = rf"(?i)(?<={NUMBER}|{NUMBER} )(?:(?:{UNITS})\b|[%€$°])"
#: Ends of values that are kept behind their placeholder: of a number, and of others.
_NUMBER_END, _END = "\x05", "\x04"
#: Words that are no placeholder in each window: one with fewer matches only with its values as they are.
LITERALS = 5
#: Consecutive windows' worth of evidence: an item with as many, or all it has, is in a document.
ENOUGH = 5
#: Items of at least so many tokens, and fewer than a window's, are found inside longer documents, with
#: their values as they are; still shorter ones only as a document of just those tokens.
SHORTEST = 3
#: Windows of the benchmark that are broadcast: 24 bytes each, under 16 MB. Beyond it Spark shuffles.
BROADCAST_WINDOWS = 500_000
#: Documents that are read again whose ids are broadcast: 30 bytes each, under 16 MB, so that texts are not
#: shuffled to meet them. Beyond it Spark shuffles.
BROADCAST_DOCS = 500_000


def _steps(text: Column) -> tuple[Column, Column, Column]:
    """The text with names replaced, then numbers too, then units too."""
    named = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _SLOTS, " "), _NAME, NAME)
    numbered = F.regexp_replace(named, _NUMBER, NUMBER)
    return named, numbered, F.regexp_replace(numbered, _UNIT, UNIT)


def _tokens(replaced: Column) -> Column:
    """Words without punctuation, and placeholders, in order."""
    spaced = F.regexp_replace(F.regexp_replace(replaced, f"({_SLOTS})", " $1 "), rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{NUMBER}{UNIT}]+", " ")
    return F.filter(F.split(F.lower(spaced), " "), lambda w: w != "")


def canonical(text: Column) -> Column:
    """The canonical tokens of a text; none for null."""
    return _tokens(_steps(text)[2])


def valued(text: Column) -> Column:
    """The canonical tokens of a text with each placeholder's value, in lower case, behind it."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{NUMBER}{UNIT}{_END}{_NUMBER_END}]", " ")
    named = F.regexp_replace(clean, _NAME, f"{NAME}$0{_END}")
    numbered = F.regexp_replace(named, rf"(?<!{NAME})(?:{_NUMBER})", f"{NUMBER}$0{_NUMBER_END}")
    marked = F.regexp_replace(numbered, _UNIT.replace(NUMBER, _NUMBER_END), f"{UNIT}$0{_END}")
    ends = f"{_END}{_NUMBER_END}"
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"{_SLOTS}[^{ends}]*|[\p{{L}}\p{{M}}\p{{N}}]+"), F.lit(0))


def windows(df: DataFrame, key: str, text: str = "text", tokens=canonical) -> DataFrame:
    """Hashes of the windows of each row: key, pos (from 0), window. A text of fewer than eight
    tokens, but some, is one window of all it has, which only a text of just those tokens matches."""
    t = df.select(F.col(key).alias(key), tokens(F.col(text)).alias("_t"))
    t = with_window_hashes(t, "_t", "_w")
    short = F.array(F.xxhash64("_t", F.size("_t")))
    return t.select(key, F.posexplode(F.when(F.size("_t") >= WINDOW, F.col("_w")).when(F.size("_t") > 0, short).otherwise(F.array().cast("array<bigint>"))).alias("pos", "window"))


def _slots(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, _t (tokens) and _v: for each token what it stood for, or null where it is a word."""
    named, numbered, unit = _steps(F.col(text))
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _SLOTS, " ")
    found = {NAME: F.regexp_extract_all(clean, F.lit(_NAME), F.lit(0)), NUMBER: F.regexp_extract_all(named, F.lit(_NUMBER), F.lit(0)), UNIT: F.regexp_extract_all(numbered, F.lit(_UNIT), F.lit(0))}
    t = df.select(key, _tokens(unit).alias("_t"), *(F.transform(v, lambda x: F.lower(x)).alias(f"_k{i}") for i, v in enumerate(found.values())))
    # The k-th placeholder of a kind is the k-th value that was found of it.
    def places_of(kind: str) -> Column:
        return F.filter(F.transform("_t", lambda w, i: F.when(w == kind, i)), lambda i: i.isNotNull())

    places = [places_of(c) for c in found]
    t = t.select(key, "_t", *(F.map_from_arrays(F.slice(p, F.lit(1), F.least(F.size(p), F.size(f"_k{i}"))), F.slice(f"_k{i}", F.lit(1), F.least(F.size(p), F.size(f"_k{i}")))).alias(f"_m{i}") for i, p in enumerate(places)))
    return t.select(key, "_t", F.map_concat("_m0", "_m1", "_m2").alias("_v"))


def _again(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is among the distinct ids (_id; other columns are added), and their texts."""
    ids = save(ids, "read-again")
    small = F.broadcast(ids) if ids.count() <= BROADCAST_DOCS else ids
    return docs.join(small, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")


def _short_items(docs: DataFrame, items: DataFrame, like: DataFrame) -> DataFrame:
    """Hits (columns of `like`) of items shorter than a window, at any place of a document.

    Where an item's first SHORTEST canonical tokens stand, and only there, the document's tokens with
    their values are compared, by a hash for each length that some item has. So each word costs one
    join row whatever the number of lengths, and nothing at all where no item is short.
    """
    size = F.size("_t")
    shorts = items.select("item_id", canonical(F.col("text")).alias("_t"), valued(F.col("text")).alias("_v")).where((size >= SHORTEST) & (size < WINDOW))
    shorts = save(shorts.select("item_id", size.alias("_n"), F.xxhash64(F.slice("_t", 1, SHORTEST)).alias("_first"), F.xxhash64("_v").alias("_own")), "short-items")
    found = shorts.agg(F.count(F.lit(1)).alias("n"), F.collect_set("_n").alias("lengths")).first()
    if not found["n"]:
        return like.limit(0)
    broadcast = F.broadcast if found["n"] <= BROADCAST_WINDOWS else lambda df: df
    starts = F.transform(F.sequence(F.lit(0), size - SHORTEST), lambda i: F.xxhash64(F.slice("_t", i + 1, F.lit(SHORTEST))))
    places = docs.select("doc_id", canonical(F.col("text")).alias("_t")).where(size >= SHORTEST).select("doc_id", F.posexplode(starts).alias("pos", "_first"))
    places = places.join(broadcast(shorts.select("_first").distinct()), "_first", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("pos").alias("_at"))
    within = _again(docs, places).select("doc_id", valued(F.col("text")).alias("_v"), F.explode("_at").alias("pos"))
    within = within.withColumn("_n", F.explode(F.array(*map(F.lit, sorted(found["lengths"]))))).where(F.col("pos") + F.col("_n") <= F.size("_v"))
    within = within.select("doc_id", "pos", "_n", F.xxhash64(F.slice("_v", F.col("pos") + 1, F.col("_n"))).alias("_own"))
    return within.join(broadcast(shorts.select("item_id", "_n", "_own")), ["_n", "_own"]).select("doc_id", "pos", "item_id", F.lit(0).alias("item_pos")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Pairs (doc_id, item_id) of a document and a benchmark item that it holds, with n_windows (the
    item's windows found), item_windows, and reparameterised (some slot has another value).

    An item is held if `enough` of its windows, all it has, or all that match by their template, are
    found in consistent alignments.
    Every row is judged by its own text: where documents or items share an id, or have none, a pair
    of ids is found if any of their texts are, with the figures of the texts with most windows found.
    Repeated rows count once. Null and empty texts hold nothing; very long ones are read whole; an empty
    table on either side gives no pairs. Other columns are not read.

    Windows with fewer than LITERALS words that are no placeholder are found where their slots have the
    same values: the values are looked at only in documents with such a template. An item of fewer than
    eight tokens, but SHORTEST at least, is found anywhere with its values as they are; a document of
    just its tokens holds it with other values too. A still shorter one is found only in such a document.
    """
    own = lambda c: F.struct(F.col(c).alias("id"), F.xxhash64("text").alias("h")).alias(c)
    docs = docs.select(own("doc_id"), "text")
    items = save(benchmark.where(F.col("text").isNotNull()).select(own("item_id"), "text").distinct(), "items")
    tokens = items.select("item_id", canonical(F.col("text")).alias("_t"))
    telling = F.size(F.filter(F.slice("_t", F.col("pos") + 1, F.lit(WINDOW)), lambda w: ~w.rlike(_SLOTS))) >= F.least(F.lit(LITERALS), F.size("_t"))
    asked = save(
        windows(items, "item_id").alias("w").join(tokens.alias("t"), F.col("w.item_id").eqNullSafe(F.col("t.item_id")))
        .select(F.col("w.item_id").alias("item_id"), F.col("pos").alias("item_pos"), "window", telling.alias("telling")),
        "benchmark-windows",
    )
    few = asked.count() <= BROADCAST_WINDOWS
    broadcast = F.broadcast if few else lambda df: df
    # One row for each hash, so that a document's window meets one row however often items repeat.
    # A document with a template that does not tell enough gets one row without item and places.
    by_hash = asked.groupBy("window").agg(F.collect_list(F.when(F.col("telling"), F.struct("item_id", "item_pos"))).alias("_items"), F.bool_or(~F.col("telling")).alias("_weak"))
    places = F.transform("_items", lambda i: F.struct(F.col("pos").alias("pos"), i["item_id"].alias("item_id"), i["item_pos"].alias("item_pos")))
    mark = F.array(F.lit(None).cast(f"struct<pos:int,item_id:{items.schema['item_id'].dataType.simpleString()},item_pos:int>"))
    met = windows(docs, "doc_id").join(broadcast(by_hash), "window").select("doc_id", F.explode(F.when(F.col("_weak"), F.concat(places, mark)).otherwise(places)).alias("_i"))
    met = save(met.select("doc_id", "_i.pos", "_i.item_id", "_i.item_pos").distinct(), "met")
    weak_docs = met.where("item_pos is null").select(F.col("doc_id").alias("_id")).distinct()
    weak = asked.where(~F.col("telling")).select(F.col("item_id").alias("_item"), F.col("item_pos").alias("_item_pos"))
    as_they_are = (
        windows(items, "item_id", tokens=valued).join(weak, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("pos") == F.col("_item_pos")), "left_semi")
        .groupBy("window").agg(F.collect_list(F.struct("item_id", F.col("pos").alias("item_pos"))).alias("_items"))
    )
    exact = (
        windows(_again(docs, weak_docs), "doc_id", tokens=valued).join(broadcast(as_they_are), "window")
        .select("doc_id", "pos", F.explode("_items").alias("_i")).select("doc_id", "pos", "_i.item_id", "_i.item_pos").distinct()
    )
    hits = save(met.where("item_pos is not null").unionByName(exact).unionByName(_short_items(docs, items, met)), "hits")

    # Slot values, where the matched windows have slots at all.
    with_slots = asked.join(tokens, asked["item_id"].eqNullSafe(tokens["item_id"])).where(F.exists(F.slice("_t", F.col("item_pos") + 1, F.lit(WINDOW)), lambda w: w.rlike(_SLOTS))).select(asked["item_id"].alias("_item"), F.col("item_pos").alias("_item_pos")).distinct()
    slotted = save(hits.join(broadcast(with_slots), hits["item_id"].eqNullSafe(F.col("_item")) & (F.col("item_pos") == F.col("_item_pos"))).select("doc_id", "pos", "item_id", "item_pos"), "slotted")
    ids = slotted.select(F.col("doc_id").alias("_id")).distinct()
    doc_values = _slots(_again(docs, ids).select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("_d"), F.col("_t").alias("_dt"), F.col("_v").alias("_dv"))
    item_values = _slots(items, "item_id").select(F.col("item_id").alias("_i"), F.col("_t").alias("_it"), F.col("_v").alias("_iv"))
    place = F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1)))
    pairs = (
        slotted.join(item_values, F.col("item_id").eqNullSafe(F.col("_i")))
        .withColumn("_o", place).where(F.get("_it", F.col("item_pos") + F.col("_o")).rlike(_SLOTS))
        .select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("_shift"), (F.col("item_pos") + F.col("_o")).alias("_at"), F.get("_it", F.col("item_pos") + F.col("_o")).alias("_kind"), F.element_at("_iv", F.col("item_pos") + F.col("_o")).alias("_was"))
        .distinct()
        .join(doc_values, F.col("doc_id").eqNullSafe(F.col("_d")))
        .where(F.get("_dt", F.col("_at") + F.col("_shift")) == F.col("_kind"))
        .select("doc_id", "item_id", "_shift", "_kind", "_was", F.element_at("_dv", F.col("_at") + F.col("_shift")).alias("_is"))
    )
    checked = (
        pairs.groupBy("doc_id", "item_id", "_shift", "_kind", "_was").agg(F.count_distinct("_is").alias("_n"), F.max(F.col("_was") != F.col("_is")).alias("_other"))
        .groupBy("doc_id", "item_id", "_shift").agg((F.max("_n") <= 1).alias("_consistent"), F.max("_other").alias("_other"))
        .select(F.col("doc_id").alias("_d"), F.col("item_id").alias("_i"), F.col("_shift").alias("_s"), "_consistent", "_other")
    )
    same = hits["doc_id"].eqNullSafe(F.col("_d")) & hits["item_id"].eqNullSafe(F.col("_i")) & ((hits["pos"] - hits["item_pos"]) == F.col("_s"))
    tells = broadcast(asked.where("telling").select(F.col("item_id").alias("_ti"), F.col("item_pos").alias("_tp"), "telling"))
    found = (
        hits.join(checked, same, "left").where(F.coalesce("_consistent", F.lit(True)))
        .join(tells, F.col("item_id").eqNullSafe(F.col("_ti")) & (F.col("item_pos") == F.col("_tp")), "left")
        .groupBy("doc_id", "item_id").agg(F.count_distinct("item_pos").alias("n_windows"), F.count_distinct(F.when(F.col("telling"), F.col("item_pos"))).alias("_told"), F.coalesce(F.max("_other"), F.lit(False)).alias("reparameterised"))
    )
    sizes = asked.groupBy("item_id").agg(F.count_distinct("item_pos").alias("item_windows"), F.count_distinct(F.when(F.col("telling"), F.col("item_pos"))).alias("_tell")).select(F.col("item_id").alias("_i"), "item_windows", "_tell")
    return (
        found.join(sizes, F.col("item_id").eqNullSafe(F.col("_i")))
        .where((F.col("n_windows") >= F.least(F.lit(enough), F.col("item_windows"))) | ((F.col("_tell") > 0) & (F.col("_told") == F.col("_tell"))))
        .groupBy(F.col("doc_id.id").alias("doc_id"), F.col("item_id.id").alias("item_id"))
        .agg(F.max(F.struct("n_windows", "item_windows", "reparameterised")).alias("_m")).select("doc_id", "item_id", "_m.*")
    )


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Pairs of all `documents` and benchmark items that they hold: see `leaks` for nulls, empty and very
    long texts, ties and repeated rows."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
