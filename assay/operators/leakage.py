"""Collisions of keys across corpora, duplicates, and joins that check completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import passages


def long_keys(df: DataFrame, corpus: str, id_: str, classes: dict[str, Column]) -> DataFrame:
    """corpus, record_id, key_class, key: one row for each key of each record. A class is a column of one
    key or of an array of keys; null keys have none."""
    kinds = [f.dataType for f in df.select(*classes.values()).schema]

    def cells(name: str, key: Column, kind) -> Column:
        keys = key if isinstance(kind, ArrayType) else F.array(key.cast("string"))
        return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda x: F.struct(F.lit(name).alias("key_class"), x.alias("key")))

    every = F.flatten(F.array(*(cells(c, k, t) for (c, k), t in zip(classes.items(), kinds))))
    return df.select(F.lit(corpus).alias("corpus"), F.col(id_).cast("string").alias("record_id"), F.inline(every)).where(F.col("key").isNotNull())


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def window_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of all windows of `n` words of an array, none where there are fewer. Built from hashes of
    halves, so a window costs a few additions whatever its length, and no text is put together."""
    size, h = F.size(words), F.transform(words, lambda w: F.xxhash64(w))
    have, done, rest = {1: h}, 1, n
    while done * 2 <= n:
        a = have[done]
        have[done * 2] = F.zip_with(a, F.slice(a, F.lit(done + 1), F.greatest(size, F.lit(1))), lambda x, y: F.xxhash64(x, y))
        done *= 2
    out, at = None, 0
    for part in sorted(have, reverse=True):
        if rest >= part:
            piece = have[part] if not at else F.slice(have[part], F.lit(at + 1), F.greatest(size, F.lit(1)))
            out = piece if out is None else F.zip_with(out, piece, lambda x, y: F.xxhash64(x, y))
            at, rest = at + part, rest - part
    return F.slice(out, F.lit(1), F.greatest(size - (n - 1), F.lit(0)))


def hashed_keys(texts: DataFrame, words: Column, passage: int) -> DataFrame:
    """corpus, record_id, key_class, key (64 bits) of `texts` (corpus, record_id, text): the text itself
    (content), its words alone (signature), and each distinct passage of so many words.

    Sixteen bytes for a key, so shuffles of all passages of a corpus stay a fraction of it. Two of n
    different keys are the same with a chance of about n * n / 2^65; where that counts, `digested`
    holds the texts themselves together.
    """
    rows = texts.where("text is not null").select("corpus", F.col("record_id").cast("string").alias("record_id"), "text", words.alias("_words"))
    passages = F.when(F.size("_words") >= passage, F.array_distinct(window_hashes(F.col("_words"), passage))).otherwise(F.array().cast("array<bigint>"))
    named = lambda name, keys: F.transform(keys, lambda k: F.struct(F.lit(name).alias("key_class"), k.alias("key")))
    every = F.concat(named("content", F.array(F.xxhash64("text"))), named("signature", F.array(F.xxhash64(F.array_join("_words", " ")))), named("passage", passages))
    return rows.select("corpus", "record_id", F.inline(every))


def shared(keys: DataFrame) -> DataFrame:
    """The rows of keys that more than one corpus has."""
    several = keys.groupBy("key_class", "key").agg(F.min("corpus").alias("_a"), F.max("corpus").alias("_b")).where("_a <> _b").select("key_class", "key")
    return keys.join(several, ["key_class", "key"], "left_semi")


def digested(texts: DataFrame, words: Column, passage: int, keys: DataFrame) -> DataFrame:
    """corpus, record_id, key_class, key (SHA-256) of the hashed `keys` of some texts: only texts that have one
    are read again, and only those passages are put together."""
    wanted = keys.select("corpus", "record_id").distinct()
    rows = texts.where("text is not null").withColumn("record_id", F.col("record_id").cast("string")).join(wanted, ["corpus", "record_id"]).select("corpus", "record_id", "text", words.alias("_words"))
    whole = F.array(F.struct(F.lit("content").alias("key_class"), F.xxhash64("text").alias("_h"), F.col("text").alias("_t")), F.struct(F.lit("signature").alias("key_class"), F.xxhash64(F.array_join("_words", " ")).alias("_h"), F.array_join("_words", " ").alias("_t")))
    parts = rows.select("corpus", "record_id", "_words", F.posexplode(F.when(F.size("_words") >= passage, window_hashes(F.col("_words"), passage)).otherwise(F.array().cast("array<bigint>"))).alias("_i", "_h")).withColumn("key_class", F.lit("passage"))
    mine = keys.select("corpus", "record_id", "key_class", F.col("key").alias("_h"))
    on = ["corpus", "record_id", "key_class", "_h"]
    of_parts = parts.join(mine, on, "left_semi").select("corpus", "record_id", "key_class", F.sha2(F.array_join(F.slice("_words", F.col("_i") + 1, F.lit(passage)), " "), 256).alias("key")).distinct()
    of_whole = rows.select("corpus", "record_id", F.inline(whole)).join(mine, on, "left_semi").select("corpus", "record_id", "key_class", F.sha2("_t", 256).alias("key"))
    return of_whole.unionByName(of_parts)


def collisions(keys: DataFrame, on: tuple[str, ...] = ("key_class", "key"), carried: tuple[str, ...] = ()) -> DataFrame:
    """Keys (the columns `on`) that several corpora have: each record of a later corpus (by name) with the
    owner's, and what else its row carries.

    The first corpus owns a key, and of its records the last by id. Owners come from partial
    aggregation, so a key that very many records have costs no sort.
    """
    first = keys.groupBy(*on).agg(F.min("corpus").alias("_own"), F.max("corpus").alias("_last")).where("_own <> _last")
    of_owner = keys.join(first, list(on))
    owner = of_owner.where("corpus = _own").groupBy(*on).agg(F.max("record_id").alias("owner_id"))
    later = of_owner.where("corpus <> _own").select(*on, F.col("_own").alias("owner_corpus"), "corpus", "record_id", *carried)
    return later.join(owner, list(on))


def passage_collisions(texts: DataFrame, words: Column, passage: int) -> DataFrame:
    """`collisions` of all passages of so many words (without spaces) of `texts` (corpus, record_id, text):
    key (SHA-256), owner_corpus, owner_id, corpus, record_id."""
    return passages.collisions(passages.packed(texts, passage, words), passage)


def whole_keys(packs: DataFrame) -> DataFrame:
    """corpus, record_id, key_class, key (SHA-256) of packed texts as they are (content) and of their words alone (signature)."""
    named = F.array(*(F.struct(F.lit(c).alias("key_class"), F.lower(F.hex(c)).alias("key")) for c in ("content", "signature")))
    return packs.select("corpus", F.inline("whole")).select("corpus", "record_id", F.inline(named))


def text_collisions(texts: DataFrame, passage: int) -> DataFrame:
    """`collisions` of `texts` (corpus, record_id, text) as they are (content), of their words alone (signature) and of
    all passages of so many words (passage); words are those of a-z and 0-9 of the lower-case text."""
    packs, columns = passages.packed(texts, passage), ["key_class", "key", "owner_corpus", "owner_id", "corpus", "record_id"]
    of_passages = passages.collisions(packs, passage).withColumn("key_class", F.lit("passage"))
    return collisions(whole_keys(packs)).select(*columns).unionByName(of_passages.select(*columns))


def text_collision_counts(texts: DataFrame, passage: int) -> DataFrame:
    """`collision_counts` of the keys of `text_collisions`."""
    packs = passages.packed(texts, passage)
    return collision_counts(whole_keys(packs)).unionByName(passages.shared_counts(packs, passage).withColumn("key_class", F.lit("passage")))


def collision_counts(keys: DataFrame) -> DataFrame:
    """For each pair of corpora and class of keys: distinct keys both have."""
    sets = keys.select("key_class", "key", "corpus").distinct().groupBy("key_class", "key").agg(F.array_sort(F.collect_list("corpus")).alias("_c")).where(F.size("_c") > 1)
    pairs = sets.select("key_class", F.posexplode("_c").alias("_i", "left_corpus"), "_c").select("key_class", "left_corpus", F.explode(F.slice("_c", F.col("_i") + 2, F.size("_c"))).alias("right_corpus"))
    return pairs.groupBy("key_class", "left_corpus", "right_corpus").agg(F.count(F.lit(1)).alias("n_keys"))


def without_collisions(candidates: DataFrame, id_: str, own: DataFrame, excluded: DataFrame) -> DataFrame:
    """Candidates none of whose keys is excluded: `own` has their keys (record_id, key_class, key), `excluded`
    others (key_class, key). One semi-join for all classes, and an anti-join by id."""
    hit = own.join(excluded.select("key_class", "key").distinct(), ["key_class", "key"], "left_semi").select(F.col("record_id").alias("_hit")).distinct()
    return candidates.join(hit, F.col(id_).cast("string") == F.col("_hit"), "left_anti")


def leakage_audit(candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """For each class of keys (long form): distinct keys also excluded, and those repeated inside."""
    inside = candidates.groupBy("key_class", "key").agg(F.count(F.lit(1)).alias("_n"))
    known = excluded.select("key_class", "key").distinct().withColumn("_x", F.lit(True))
    return inside.join(known, ["key_class", "key"], "left").groupBy("key_class").agg(F.count_if(F.coalesce("_x", F.lit(False))).alias("n_excluded"), F.count_if(F.col("_n") > 1).alias("n_repeated"), F.count(F.lit(1)).alias("n_keys"))


def without_text_collisions(candidates: DataFrame, id_: str, texts: DataFrame, corpus: str, passage: int) -> DataFrame:
    """Candidates, the records of one corpus of `texts`, none of whose keys (of `text_collisions`) another corpus has."""
    packs = passages.packed(texts, passage)
    keys, mine = whole_keys(packs), F.col("corpus") == corpus
    hit = passages.excluded(packs, passage, corpus).select(F.col("record_id").alias("_hit")).distinct()
    return without_collisions(candidates, id_, keys.where(mine), keys.where(~mine)).join(hit, F.col(id_).cast("string") == F.col("_hit"), "left_anti")


def text_leakage_audit(texts: DataFrame, corpus: str, passage: int) -> DataFrame:
    """`leakage_audit` of one corpus of `texts` against the others, by the keys of `text_collisions`."""
    packs = passages.packed(texts, passage)
    keys, mine = whole_keys(packs), F.col("corpus") == corpus
    return leakage_audit(keys.where(mine), keys.where(~mine)).unionByName(passages.audit(packs, passage, corpus).withColumn("key_class", F.lit("passage")))


def audit_findings(audit: DataFrame, coverage: DataFrame, keys: list[str], minimums: dict[str, int]) -> DataFrame:
    """finding, detail, n: what bars a surface. `audit`: rows of `leakage_audit`; a class with excluded keys is a
    COLLISION, one with repeated keys a REPETITION. `coverage`: a row for each of `keys` with counts; a
    count under its minimum, or unknown, is BOUNDARY_BELOW_MINIMUM. Without a row nothing bars it.
    """
    cell = lambda finding, detail, n: F.struct(F.lit(finding).alias("finding"), detail.alias("detail"), n.cast("bigint").alias("n"))
    collided = audit.select(F.inline(F.array(cell("COLLISION", F.col("key_class"), F.col("n_excluded")), cell("REPETITION", F.col("key_class"), F.col("n_repeated"))))).where("n > 0")
    name = lambda c: F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys), F.lit(c))
    low = [F.when(F.coalesce(F.col(c) < m, F.lit(True)), cell("BOUNDARY_BELOW_MINIMUM", name(c), F.coalesce(c, F.lit(0)))) for c, m in minimums.items()]
    return collided.unionByName(coverage.select(F.inline(F.filter(F.array(*low), lambda x: x.isNotNull()))))


def duplicates(df: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Groups of more than one row: their size and least id."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(id_).alias("least_id")).where("n > 1")


def integrity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How two tables fit one to one by key: a row for each finding code, with its count."""
    a = left.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_b"))
    both = a.join(b, "_k", "full")
    cells = {
        "LEFT_DUPLICATE": F.count_if(F.col("_a") > 1), "RIGHT_DUPLICATE": F.count_if(F.col("_b") > 1), "MISSING_RIGHT": F.count_if(F.col("_b").isNull()), "MISSING_LEFT": F.count_if(F.col("_a").isNull()),
        "MATCHED": F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)),
    }
    return both.agg(*(c.alias(n) for n, c in cells.items())).select(F.inline(F.array(*(F.struct(F.lit(n).alias("finding"), F.col(n).alias("n")) for n in cells))))


def require_complete(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    """Raise ValueError if a key of `left` has no row in `right`."""
    missing = left.select(*keys).join(right.select(*keys), keys, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"{what} without a match: {[tuple(r) for r in missing]}")


def ordered_subset(df: DataFrame, id_: str, ids: list[str]) -> DataFrame:
    """The rows of given ids in the order asked for, with `ordinal`; a missing id raises ValueError."""
    wanted = df.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], ["ordinal", "_id"])
    require_complete(wanted.select(F.col("_id").alias(id_)), df, [id_], "requested ids")
    few = len(ids) <= 100_000  # some MB; the list is in the driver's memory anyway
    return df.join(F.broadcast(wanted) if few else wanted, F.col(id_) == F.col("_id")).drop("_id").orderBy("ordinal")


def exactly_once(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """`df` unchanged, with an error at run time on the first key that a second row has."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"{what}: a key repeats")).cast("boolean"))).drop("_n")
