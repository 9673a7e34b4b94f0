"""Quality rules whose cutoffs are learnt for each language and source.

Fixed cutoffs treat every source alike. Here each measure is counted in cells, for each (lang,
source). Such counts are a quantile sketch: cells are whole numbers up to a thousand and three
leading digits beyond, so the error is under a hundredth whatever the range; there are some hundreds
of cells for each power of ten; and two sketches merge by adding counts. A group's deciles give its
cutoffs: the ninth, and so many times the distance from the first more. A join with them filters. A
group of fewer than MIN_GROUP documents uses its language's merged sketch, and a small language that
of all documents.

Everything is DataFrame functions; a text is looked at only within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, hold, save, table, words

#: Words of a window whose repetition counts.
WINDOW = 8
#: Documents that a (lang, source), or a language, needs for cutoffs of its own.
MIN_GROUP = 50
#: Groups of (lang, source) whose cutoffs are broadcast, under 10 MB; for more, Spark shuffles.
BROADCAST_GROUPS = 100_000
#: A value passes up to the ninth decile and so many times its distance from the first ...
FENCE = 3
#: ... and so many cells more: what the sketch leaves open on either side.
SLACK = 2
#: What is measured: symbols and words equal to the word before in thousandths (of letters as if two
#: hundred more were there, and of words as if fifty more were, for short texts); lines equal to an
#: earlier one, beyond the first two, in thousandths of lines as if ten more were there; the mean word
#: length in tenths of a letter. Repeated windows have a base rule and no cell.
METRICS = {
    "symbols": "n_symbols * 1000 div (word_chars + 200)",
    "stutters": "n_stutters * 1000 div (n_words + 50)",
    "dup_lines": "greatest(n_dup_lines - 2, 0) * 1000 div (n_lines + 10)",
    "long_words": "word_chars * 10 div greatest(n_words, 1)",
}


#: Columns that are added, from a text alone and by the method.
STATISTICS = ["n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines", "n_stutters", "n_repeat_words"]
VERDICTS = ["base_failed", *(f"max_{k}" for k in METRICS), "kept"]


def with_window_hashes(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """Add `out`: 64-bit hashes of the windows of eight of the array `tokens`, none if it is shorter.
    Windows past the end hold nulls in part and are cut off at last."""
    size = F.size(tokens)
    df = df.withColumn(out, F.transform(F.col(tokens), lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        df = df.withColumn(out, F.zip_with(F.col(out), F.slice(out, F.lit(step + 1), F.greatest(size, F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    return df.withColumn(out, F.slice(out, F.lit(1), F.greatest(size - (WINDOW - 1), F.lit(0))))


def statistics(docs: DataFrame) -> DataFrame:
    """Add to each row n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stutters (words equal to the
    word before), n_repeat_words.

    A null text is an empty one: all are 0. Windows are equal if their 64-bit hashes are. Columns
    of those names are replaced; no others are touched.
    """
    kept = [c for c in docs.columns if c not in STATISTICS]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*kept, words(F.col("text")).alias("_words"), lines.alias("_lines"), F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"))
    df = df.select(
        *kept, "n_symbols", "_words",
        F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size(F.filter(F.zip_with("_words", F.slice("_words", F.lit(2), F.greatest(F.size("_words") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_stutters"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    df = with_window_hashes(df, "_words", "_w").drop("_words")
    # Only where some window repeats are windows sorted; equal ones are then neighbours.
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    empty = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.withColumn("_w", F.when(some, F.array_sort(F.transform("_w", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))).otherwise(empty))
    beside = lambda i: F.get("_w", i)["h"]
    repeated = F.transform("_w", lambda x, i: F.when((x["h"] == beside(i - 1)) | (x["h"] == beside(i + 1)), x["p"]))
    df = df.withColumn("_w", F.sort_array(F.filter(repeated, lambda p: p.isNotNull())))
    covered = F.aggregate(
        "_w",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", covered).drop("_w")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def cell(value: Column) -> Column:
    """The sketch's cell of a whole number: itself up to a thousand, else its three leading digits and zeros."""
    v = value.cast("long")
    unit = F.pow(F.lit(10.0), F.greatest(F.length(v.cast("string")) - 3, F.lit(0))).cast("long")
    return v - v % unit


def sketches(stats: DataFrame) -> DataFrame:
    """The sketch of each (lang, source): lang, source, metric, cell, n. Mergeable: add n."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), cell(F.expr(e)).alias("cell")) for k, e in METRICS.items())))
    return stats.select("lang", "source", cells.alias("_m")).groupBy("lang", "source", "_m.metric", "_m.cell").agg(F.count(F.lit(1)).alias("n"))


def cutoffs(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The highest value of each metric that passes, for each group of `keys`, and the group's size."""
    group = Window.partitionBy(*keys, "metric")
    merged = sketch.groupBy(*keys, "metric", "cell").agg(F.sum("n").alias("n"))
    decile = lambda k: F.min(F.when(10 * F.col("_upto") >= k * F.col("_all"), F.col("cell")))
    by_metric = (
        merged.withColumn("_upto", F.sum("n").over(group.orderBy("cell"))).withColumn("_all", F.sum("n").over(group))
        .groupBy(*keys, "metric").agg(decile(1).alias("_low"), decile(9).alias("_high"), F.max("_all").alias("_all"))
    )
    fence = lambda k: F.max(F.when(F.col("metric") == k, F.col("_high") + FENCE * (F.col("_high") - F.col("_low")) + SLACK))
    return by_metric.groupBy(*keys).agg(F.max("_all").alias("_size"), *(fence(k).alias(f"max_{k}") for k in METRICS))


def judge(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Every row of `docs` (it needs text, lang, source) with its statistics, base_failed, the
    cutoffs max_* of its group, and kept: not base_failed and no value over its cutoff.

    Cutoffs are learnt from rows that are not base_failed; nulls of lang and source are groups of
    their own; values are held against cutoffs as they are, however great. A group of fewer than `min_group` such rows takes its language's cutoffs, a smaller
    language those of all rows. Null and empty texts fail; repeated rows are judged each by itself and
    count as often; very long texts are read whole. An empty table gives an empty one. Columns named as
    the added ones are replaced, all others are kept as they are, whatever their names. Rows with their statistics are written, so texts
    are looked at once for both uses.
    """
    kept = [c for c in docs.columns if c not in (*STATISTICS, *VERDICTS)]
    needed = [c for c in ("text", "lang", "source") if c in kept]
    return verdicts(save(statistics(hold(docs.select(*kept), needed)), "statistics"), min_group).select(*held(kept, needed), *STATISTICS, *VERDICTS)


def verdicts(stats: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """`judge` for rows that have their statistics, lang and source already; a text isn't needed.

    Cutoffs meet rows by broadcast up to BROADCAST_GROUPS groups, so a hot source isn't shuffled.
    """
    names = [f"max_{k}" for k in METRICS]
    stats = stats.withColumn("base_failed", base_failed())
    sketch = save(sketches(stats.where(~F.col("base_failed"))), "sketch")
    large = F.col("_size") >= min_group
    of_group, of_lang, of_all = (cutoffs(sketch, keys) for keys in (["lang", "source"], ["lang"], []))
    held = F.struct(*names)
    of_group = of_group.where(large).select(F.col("lang").alias("_gl"), F.col("source").alias("_gs"), held.alias("_group"))
    of_lang = of_lang.where(large).select(F.col("lang").alias("_ll"), held.alias("_lang"))
    groups = save(
        stats.select("lang", "source").distinct()
        .join(of_group, F.col("lang").eqNullSafe(F.col("_gl")) & F.col("source").eqNullSafe(F.col("_gs")), "left")
        .join(of_lang, F.col("lang").eqNullSafe(F.col("_ll")), "left")
        .join(F.broadcast(of_all.select(held.alias("_all"))), F.lit(True), "left")  # one row
        .select(F.col("lang").alias("_lang_of"), F.col("source").alias("_source_of"), F.coalesce("_group", "_lang", "_all").alias("_max")),
        "cutoffs",
    )
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    over = F.lit(False)
    for k, e in METRICS.items():
        over = over | F.coalesce(F.expr(e) > F.col("_max")[f"max_{k}"], F.lit(False))
    joined = stats.join(groups, F.col("lang").eqNullSafe(F.col("_lang_of")) & F.col("source").eqNullSafe(F.col("_source_of")))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).select(*stats.columns, *(F.col("_max")[m].alias(m) for m in names), "kept")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all `documents`: see `judge` for nulls, empty and very long texts, ties
    and repeated rows. `kept` depends on MIN_GROUP: a (lang, source) with fewer documents that pass the base
    rules is held against its language's cutoffs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return verdicts(save(statistics(docs).drop("text"), "statistics")).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_stutters", "n_repeat_words", "base_failed", *(f"max_{k}" for k in METRICS), "kept")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, lang, source, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS s
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), rep AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, CAST(sum(CASE WHEN p IS NULL THEN 8 ELSE least(8, i - p) END) AS BIGINT) AS n FROM rep GROUP BY r
), st AS (
  SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_filter(list_zip(ws[2:], ws[1:len(ws) - 1]), lambda x: x[1] = x[2])) AS BIGINT) AS n_stutters,
    coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.r = cov.r
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    {metrics}
  FROM st
), ok AS (SELECT * FROM f WHERE NOT base_failed),
q AS (
  SELECT 2 AS lv, lang, source, count(*) AS n, {deciles} FROM ok GROUP BY lang, source
  UNION ALL SELECT 1, lang, NULL, count(*), {deciles} FROM ok GROUP BY lang
  UNION ALL SELECT 0, NULL, NULL, count(*), {deciles} FROM ok
), g AS (
  SELECT lv, lang, source, n, {fences} FROM q WHERE n >= 50 OR lv = 0 AND n > 0
), j AS (
  SELECT f.*, {chosen}
  FROM f
  LEFT JOIN g a ON a.lv = 2 AND f.lang IS NOT DISTINCT FROM a.lang AND f.source IS NOT DISTINCT FROM a.source
  LEFT JOIN g b ON b.lv = 1 AND f.lang IS NOT DISTINCT FROM b.lang
  LEFT JOIN g c ON c.lv = 0
)
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_stutters, n_repeat_words, base_failed,
  {names},
  NOT base_failed AND NOT ({over}) AS kept
FROM j
""".format(
    metrics=", ".join(f"{e.replace(' div ', ' // ')} AS {k}" for k, e in METRICS.items()),
    deciles=", ".join(f"quantile_disc({k}, 0.1) AS {k}_1, quantile_disc({k}, 0.9) AS {k}_9" for k in METRICS),
    fences=", ".join(f"{k}_9 + {FENCE} * ({k}_9 - {k}_1) + {SLACK} AS max_{k}" for k in METRICS),
    chosen=", ".join(f"CAST(CASE WHEN a.n IS NOT NULL THEN a.max_{k} WHEN b.n IS NOT NULL THEN b.max_{k} ELSE c.max_{k} END AS BIGINT) AS max_{k}" for k in METRICS),
    names=", ".join(f"max_{k}" for k in METRICS),
    over=" OR ".join(f"coalesce({k} > max_{k}, false)" for k in METRICS),
)
