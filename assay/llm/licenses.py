"""Licence scan by canonical digest: a text is a known licence if, once both are canonical, their
digests are equal.

Canonical form: lower case; one spelling of each word of SPELLINGS; copyright lines gone; every
run of other characters than letters and digits one space. The whole text and each of its lines
are looked up, the text by a hash join with the digests of known licences and notices.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, hold, save, table

# Spellings that licence matching treats as equal (variant, canonical).
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"),
    ("analogue", "analog"), ("artefact", "artifact"), ("authorise", "authorize"), ("authorised", "authorized"), ("behaviour", "behavior"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("colour", "color"), ("customise", "customize"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelled", "labeled"), ("modelled", "modeled"), ("noninfringement", "non infringement"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilise", "utilize"), ("whilst", "while"), ("wilful", "willful"),
]

# Licences and notices (id, text); long licences are files named by their id.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", _MIT), ("ISC", "ISC License\n\n" + _ISC), ("ISC", _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    *((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
]

#: A line that is a copyright notice and no more.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
#: Digests that are looked up in place, in each line, and broadcast for texts: 64 letters each. More, or those of
#: a table, meet texts and lines in joins.
MOST_KNOWN = 10_000


def canonical_lines(text: Column) -> Column:
    """The canonical text with its line ends kept; null is empty."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " ")
    spelt = reduce(lambda x, p: F.regexp_replace(x, rf"\b{p[0]}\b", p[1]), SPELLINGS, c)
    some = "|".join(v for v, _ in SPELLINGS)
    return F.when(c.rlike(rf"\b(?:{some})\b"), spelt).otherwise(c)


def digest(canonical: Column) -> Column:
    """SHA-256 of a canonical text, its lines joined."""
    return F.sha2(F.trim(F.regexp_replace(canonical, r"[\n ]+", " ")), 256)


def head(line: Column) -> Column:
    """Length and first letters of a canonical line: lines of equal digests have the same."""
    return F.concat(F.length(F.trim(line)).cast("string"), F.lit(":"), F.substring(F.trim(line), 1, 8))


def known_heads(spark, known: list[tuple[str, str]] = KNOWN) -> list[str]:
    """The distinct heads of known texts, their lines joined."""
    joined = F.trim(F.regexp_replace(canonical_lines(F.col("text")), r"[\n ]+", " "))
    rows = spark.createDataFrame(known, "license_id string, text string").select(head(joined).alias("h")).distinct()
    return sorted(r["h"] for r in rows.collect())


def known_digests(spark, known: list[tuple[str, str]] = KNOWN) -> list[tuple[str, str]]:
    """(digest, license_id) of known texts, one id for each digest."""
    rows = spark.createDataFrame(known, "license_id string, text string").select(digest(canonical_lines(F.col("text"))).alias("digest"), "license_id")
    return sorted((r["digest"], r["license_id"]) for r in rows.groupBy("digest").agg(F.min("license_id").alias("license_id")).collect())


def _scan_by_joins(df: DataFrame, columns: list[Column], known: DataFrame) -> DataFrame:
    """`scan` for any number of known texts (license_id, text): rows are numbered and written, their lines'
    digests are joined with the known ones, and what is found is counted for each row."""
    lookup = save(known.select(digest(canonical_lines(F.col("text"))).alias("_known"), "license_id").groupBy("_known").agg(F.min("license_id").alias("license_id")), "known")
    empty = F.sha2(F.lit(""), 256)
    lookup = lookup.where(F.col("_known") != empty)
    rows = save(df.withColumn("_uid", F.monotonically_increasing_id()).withColumn("digest", digest(F.col("_canonical"))).withColumn("_lines", F.transform(F.split("_canonical", "\n"), lambda x: digest(x))).drop("_canonical"), "numbered")
    lines = rows.select("_uid", F.explode("_lines").alias("_line")).where(F.col("_line") != empty)
    found = lines.join(lookup, F.col("_line") == F.col("_known")).groupBy("_uid").agg(F.count(F.lit(1)).alias("n_notices"), F.array_sort(F.collect_set("license_id")).alias("notice_ids"))
    joined = rows.join(found, "_uid", "left").join(lookup, F.col("digest") == F.col("_known"), "left")
    return joined.select(*columns, "digest", "license_id", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("notice_ids", F.array().cast("array<string>")).alias("notice_ids"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | DataFrame = KNOWN, most: int = MOST_KNOWN) -> DataFrame:
    """Add to each row: digest of the canonical whole text, license_id (null if it is not known),
    n_notices (lines that are known, each time) and notice_ids (their distinct ids, sorted).

    Null and empty texts have the digest of the empty text, which is never known. Columns of
    these names are replaced; rows are never merged, so repeated and null doc_ids stay apart. Very
    long texts are read whole. Where several known texts have one digest, the least id stands for it. An empty
    table gives an empty one; other columns, whatever their names, are kept. `known` is a list, or a
    table (license_id, text) of any size; a list of more than `most` texts is treated as one.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("digest", "license_id", "n_notices", "notice_ids")]
    df = hold(docs.select(*kept), ["text"])
    columns, kept = held(kept, ["text"]), df.columns
    df = df.select(*kept, canonical_lines(F.col("text")).alias("_canonical"))
    if isinstance(known, DataFrame) or len(known) > most:
        return _scan_by_joins(df, columns, known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license_id string, text string"))
    pairs = [(d, i) for d, i in known_digests(spark, known)]
    lookup = spark.createDataFrame(pairs, "_known string, license_id string")  # at most MOST_KNOWN rows
    if not pairs:
        return df.select(*columns, digest(F.col("_canonical")).alias("digest"), F.lit(None).cast("string").alias("license_id"), F.lit(0).cast("long").alias("n_notices"), F.array().cast("array<string>").alias("notice_ids"))
    # Only lines with the head of some known text are digested.
    heads = known_heads(spark, known)
    maybe = F.filter(F.split("_canonical", "\n"), lambda x: head(x).isin(heads))
    df = df.select(*kept, digest(F.col("_canonical")).alias("digest"), F.transform(maybe, lambda x: digest(x)).alias("_lines"))
    ids = F.create_map(*(F.lit(x) for p in pairs for x in p))
    notices = F.filter(F.transform("_lines", lambda d: F.element_at(ids, d)), lambda i: i.isNotNull())
    df = df.select(*kept, "digest", notices.alias("_ids"))
    return df.join(F.broadcast(lookup), F.col("digest") == F.col("_known"), "left").select(
        *columns, "digest", "license_id", F.size("_ids").cast("long").alias("n_notices"), F.array_sort(F.array_distinct("_ids")).alias("notice_ids")
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Digests and known licences of all `documents`: see `scan` for nulls, empty and very long texts, ties
    and repeated rows."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "license_id", "n_notices", "notice_ids")
