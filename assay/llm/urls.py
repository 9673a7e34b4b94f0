"""URL filter: rules where they fit, and a link graph for the rest.

Trust spreads from hosts with allowed pages along links, distrust from hosts with blocked pages
against them, as personalised PageRank over the graph of hosts. A page that no rule fits is
blocked where its host has more distrust than trust and as much distrust as a host of which
half the pages are blocked.

Rules meet hosts, not pages: a host is joined with the rules of its suffixes once, and a page
looks among its host's few rules. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, release, save, table

#: The rules of the query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Share of rank that follows links; the rest returns to the seeds.
DAMPING = 0.85
#: The change of any host's rank, between writes, that ends the rounds; rounds between writes; and
#: rounds after which ranks that still move are an error: at this damping 57 are enough for any graph.
TOLERANCE, WRITE_EVERY, MOST_ROUNDS = 1e-4, 5, 100
#: Distrust of a host of which so many pages are blocked, before links add to it.
BLOCKED_SHARE = 0.5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    """From the end of the host to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def links(pages: DataFrame) -> DataFrame:
    """Edges (src, dst, n) between different hosts, from the absolute links of `html`."""
    found = F.explode(F.transform(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK), F.lit(1)), lambda h: lower_ascii(h)))
    return pages.select(host_of(F.col("url")).alias("src"), found.alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRank: edges (src, dst, n), seeds (host, seed); rows (host, rank) where not 0.

    rank = (1 - DAMPING) * seed + DAMPING * (ranks of linking hosts, shared out over their links), and
    what hosts without links would pass on returns to the seeds. As it returns by the seeds' own
    shares, that only scales all ranks: so they are spread without it and brought to the seeds' sum
    at the end. Seeds keep their scale: twice the seed is twice the rank.

    Rounds go on until no rank moves by more than TOLERANCE, else RuntimeError. Both tables are reread
    each round, and ranks are written every few rounds, so a lost executor redoes a few rounds at
    most. A hub's many edges have one key on a join's side; the adaptive skew join splits it.
    """
    share = save(edges.join(edges.groupBy("src").agg(F.sum("n").alias("_out")), "src").select("src", "dst", (F.col("n") / F.col("_out")).alias("share")), "shares")
    start = save(seeds.where("seed > 0").select("host", ((1 - DAMPING) * F.col("seed")).alias("rank")), "seeds")
    if start.isEmpty():
        return start
    rank, written = start, start
    for k in range(1, MOST_ROUNDS + 1):
        moved = rank.join(share, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
        rank = moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % WRITE_EVERY:
            continue
        rank = save(rank, f"rank{k}")
        change = rank.withColumnRenamed("rank", "_new").join(written, "host", "full").agg(F.max(F.abs(F.coalesce("_new", F.lit(0.0)) - F.coalesce("rank", F.lit(0.0)))), F.sum("_new")).first()
        if k > WRITE_EVERY:
            release(written)
        written = rank
        if change[0] < TOLERANCE:
            seeded = start.agg(F.sum("rank")).first()[0] / (1 - DAMPING)
            return rank.select("host", (F.col("rank") * F.lit(seeded / change[1])).alias("rank"))
    raise RuntimeError(f"ranks still move after {MOST_ROUNDS} rounds")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host), distinct; rules (host, path, verdict). Each host with `rules`, an array of
    (length, verdict, path, rule) of all that fit it or a domain above it; longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("_suffix"), F.struct(F.length(F.concat("host", "path")).alias("length"), "verdict", "path", F.concat("host", "path").alias("rule")).alias("_rule"))
    return (
        hosts.select("host", F.explode(suffixes).alias("_suffix")).join(r, "_suffix")
        .groupBy("host").agg(F.sort_array(F.collect_set("_rule"), asc=False).alias("rules"))
    )


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """Each page (page_id, url, html) with host, path, rule (host and path of the longest that
    fits, else null), trust, distrust and verdict (allow or block).

    Rows are never merged: repeated and null page_ids stay apart. A url without host fits no rule
    and has no links; it is allowed. Of rules of equal length that fit one page a blocking one
    wins. A host whose trust equals its distrust is allowed. A null html has no links; a very long one is
    read whole. An empty table gives none. Other columns are ignored.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = p.where("host <> ''").select("host").distinct()
    fitting = save(host_rules(hosts, rules), "host-rules")
    fits = F.filter("rules", lambda r: F.substring(F.col("path"), F.lit(1), F.length(r["path"])) == r["path"])
    ruled = save(p.join(fitting, "host", "left").withColumn("_best", F.element_at(F.when(F.size(fits) > 0, fits), 1)).select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("_ruled")), "ruled")
    share = lambda v: F.avg(F.when(F.col("_ruled") == v, 1.0).otherwise(0.0))
    seeds = save(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("_allow"), share("block").alias("_block")), "host-seeds")
    edges = save(links(pages), "links")
    trust = spread(edges, seeds.select("host", F.col("_allow").alias("seed"))).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(back, seeds.select("host", F.col("_block").alias("seed"))).withColumnRenamed("rank", "distrust")
    scores = trust.join(distrust, "host", "full")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (d > t) & (d >= (1 - DAMPING) * BLOCKED_SHARE)
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", t.alias("trust"), d.alias("distrust"),
        F.coalesce("_ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"),
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all `pages`: see `judge` for nulls, empty and very long pages, ties and repeated rows."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
