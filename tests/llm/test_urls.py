"""The URL filter against plain rules and a dense power iteration."""

import re

import pytest

from assay.llm import urls
from assay.llm.urls import DAMPING, RULES, judge, op9_url_filter, spread

SF = "/root/testdata/sf0.001"


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def ruled(host, path, rules=RULES):
    fit = [(len(h + p), v, p, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit) if fit else None  # of equal lengths `block` is the greater


def plain_rank(edges, seeds):
    """Power iteration with the mass of hosts without links given back to the seeds."""
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    total, out = sum(seeds.values()), {}
    for a, _, n in edges:
        out[a] = out.get(a, 0) + n
    rank = {h: seeds.get(h, 0.0) for h in hosts}
    for _ in range(400):
        lost = sum(r for h, r in rank.items() if h not in out)
        following = {h: (1 - DAMPING + DAMPING * lost / total) * seeds.get(h, 0.0) for h in hosts}
        for a, b, n in edges:
            following[b] += DAMPING * rank[a] * n / out[a]
        rank = following
    return rank


def plain_judge(rows, rules=RULES):
    hosts = [parts(u) for _, u, _ in rows]
    best = [ruled(h, p, rules) for h, p in hosts]
    link = re.compile(r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)")
    edges, pages, given = {}, {}, {}
    for (h, _), b, (_, _, html) in zip(hosts, best, rows):
        if h:
            pages[h] = pages.get(h, 0) + 1
            if b:
                given[h, b[1]] = given.get((h, b[1]), 0) + 1
            for to in link.findall(html or ""):
                to = re.sub("[A-Z]", lambda x: x[0].lower(), to)
                if to != h:
                    edges[h, to] = edges.get((h, to), 0) + 1
    edges = [(a, b, n) for (a, b), n in edges.items()]
    share = lambda v: {h: given[h, v] / n for h, n in pages.items() if (h, v) in given}
    trust = plain_rank(edges, share("allow")) if share("allow") else {}
    distrust = plain_rank([(b, a, n) for a, b, n in edges], share("block")) if share("block") else {}
    out = []
    for (i, _, _), (h, p), b in zip(rows, hosts, best):
        t, d = trust.get(h, 0.0), distrust.get(h, 0.0)
        bad = d > t and d >= (1 - DAMPING) * urls.BLOCKED_SHARE
        close = abs(d - t) < 0.005 or abs(d - (1 - DAMPING) * urls.BLOCKED_SHARE) < 0.005
        out.append((i, h, p, b and b[3], b[1] if b else ("either" if close and h else "block" if bad and h else "allow")))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3] or "")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=order)
    for a, b in zip(got, sorted(want, key=order), strict=True):
        assert a[:4] == b[:4] and (a[4] == b[4] or b[4] == "either"), (a, b)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    same(op9_url_filter(spark, SF).collect(), plain_judge([(i, u, h if isinstance(h, str) else None if h is None else bytes(h).decode("utf-8", "replace")) for i, u, h in rows]))


def test_ranks(spark):
    """A ring, a hub and a host without links: equal to the power iteration, and the seeds' sum is kept."""
    edges = [("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("b", "end", 1), ("hub", "a", 3), ("hub", "far", 1)]
    seeds = {"a": 1.0, "hub": 0.5}
    got = {r["host"]: r["rank"] for r in spread(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, seed double")).collect()}
    want = plain_rank(edges, seeds)
    assert got == pytest.approx({h: r for h, r in want.items() if r}, abs=2e-3)
    assert sum(got.values()) == pytest.approx(1.5)


def test_no_convergence_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_ROUNDS", 5)
    with pytest.raises(RuntimeError):
        spread(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long"), spark.createDataFrame([("a", 1.0)], "host string, seed double"))


def test_odd_rows(spark):
    """Nulls, ties, repeated rows, clashing columns, a very long page and an empty table."""
    to = lambda *hosts: " ".join(f"<a href='https://{h}/x'>x</a>" for h in hosts)
    rows = [
        (1, "http://A.example.com/en/x?q#f", to("spam.org", "b.net")), (1, "http://A.example.com/en/x?q#f", to("spam.org", "b.net")), (None, "https://b.net/es/p", None), (2, None, to("b.net")), (3, "no scheme", ""),
        (4, "x://spam.org", to("b.net", "b.net") + "y" * 300_000 + to("a.example.com")), (5, "https://WWW.example.com/en/", ""), (6, "https://b.net/fr/", ""), (7, "https://notexample.com/en/", ""), (8, "https://tie.de/p/q", ""), (9, "://", None),
    ]
    rules = [*RULES, ("tie.de", "/p", "allow"), ("tie.de", "/p", "block")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, rank int")
    same(judge(df, rules).collect(), plain_judge(rows, rules))
    assert judge(df.limit(0), rules).collect() == []
