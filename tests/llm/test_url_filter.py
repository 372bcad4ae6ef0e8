"""Verdicts against brute force over all edges, and against SQL on the given tables."""

import re

import duckdb
import numpy as np
import pytest

from pagemill.llm import url_filter
from pagemill.llm.queries import ORACLES, op13_url_filters
from pagemill.llm.url_filter import RULES, Rules, alias_targets, identity, judge, split_url
from tests.conftest import SF_DIR


def rule_of(url, rules=RULES):
    host, path = split_url(url)
    fits = [(-len(h) - len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (min(fits)[2], min(fits)[1]) if fits else (None, None)


def brute(pages, edges):
    """``pages``: id, url; ``edges``: pairs of URLs."""
    urls = {identity(u) for _, u in pages if u is not None} | {identity(u) for e in edges for u in e}
    part = {u: {u} for u in urls}
    for a, b in edges:
        a, b = part[identity(a)], part[identity(b)]
        if a is not b:
            a |= b
            for u in b:
                part[u] = a
    out = []
    for i, u in pages:
        rule, verdict = rule_of(u)
        said = set() if u is None else {rule_of(x)[1] for x in part[identity(u)]}
        out.append((i, *split_url(u), rule, verdict or ("allow" if "allow" in said else "block" if "block" in said else "allow"), u))
    return sorted(out, key=str)


def given():
    rng = np.random.default_rng(13)
    hosts = ["a.example.com", "b.io", "c.net", "d.example.net", "e.org", "f.dev", "net", "xnet", "G.Example.NET"]
    url = lambda: f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.integers(0, 40)}{rng.choice(['', '#top', '?p=1'])}"
    rows, edges = [], []
    for i in range(400):
        u, html = url(), "<html><head><title>x</title></head></html>"
        if i % 3 == 0:
            t = url()
            html = f'<html><head><LINK data-x="a>b" REL="alternate Canonical" href="{t}"></head></html>'
            edges.append((u, t))
        elif i % 7 == 0:
            t = url()
            html = f"<meta http-equiv=Refresh content='0; URL=\"{t}\"'><p>moved</p>"
            edges.append((u, t))
        elif i % 11 == 0:
            html = '<!-- <link rel=canonical href="http://c.net/"> --><script>"<link rel=canonical href=http://c.net/>"</script><link rel="stylesheet" href="http://c.net/">'
        rows.append((i, u, html))
    for i in range(400, 700):  # one target that many pages share
        u = f"http://s{i}.dev/{i}"
        rows.append((i, u, '<link rel="canonical" href="http://hub.dev/a?x=1&amp;y=2">'))
        edges.append((u, "http://hub.dev/a?x=1&y=2"))
    rows.append((700, "http://z.dev/x/y", '<link rel=canonical href=../w>'))
    edges.append(("http://z.dev/x/y", "http://z.dev/w"))
    rows += [(701, None, '<link rel=canonical href="http://c.net/">'), (702, "", None), (703, "no scheme/de/", ""), (704, "http://net", None), (705, "http://z.dev/w#f", None),
             (706, "a://b://c.net/x", None), (None, "http://C.NET/x", None), (1, rows[1][1], rows[1][2]), (707, "http://long.dev/" + "x" * 100_000, "y" * 100_000), (708, "http://q.dev/old", None)]
    return rows, edges


@pytest.mark.parametrize("nodes", [30, 200_000])
def test_against_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(url_filter, "NODES", nodes)
    rows, edges = given()
    pages = spark.createDataFrame([(*r, "x", 5, b"n") for r in rows], "page_id long, url string, html string, rule string, size long, node binary")
    redirects = [("http://q.dev/old", "http://hub.dev/a?x=1&y=2"), ("http://hub.dev/a?x=1&y=2#z", "http://www.net/"), (None, "http://c.net/"), ("http://c.net/", None)]
    more = spark.createDataFrame(redirects, "source string, target string")
    for extra, df in ((edges, None), (edges + redirects[:2], more)):
        got = judge(pages, redirects=df)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict", "url"]
        want = brute([r[:2] for r in rows], extra)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}


def test_longest_rule_and_allow_first():
    rules = Rules([("block", "b", "/c/d"), ("allow", "a.b", "/c"), ("block", "a.b", "/"), ("block", "b", "")])
    assert rules.fitting("a.b", "/c/d") == ("a.b/c", "allow") and rules.fitting("x.a.b", "/") == ("a.b/", "block")
    assert rules.fitting("b", "") == ("b", "block") and rules.fitting("ab", "/c/d") == (None, None) and rules.fitting("", "/") == (None, None)


def test_targets(value):
    page = '<link rel="canonical" href="/a?b&amp;c"><meta http-equiv="refresh" content="5;url=d"><meta http-equiv=refresh content="9"><link rel=canonical>'
    found = value(lambda u, h: alias_targets(u, h), url="https://x.y/p/q?z", html=page)
    assert found == ["https://x.y/a?b&c", "https://x.y/p/d"]


def test_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_DIR}/pages.parquet')")
    want = con.execute(ORACLES["op13_url_filters"])
    names = [d[0] for d in want.description]
    got = op13_url_filters(spark, SF_DIR)
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(str(tuple(r)) for r in want.fetchall()) and set(names) == set(got.columns)


def test_sql_follows_edges(spark):
    """The SQL on pages with edges of absolute addresses, which the given tables have none of."""
    rows, _ = given()
    rows = [(i, u, re.sub(r"&amp;|data-x=.*?\" ", "", h or "")) for i, u, h in rows if "../" not in (h or "") and len(u or "") < 1000]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    import pandas as pd
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    cur = con.execute(ORACLES["op13_url_filters"])
    names = [d[0] for d in cur.description]
    assert sorted(map(str, map(tuple, judge(pages).select(names).collect()))) == sorted(str(tuple(r)) for r in cur.fetchall())


def test_empty_table(spark):
    got = judge(spark.createDataFrame([], "page_id long, url string, html string"))
    assert got.count() == 0 and [t for _, t in got.dtypes] == ["bigint"] + ["string"] * 5
