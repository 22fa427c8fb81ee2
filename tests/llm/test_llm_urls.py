"""URL verdicts against a plain loop over all rules."""

import re

import pytest

from eligra.llm import url_filter as uf

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "bad.org", ""),
         ("allow", "bad.org", "/ok"), ("block", "tie.io", "/a"), ("allow", "tie.io", "/a"), ("allow", "x.tie.io", "/"), ("block", "deep.io", "/a/b/c/d")]
URLS = ["http://EXAMPLE.com/en/x", "https://www.example.com/en/?q", "https://a.www.example.com/en/", "http://example.com", "http://example.com/", "http://notexample.com/en/",
        "x://m.net/es/1#top", "x://m.net/es", "//no.scheme/", None, "", "http://bad.org", "http://sub.bad.org/okay", "http://bad.org/OK", "http://tie.io/ab", "http://x.tie.io/a",
        "http://deep.io/a/b/c/d/e", "http://deep.io/a/b/c", "a://b://c.com/d", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://com/\nx", "http:///path", "http://..com/", "http://É.net/es/"]


def plain(url):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), v == "block", v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, "allow", None)
    return host, path, best[3], best[2]


@pytest.mark.parametrize("small", [uf.SMALL, 0])
def test_equals_a_loop(spark, monkeypatch, small):
    monkeypatch.setattr(uf, "SMALL", small)
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[0], "h"), (0, URLS[0], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = sorted(map(tuple, uf.judge(pages, uf.rule_table(spark, RULES)).collect()), key=str)
    assert got == sorted(((i, *plain(u)) for i, u, _ in rows), key=str)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert uf.judge(pages.where("false"), uf.rule_table(spark, RULES)).count() == 0
    assert [tuple(r) for r in uf.judge(pages, uf.rule_table(spark, [])).collect()] == [(1, "a.com", "/", None, "allow")]
    odd = uf.rule_table(spark, [("block", None, "/"), ("maybe", "com", "/"), ("block", "com", None)])
    assert uf.judge(pages, odd).first().rule is None
