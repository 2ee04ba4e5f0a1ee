from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crawlgrain.config import CrawlConfig
from crawlgrain.functions import urls

NORMALIZE = [
    ("HTTPS://Example.COM/path", None, "https://example.com/path"),
    ("http://example.com:80/page", None, "http://example.com/page"),
    ("https://example.com:443/page", None, "https://example.com/page"),
    ("https://example.com:8080/page", None, "https://example.com:8080/page"),
    ("https://example.com/page#section", None, "https://example.com/page"),
    ("https://example.com", None, "https://example.com/"),
    ("https://example.com/a/b/../c", None, "https://example.com/a/c"),
    ("https://example.com/a/./b", None, "https://example.com/a/b"),
    ("https://example.com/about/", None, "https://example.com/about"),
    ("https://example.com/", None, "https://example.com/"),
    ("https://example.com/page?utm_source=google&utm_medium=cpc&id=123", None, "https://example.com/page?id=123"),
    ("https://example.com/?gclid=abc123&page=1", None, "https://example.com/?page=1"),
    ("javascript:void(0)", None, None),
    ("mailto:test@example.com", None, None),
    ("tel:+1", None, None),
    ("data:text/html,<h1>hi</h1>", None, None),
    ("ftp://example.com/file.txt", None, None),
    ("", None, None),
    ("  \n ", None, None),
    (None, None, None),
    ("../other.html", "https://example.com/section/page.html", "https://example.com/other.html"),
    ("/about", "https://example.com/section/page.html", "https://example.com/about"),
    ("?q=1", "https://example.com/a/b", "https://example.com/a/b?q=1"),
    ("#top", "https://example.com/a/b?x=1", "https://example.com/a/b?x=1"),
    ("//cdn.example.com/x", "https://example.com/a", "https://cdn.example.com/x"),
    ("g;x=1/../y", "https://example.com/b/c/d", "https://example.com/b/c/y"),
    ("../../../g", "https://example.com/b/c/d", "https://example.com/g"),
    ("x", "https://example.com", "https://example.com/x"),
    ("https://example.com./", None, "https://example.com/"),
    ("https://user:pw@Example.com/x", None, "https://user:pw@example.com/x"),
    ("https://example.com/%7euser/%2fa%zz%", None, "https://example.com/~user/%2Fa%zz%"),
    ("https://example.com/caf%c3%a9", None, "https://example.com/caf%C3%A9"),
    ("https://example.com/a/..", None, "https://example.com/"),
    ("https://example.com/?", None, "https://example.com/"),
    ("https://example.com/?b=2&a=1&REF=x", None, "https://example.com/?b=2&a=1"),
]


def test_normalize(spark):
    rows = spark.createDataFrame([(k, u, b or "https://base.example/") for k, (u, b, _) in enumerate(NORMALIZE)], "k int, u string, b string")
    got = {x.k: (x.n, x.m) for x in rows.select("k", urls.normalize(F.col("u")).alias("n"), urls.normalize(F.col("u"), F.col("b")).alias("m")).collect()}
    for k, (u, b, want) in enumerate(NORMALIZE):
        assert got[k][1 if b else 0] == want, (u, b)
    full = [n for (u, b, w), (n, _) in zip(NORMALIZE, got.values(), strict=True) if n]
    again = spark.createDataFrame([(x,) for x in full], "u string").select("u", urls.normalize(F.col("u")).alias("n")).collect()
    assert all(x.u == x.n for x in again)  # idempotent


def test_settings(spark):
    row = spark.createDataFrame([("https://e.com/a/?b=2&a=1&utm_id=3",)], "u string")
    at = lambda **k: row.select(urls.normalize(F.col("u"), config=CrawlConfig(**k))).first()[0]
    assert at(normalize_trailing_slash=False) == "https://e.com/a/?b=2&a=1"
    assert at(strip_tracking_parameters=False) == "https://e.com/a?b=2&a=1&utm_id=3"
    assert at(sort_query_parameters=True) == "https://e.com/a?a=1&b=2"


SCOPE = [
    ("https://example.com/page", "https://example.com", {}, True),
    ("https://other.com/page", "https://example.com", {}, False),
    ("https://sub.example.com/", "https://example.com", {}, False),
    ("https://sub.example.com/", "https://example.com", {"include_subdomains": True}, True),
    ("https://other.com/", "https://example.com", {"constrain_to_seed_domain": False}, True),
    ("http://localhost:8765/x", "http://localhost:8765/", {}, True),
    ("https://example.com/blog/x", "https://example.com", {"allowed_paths": ("/blog",)}, True),
    ("https://example.com/shop", "https://example.com", {"allowed_paths": ("/blog", "/news")}, False),
    ("ftp://example.com/", "https://example.com", {}, False),
    (None, "https://example.com", {}, False),
]


@pytest.mark.parametrize(("url", "seed", "config", "want"), SCOPE)
def test_scope(spark, url, seed, config, want):
    row = spark.createDataFrame([(url, seed)], "u string, s string")
    assert row.select(urls.in_scope(F.col("u"), F.col("s"), CrawlConfig(**config))).first()[0] is want


def test_parts(spark):
    row = spark.createDataFrame([("https://U@A.Example.co.uk.:81/p/q?x=1#f", "http://localhost/")], "u string, v string")
    got = row.select(urls.host(F.col("u")), urls.registered_domain(urls.host(F.col("u"))), urls.registered_domain(urls.host(F.col("v"))), urls.robots_path(F.col("u")), urls.sitemap_url(F.col("v")), urls.well_formed(F.col("u")), urls.well_formed(F.lit("http://a b/"))).first()
    assert tuple(got) == ("a.example.co.uk", "co.uk", None, "/p/q?x=1", "http://localhost/sitemap.xml", True, False)
