from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from crawlgrain.functions import dates, robots
from crawlgrain.functions import sitemaps as M
from crawlgrain.sources import sites

ROBOTS = [
    ("", "/anything", "bot", True),
    ("User-agent: *\nDisallow: /", "/page", "Bot", False),
    ("User-agent: *\nDisallow: /private/", "/public/page", "bot", True),
    ("User-agent: *\nDisallow: /private/", "/private/secret", "bot", False),
    ("User-agent: *\nDisallow: /private/\nAllow: /private/allowed.html", "/private/secret", "bot", False),
    ("User-agent: *\nDisallow: /private/\nAllow: /private/allowed.html", "/private/allowed.html", "bot", True),
    ("User-agent: *\nDisallow: /\n\nUser-agent: MyBot\nAllow: /", "/page", "mybOT", True),
    ("User-agent: *\nDisallow: /\n\nUser-agent: MyBot\nAllow: /", "/page", "otherbot", False),
    ("User-agent: *\nDisallow: /search?q=*", "/search?q=term", "bot", False),
    ("User-agent: *\nDisallow: /search?q=*", "/search", "bot", True),
    ("User-agent: *\nDisallow: /*.pdf$", "/document.pdf", "bot", False),
    ("User-agent: *\nDisallow: /*.pdf$", "/document.pdf.html", "bot", True),
    ("# c\nUser-agent: * # all\nDisallow: /private/ # hidden", "/private/page", "bot", False),
    ("User-agent: googlebot\nDisallow: /nogoogle/\n\nUser-agent: *\nDisallow: /private/", "/nogoogle/page", "googlebot", False),
    ("User-agent: googlebot\nDisallow: /nogoogle/\n\nUser-agent: *\nDisallow: /private/", "/nogoogle/page", "otherbot", True),
    ("User-agent: googlebot\nDisallow: /nogoogle/\n\nUser-agent: *\nDisallow: /private/", "/private/page", "otherbot", False),
    ("User-agent: a\nUser-agent: b\nDisallow: /x", "/x/1", "b", False),
    ("User-agent: *\nDisallow: /a$b", "/a$bc", "bot", False),
    ("User-agent: *\nDisallow: $", "/", "bot", True),
    ("User-agent: *\nDisallow: /caf%C3%A9", "/café", "bot", False),
    ("User-agent: *\nDisallow: /x\nAllow: /x", "/x", "bot", True),
]


def decide(spark, cases, reference=False):
    rows = spark.createDataFrame([(k, t, p, a) for k, (t, p, a, _) in enumerate(cases)], "k int, body string, path string, agent string")
    got = rows.select("k", robots.allowed(robots.parse(F.col("body")), F.col("path"), F.col("agent"), reference).alias("ok")).collect()
    return {x.k: x.ok for x in got}


def test_decisions(spark):
    got = decide(spark, ROBOTS)
    for k, case in enumerate(ROBOTS):
        assert got[k] is case[3], case


def test_both_readings_of_groups_and_empty_rules(spark):
    text = "User-agent: *\nDisallow: /admin/\n\nUser-agent: own\nAllow: /"
    cases = [(text, "/admin/x", "own", None), ("User-agent: *\nDisallow:", "/page", "bot", None)]
    assert decide(spark, cases) == {0: True, 1: True}
    assert decide(spark, cases, reference=True) == {0: False, 1: False}


def test_parsing_and_statuses(spark):
    got = robots.parse_text("Sitemap: https://a/1.xml\nCrawl-delay: 5\nUser-agent: *\nCrawl-delay: 2\nDisallow:\nbad line\nSitemap: https://a/2.xml")
    assert got["crawl_delay"] == 2 and len(got["sitemaps"]) == 2
    raw = spark.createDataFrame([("A.com", 200, "User-agent: *\nDisallow: /x\nSitemap: s"), ("b.com", 403, None), ("c.com", 500, "User-agent: *\nDisallow: /")], "host string, http_status int, body string")
    table = sites.robots_table(raw)
    pages = spark.createDataFrame([("https://a.com/x",), ("https://b.com/",), ("https://c.com/x",), ("https://d.com/x",)], "url string")
    got = {x.url: (x.ok, x.robots_known) for x in sites.cached_robots(pages, table).select("url", robots.allowed(F.col("robots"), F.lit("/x"), F.lit("bot")).alias("ok"), "robots_known").collect()}
    assert got == {"https://a.com/x": (False, True), "https://b.com/": (False, True), "https://c.com/x": (True, True), "https://d.com/x": (True, False)}
    assert [x.url for x in sites.robots_sitemaps(table).collect()] == ["s"]


def test_sitemaps(spark):
    text = """<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://i"><url><loc>https://a/1</loc><image:image><image:loc>https://a/i.png</image:loc></image:image><lastmod>2024-05-06</lastmod></url><url><loc></loc></url><url><loc>https://a/2"""
    got = M.parse_text(text)
    assert [u["loc"] for u in got["urls"]] == ["https://a/1"] and got["error"]
    assert M.parse_text(None) == {"urls": [], "children": [], "error": None}
    row = spark.createDataFrame([("2024-05-06",), ("2024-05-06T07:08:09",), ("2024-05-06T07:08:09+02:00",), ("May",), (None,)], "t string")
    got = [x[0] for x in row.select(M.lastmod(F.col("t")).cast("string")).collect()]
    assert got == ["2024-05-06 00:00:00", "2024-05-06 07:08:09", "2024-05-06 05:08:09", None, None]


def test_seeds(spark):
    rows = spark.createDataFrame([(" https://a/ \n\nhttps://b/\r\n",)], "text string")
    assert [x.url for x in sites.seeds(rows).collect()] == ["https://a/", "https://b/"]


@pytest.mark.parametrize(
    ("f", "args", "want"),
    [
        (dates.next_daily, (9, 30), datetime(2024, 1, 31, 9, 30)),
        (dates.next_daily, (12, 0), datetime(2024, 2, 1, 12, 0)),
        (dates.next_weekly, (4, 8, 0), datetime(2024, 1, 31, 8, 0)),
        (dates.next_weekly, (3, 8, 0), datetime(2024, 2, 6, 8, 0)),
        (dates.next_monthly, (31, 8, 0), datetime(2024, 1, 31, 8, 0)),
        (dates.next_monthly, (30, 8, 0), datetime(2024, 2, 29, 8, 0)),
    ],
)
def test_schedules(spark, f, args, want):
    after = datetime(2024, 1, 31, 12, 0) if want.day != 31 else datetime(2024, 1, 31, 7, 0)
    assert after.date() >= date(2024, 1, 31)
    row = spark.createDataFrame([(after,)], "t timestamp")
    assert row.select(f(F.col("t"), *args)).first()[0] == want
