"""Queries against their SQL on small tables with odd rows: references cut short, URLs of several pages, times far apart."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

from crawlgrain.functions.html import read_page
from crawlgrain.operators import exports, frontier, links
from crawlgrain.plans import cases  # noqa: F401
from crawlgrain.plans.queries import ORACLE_SQL, QUERIES
from tests.test_queries import plain


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Pages whose titles and headings end within a reference, some of one URL; events of one user 29 days apart."""
    where = tmp_path_factory.mktemp("odd")
    page = "<html><head><title>Blog {i} &amp;&amp; more{cut}</title></head><body><article><h1>Head {i} &copy; x{cut}</h1><p>Some words{cut} of {i}</p></article></body></html>"
    cuts = ("", "&amp", "&am", "&amp;&lt", "&quot", "&")
    rows = [(i, f"https://blog.site.example.com/en/{i if i % 7 else 4 * (i // 28)}", page.format(i=i, cut=cuts[i % len(cuts)])) for i in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(where / "pages.parquet"))
    day = datetime(2024, 1, 1)
    # event_id % 5 is the depth: the deeper event comes long before the shallow one
    events = [(5 * k + 1 + (k % 3), day, k, "view", 1.0) for k in range(40)] + [(1000 + 5 * k, day + timedelta(days=29), k, "view", 1.0) for k in range(40)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(where / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("pages", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}/{name}.parquet/*.parquet')")
    return str(where), con


def equal(spark, odd, name):
    where, con = odd
    df = QUERIES[name](spark, where)
    columns = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    told = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in told.description].index(c) for c in columns]
    assert got and got == sorted(tuple(str(plain(r[k])) for k in at) for r in told.fetchall())


def test_references_without_semicolon_as_text_or_as_browsers_do():
    page = '<title>a&amp b &lt;&quot</title><script type="application/ld+json">{"@type":"R&amp"}</script><body><!-- &amp --><a href="/?x=1&copy=2">&notit; &#65 &#65;</a>'
    got, plainly = read_page(page, bare_references=False), read_page(page)
    assert got["title"] == 'a&amp b <&quot' and plainly["title"] == 'a& b <"'
    assert got["body_text"] == "&notit; &#65 A" and plainly["body_text"] == "¬it; A A"
    assert got["structured_data_types"] == plainly["structured_data_types"] == ["R&amp"]
    assert got["links"][0]["url"] == "/?x=1&copy=2"


def test_content_hash(spark, odd):
    equal(spark, odd, "content_hash")


def test_csv_export_lines(spark, odd):
    equal(spark, odd, "csv_export_lines")


def test_csv_file(spark, odd):
    equal(spark, odd, "csv_file")


def test_frontier_start(spark, odd):
    equal(spark, odd, "frontier_start")


def test_a_url_of_several_rows_is_one_start(spark):
    rows = spark.createDataFrame([("https://a.example/x",), ("https://a.example/x/",)], "url string")
    assert [(x.normalized_url, x.source) for x in frontier.starting(rows, rows.withColumnRenamed("url", "loc")).collect()] == [("https://a.example/x", "seed")]


def test_sitemap_discrepancy(spark, odd):
    equal(spark, odd, "sitemap_discrepancy")


def test_what_both_know_is_no_discrepancy(spark):
    crawled = spark.createDataFrame([("https://a.example/x",), ("https://a.example/x",), ("https://a.example/y",)], "normalized_url string")
    got = links.sitemap_discrepancy(crawled, spark.createDataFrame([("https://a.example/x/",)], "loc string"))
    assert [(x.url, x.status) for x in got.collect()] == [("https://a.example/y", "only_in_crawl")]


def test_csv_export_rows(spark, odd):
    equal(spark, odd, "csv_export_rows")


def test_extract_title_h1(spark, odd):
    equal(spark, odd, "extract_title_h1")


def test_frontier_enqueue(spark, odd):
    equal(spark, odd, "frontier_enqueue")


def test_urls_search(spark, odd):
    equal(spark, odd, "urls_search")


def test_csv_files_keep_the_ends_of_fields(spark, tmp_path):
    odd = [" lead", "trail ", "\x01a", "a\x02", "\ta", "x\n", "\r", " ", "a,b ", '" q']
    exports.write_csv(spark.createDataFrame([(str(i), x) for i, x in enumerate(odd)], "i string, x string"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"))
    assert [r.x for r in sorted(back.collect(), key=lambda r: int(r.i))] == odd


@pytest.fixture(scope="module")
def titled(spark, tmp_path_factory):
    """Pages whose titles hold what looks like markup, or begin or end with control characters."""
    where = tmp_path_factory.mktemp("titled")
    titles = ("Blog <b>{i}</b> x", "Blog {i} <c", "Blog <!-- {i} --> x", "Blog {i} < 9 & </b>", "<i>{i}", "\x01Blog {i}", "Blog {i}\x02")
    page = "<html><head><title>{t}</title></head><body><article><h1>Head {i}</h1><p>Some words of {i}</p></article></body></html>"
    rows = [(i, f"https://a.example.com/en/{i}", page.format(i=i, t=titles[i % len(titles)].format(i=i))) for i in range(140)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(where / "pages.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{where}/pages.parquet/*.parquet')")
    return str(where), con


def test_titles_hold_text_alone():
    page = "<script>'<title>a<b></title>'</script><!-- <title>c<d></title> --><title>x < y <b>&lt;z</b><!-- &amp; --></title><body><p>w <i>v</i></p><svg><title>s</title></svg>"
    assert [(x["title"], x["body_text"]) for x in (read_page(page), read_page(page, bare_references=False))] == [("x < y <b><z</b><!-- & -->", "w v")] * 2
    assert read_page("<title>a <b><body><p>w</p>")["body_text"] == "w"


@pytest.mark.parametrize("name", ["csv_export_rows", "csv_file", "urls_search"])
def test_titles_with_odd_text(spark, titled, name):
    equal(spark, titled, name)


def test_separators_are_no_white_space(spark, tmp_path):
    page = "<html><head><title>\x1fBlog\x1f{i} \x1c x\x1e</title></head><body><article><h1>Head\x1c{i}\x1d</h1><p>Some\x1dwords \x1e of {i}</p></article></body></html>"
    got = read_page(page.format(i=1))
    assert (got["title"], got["h1"], got["body_text"]) == ("\x1fBlog\x1f1 \x1c x\x1e", "Head\x1c1\x1d", "Head\x1c1\x1d Some\x1dwords \x1e of 1")
    spark.createDataFrame([(i, f"https://a.example.com/en/{i}", page.format(i=i)) for i in range(60)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("urls_search", "csv_export_rows", "csv_file", "content_hash"):
        equal(spark, (str(tmp_path), con), name)
