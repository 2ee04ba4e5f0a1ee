from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crawlgrain.config import CrawlConfig
from crawlgrain.operators import crawl, exports, frontier, links, reports, rules, tables
from crawlgrain.plans.audit import audit
from crawlgrain.schemas import FETCHES
from crawlgrain.sources import fetches as S
from crawlgrain.sources import sites

T0 = datetime(2024, 1, 1)
WORDS = "word " * 120


def fetch(url, status=200, body="", depth=0, source="crawl", kind="text/html", final=None, chain=(), headers=None, error=None, at=0):
    return ("s1", url, url if url.count("/") == 3 else url.rstrip("/"), depth, source, T0 + timedelta(seconds=at), T0 + timedelta(seconds=at), status, kind, final, [tuple(h) for h in chain], 5, len(body), headers or {}, body, error)


def page(title="A good enough title", extra="", body=WORDS, h1="<h1>Heading</h1>", description="d"):
    t = f"<title>{title}</title>" if title is not None else ""
    d = f'<meta name="description" content="{description}">' if description else ""
    return f"<html><head>{t}{d}{extra}</head><body>{h1}<p>{body}</p></body></html>"


def issues_of(spark, *rows):
    crawled = crawl.crawled_urls(spark.createDataFrame(list(rows), FETCHES), ["https://e.com/"])
    edges = links.anchors(crawled, ["https://e.com/"])
    counted = links.with_link_counts(crawled, edges, links.edges(edges))
    out = {}
    for x in rules.all_issues(counted).collect():
        out.setdefault(x.url, {})[x.issue_key] = x
    return out


U = "https://e.com/p"
HOP = lambda a, b: (a, b, 301)
CASES = [
    (fetch(U, 404), {"http_4xx"}),
    (fetch(U, 500), {"http_5xx"}),
    (fetch("https://other.com/p", 404), set()),
    (fetch(U, 399), set()),
    (fetch(U, 600), {"missing_title", "missing_meta_description", "missing_h1"}),
    (fetch(U, 301), set()),
    (fetch(U, body=page()), set()),
    (fetch(U, body=page(title=None)), {"missing_title"}),
    (fetch(U, body=page(title="a" * 9)), {"title_too_short"}),
    (fetch(U, body=page(title="a" * 10)), set()),
    (fetch(U, body=page(title="a" * 65)), set()),
    (fetch(U, body=page(title="a" * 66)), {"title_too_long"}),
    (fetch(U, body=page(description=None)), {"missing_meta_description"}),
    (fetch(U, body=page(description="a" * 160)), set()),
    (fetch(U, body=page(description="a" * 161)), {"meta_description_too_long"}),
    (fetch(U, body=page(h1="")), {"missing_h1"}),
    (fetch(U, body=page(h1="<h1>a</h1><h1>b</h1>")), {"multiple_h1"}),
    (fetch(U, body=page(body="a " * 50)), {"thin_content"}),
    (fetch(U, body=page(body="a " * 98)), {"thin_content"}),
    (fetch(U, body=page(body="a " * 99)), set()),
    (fetch(U, body=page(body="", h1="<h1></h1>")), set()),
    (fetch(U, body=page(), depth=7), set()),
    (fetch(U, body=page(), depth=8), {"excessive_crawl_depth"}),
    (fetch(U, body=page(), chain=[HOP("a", "b")]), set()),
    (fetch(U, body=page(), chain=[HOP("a", "b"), HOP("b", "c")]), {"redirect_chain"}),
    (fetch(U, 0, error=("too_many_redirects", None), chain=[HOP("a", "b"), HOP("b", "a"), HOP("a", "b")]), {"redirect_chain", "redirect_loop"}),
    (fetch(U, body=page(extra='<link rel=canonical href="http://e.com/p">')), {"insecure_canonical"}),
    (fetch(U, body=page(extra='<link rel=canonical href="https://e.com/old">'), chain=[HOP("https://e.com/old", "/p")]), {"canonical_to_non_indexable"}),
    (fetch(U, body=page(extra='<link rel=canonical href="https://e.com/a b">')), {"broken_canonical"}),
    (fetch(U, body=page(extra='<meta name=robots content=noindex>'), source="sitemap"), {"noindex_in_sitemap"}),
    (fetch(U, body="x", kind="application/pdf"), set()),
    (fetch(U, body=page(title=None), kind=None), {"missing_title", "missing_meta_description", "missing_h1"}),
]


def test_each_rule(spark):
    rows = []
    for k, (row, _) in enumerate(CASES):
        rows.append((f"s{k}", *row[1:]))
    crawled = crawl.crawled_urls(spark.createDataFrame(rows, FETCHES), ["https://e.com/"])
    a = links.anchors(crawled, ["https://e.com/"])
    found = {}
    for x in rules.all_issues(links.with_link_counts(crawled, a, links.edges(a))).collect():
        found.setdefault(x.session_id, set()).add(x.issue_key)
    for k, (row, want) in enumerate(CASES):
        assert found.get(f"s{k}", set()) == want, row


def test_whole_table_rules_and_blocked_pages(spark):
    got = issues_of(
        spark,
        fetch("https://e.com/1", body=page("Same title HERE", body=WORDS + "1")),
        fetch("https://e.com/2", body=page(" same Title here ", body=WORDS + "2", description="other")),
        fetch("https://e.com/3", body=page("Yet another title", description=" D ", body=WORDS + "3" + '<a href="/4">x</a>')),
        fetch("https://e.com/5", body=page("One more title here", extra="<meta name=robots content=noindex>", description="o")),
    )
    assert "duplicate_title" in got["https://e.com/1"] and "duplicate_title" in got["https://e.com/2"] and "duplicate_title" not in got["https://e.com/3"]
    assert "duplicate_meta_description" in got["https://e.com/1"] and "duplicate_meta_description" in got["https://e.com/3"]
    assert got["https://e.com/1"]["duplicate_title"].data == {"title": "Same title HERE"} and got["https://e.com/1"]["duplicate_title"].severity == "warning"
    assert "https://e.com/5" not in got


def site(spark):
    rows = [
        fetch("https://e.com/", body=page(body=WORDS + '<a href="/a" rel="nofollow, sponsored">A</a> <a href="/a">again</a> <a href="/b/?utm_source=x">B</a> <a href="https://x.com/">X</a><a href="mailto:q@e.com">m</a>')),
        fetch("https://e.com/a", body=page("Page a of the site", body=WORDS + "a" + '<a href="b">B</a>'), depth=1, at=1),
        fetch("https://e.com/b", body=page("Page b of the site", body=WORDS + "b", extra='<link rel=canonical href="/a">'), depth=1, at=2),
        fetch("https://e.com/private/x", body=page("A private page here", body=WORDS + "p"), depth=1, at=3),
        fetch("https://e.com/deep", depth=11, body=page(), at=4),
        fetch("https://other.com/", body=page(), at=5),
    ]
    return spark.createDataFrame(rows, FETCHES)


def test_audit(spark, tmp_path):
    raw = spark.createDataFrame([("e.com", 200, "User-agent: *\nDisallow: /private/")], "host string, http_status int, body string")
    got = audit(site(spark), ["https://e.com/"], sites.robots_table(raw), keep=str(tmp_path / "rows"))
    by = {x.normalized_url: x for x in got.urls.collect()}
    assert {*by} == {"https://e.com/", "https://e.com/a", "https://e.com/b", "https://e.com/private/x"}
    assert by["https://e.com/private/x"].indexability_reason == "blocked_robots"
    assert by["https://e.com/b"].indexability_reason == "canonical_elsewhere" and by["https://e.com/b"].canonical_url == "https://e.com/a"
    home = by["https://e.com/"]
    assert (home.internal_outlink_count, home.external_outlink_count, home.internal_inlink_count) == (3, 1, 0)
    assert by["https://e.com/b"].internal_inlink_count == 2
    edges = {(x.source_url, x.target_url): x for x in got.links.collect()}
    assert len(edges) == 4 and edges["https://e.com/", "https://e.com/a"].anchor_text == "A" and edges["https://e.com/", "https://e.com/a"].rel.sponsored
    stats = got.stats.first()
    assert (stats.total, stats.n_2xx, stats.n_blocked, stats.n_indexable) == (4, 4, 1, 2)
    keys = [(x.url, x.issue_key) for x in got.issues.collect()]
    assert len(keys) == len({*keys})
    assert {x.normalized_url for x in links.orphans(got.urls, got.links).collect()} == {"https://e.com/", "https://e.com/private/x"}


def test_gates(spark):
    rows = site(spark)
    assert crawl.within_depth(rows, CrawlConfig(max_depth=0)).count() == 2
    assert crawl.within_depth(rows, CrawlConfig(max_depth=-1)).count() == 6
    assert crawl.limited(rows, CrawlConfig(max_urls=2)).count() == 2
    assert crawl.within_scope(rows, ["https://other.com/", "https://e.com/"]).count() == 6
    reasons = rows.select(crawl.skip_reason(F.col("crawl_depth"), F.lit(True), F.lit(False)).alias("r")).where("r is not null").collect()
    assert [x.r for x in reasons] == ["Exceeds max depth"]


def test_redirects(spark):
    starts = spark.createDataFrame([("http://a/1",), ("http://a/9",), ("http://a/l",)], "url string")
    edges = spark.createDataFrame([("http://a/1", "2", 301), ("http://a/2", "http://b/3", 302), ("http://a/l", "/l", 301), ("http://a/9", None, 301)], "from_url string, location string, status_code int")
    got = {x.url: x for x in S.follow_redirects(starts, edges).collect()}
    assert got["http://a/1"].final_url == "http://b/3" and [(h.from_url, h.to_url, h.status_code) for h in got["http://a/1"].redirect_chain] == [("http://a/1", "2", 301), ("http://a/2", "http://b/3", 302)]
    assert got["http://a/9"].redirect_chain == [] and got["http://a/l"].looped and len(got["http://a/l"].redirect_chain) == 10


def test_request_gaps(spark):
    got = [x.gap_seconds for x in S.request_gaps(site(spark)).where("host = 'e.com'").orderBy("fetched_at").collect()]
    assert got == [None, 1.0, 1.0, 1.0, 1.0]


def test_frontier(spark, tmp_path):
    pending = spark.createDataFrame([("u1", "u1", 1, T0), ("U1", "u1", 0, T0), ("u2", "u2", 0, T0 + timedelta(seconds=9)), ("u3", "u3", 2, T0), ("u4", "u4", 0, T0)], "url string, normalized_url string, crawl_depth int, discovered_at timestamp")
    seen = spark.createDataFrame([("u4",)], "normalized_url string")
    new = frontier.enqueue(pending, seen)
    assert {(x.normalized_url, x.url, x.crawl_depth) for x in new.collect()} == {("u1", "U1", 0), ("u2", "u2", 0), ("u3", "u3", 2)}
    assert [x.normalized_url for x in frontier.next_batch(new, 2).collect()] == ["u1", "u2"]
    kept, spilled = frontier.spill(new, 1)
    assert [x.normalized_url for x in kept.collect()] == ["u1"] and {x.normalized_url for x in spilled.collect()} == {"u2", "u3"}
    frontier.checkpoint_state(new, seen, str(tmp_path))
    back, known = frontier.restore_state(spark, str(tmp_path), spark.createDataFrame([("u2",)], "normalized_url string"))
    assert {x.normalized_url for x in back.collect()} == {"u1", "u3"} and known.count() == 1
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("c", "d"), ("x", "y")], "source_url string, target_url string")
    seeds = spark.createDataFrame([("a",), ("a",)], "normalized_url string")
    assert {tuple(x) for x in frontier.breadth_first(seeds, edges, -1).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {tuple(x) for x in frontier.breadth_first(seeds, edges, 1).collect()} == {("a", 0), ("b", 1)}


def test_tables(spark):
    t = spark.createDataFrame([(1, "old", 0), (2, "keep", 0)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1)], "id int, v string, at int")
    assert sorted(map(tuple, tables.upsert(t, new, ["id"], ["at"]).collect())) == [(1, "b", 2), (2, "keep", 0), (3, "c", 1)]
    assert sorted(map(tuple, tables.insert_or_ignore(t, new, ["id"], ["at"]).collect())) == [(1, "old", 0), (2, "keep", 0), (3, "c", 1)]
    projects = spark.createDataFrame([("p1",), ("p2",)], "id string")
    sessions = spark.createDataFrame([("s1", "p1"), ("s2", "p2")], "id string, project_id string")
    pages = spark.createDataFrame([("s1", "u"), ("s2", "v")], "session_id string, url string")
    left = tables.delete_projects(projects.where("id = 'p1'"), projects, sessions, pages=pages)
    assert {k: v.count() for k, v in left.items()} == {"projects": 1, "sessions": 1, "pages": 1} and left["pages"].first().url == "v"
    assert [x.id for x in tables.newest_first(new, "at").collect()] == [1, 1, 3]


def test_reports(spark):
    crawled = crawl.crawled_urls(site(spark))
    assert reports.by_status(crawled, "2xx").count() == 6 and reports.by_status(crawled, "4xx").count() == 0
    assert reports.search_urls(crawled, "PAGE A").count() == 1 and reports.search_urls(crawled, "").count() == 6
    pages = [x.normalized_url for k in range(3) for x in reports.listed_urls(crawled, 2, 2 * k).collect()]
    assert len({*pages}) == 6
    assert reports.sorted_urls(crawled, "title").first().title == "A good enough title"
    issues = spark.createDataFrame([("u", "k1", "info", "A", "t"), ("u", "k2", "error", "B", "t"), ("u", "k3", "weird", "B", "t"), ("v", "k4", "warning", "A", "needle")], "url string, issue_key string, severity string, category string, title string")
    assert [x.severity for x in reports.listed_issues(issues.where("severity <> 'weird'")).collect()] == ["error", "info", "warning"]
    assert [x.severity for x in reports.ranked_issues(reports.filter_issues(issues)).collect()] == ["error", "warning", "info"]
    assert [x.issue_key for x in reports.filter_issues(issues, category="A", needle="NEED").collect()] == ["k4"]
    assert {(x.dimension, x.value): x.n for x in reports.issue_counts(issues).collect()}["category", "A"] == 2


def test_exports(spark, tmp_path):
    got = audit(site(spark), ["https://e.com/"])
    rows = exports.url_rows(got.urls)
    assert len(rows.columns) == 29 and rows.columns[0] == "URL" and rows.columns[-1] == "Discovered At"
    first = rows.where("URL = 'https://e.com/'").first()
    assert first["Discovered At"] == "2024-01-01T00:00:00Z" and first["Is Indexable"] == "true" and first["Redirect URL"] == ""
    odd = spark.createDataFrame([('a"b', "c,d", "e\nf", "plain", None, "cr\r")], "a string, b string, c string, d string, e string, f string")
    assert exports.csv_lines(odd).first().line == '"a""b","c,d","e\nf",plain,,cr\r'
    exports.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*.csv")).read_bytes().decode()
    assert text.startswith("URL,Status Code,") and text.count("\r\n") == 5
    document = json.loads(exports.json_document("s1", got.stats, got.urls.select("normalized_url", "title"), got.issues).first().document)
    assert document["urlCount"] == 4 and document["sessionID"] == "s1" and document["stats"]["total"] == 4 and len(document["issues"]) == document["issueCount"]
    exports.write_json(got.urls, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    assert exports.sitemap_lines(spark.createDataFrame([("https://e.com/?a=1&b='\"<>",)], "loc string")).first().line == "  <url>\n    <loc>https://e.com/?a=1&amp;b=&apos;&quot;&lt;&gt;</loc>\n  </url>"
    exports.write_sitemaps(got.urls, str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "url").load(str(tmp_path / "xml")).count() == 3
    assert exports.issue_rows(got.issues).columns == ["URL", "Issue Key", "Severity", "Category", "Title", "Description", "Remediation"]


def test_comparisons(spark):
    a = spark.createDataFrame([("u", "k"), ("u", "l")], "url string, issue_key string")
    b = spark.createDataFrame([("u", "l"), ("v", "k")], "url string, issue_key string")
    assert {tuple(x) for x in links.session_diff(a, b).collect()} == {("u", "k", "fixed"), ("u", "l", "persisting"), ("v", "k", "new")}
    entries = spark.createDataFrame([("https://e.com/a/",), ("https://e.com/z",)], "loc string")
    got = {x.url: x.status for x in links.sitemap_discrepancy(crawl.crawled_urls(site(spark)), entries).collect()}
    assert got["https://e.com/z"] == "only_in_sitemap" and "https://e.com/a" not in got and got["https://e.com/b"] == "only_in_crawl"


def test_catalogue():
    assert len(rules.DEFINITIONS) == 22 == len(rules.BY_KEY)
    assert {d.severity for d in rules.DEFINITIONS} <= {*rules.SEVERITIES}
    with pytest.raises(AttributeError):
        rules.DEFINITIONS[0].key = "x"
