"""Exports: CSV, JSON and XML, as columns of text and as distributed writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.functions import dates, text


def _flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "true").otherwise("false")


def _url_columns() -> list[tuple[str, Column]]:
    c = F.col
    canonical = F.coalesce("canonical_url", F.lit(""))
    # The export's headings, in order.
    return [
        ("URL", c("normalized_url")), ("Status Code", c("status_code")), ("Redirect URL", c("final_url")), ("Redirect Chain Length", F.coalesce(F.size("redirect_chain"), F.lit(0))),
        ("Title", c("title")), ("Title Length", c("title_length")), ("Meta Description", c("meta_description")), ("Meta Description Length", c("meta_description_length")),
        ("H1", c("h1")), ("H1 Count", c("h1_count")), ("H2 Count", c("h2_count")),
        ("Canonical URL", canonical), ("Canonical Matches", _flag((canonical == "") | (canonical == c("normalized_url")))),
        ("Noindex", _flag(c("robots_directives")["noindex"])), ("Nofollow", _flag(c("robots_directives")["nofollow"])),
        ("Is Indexable", _flag(c("is_indexable"))), ("Indexability Reason", c("indexability_reason")), ("Blocked by Robots", _flag(c("is_blocked_by_robots"))),
        ("Internal Inlinks", c("internal_inlink_count")), ("Internal Outlinks", c("internal_outlink_count")), ("External Outlinks", c("external_outlink_count")),
        ("Images", c("image_count")), ("Word Count", c("word_count")), ("Content Type", c("content_type")), ("Response Time (ms)", c("response_time_ms")), ("Content Size (bytes)", c("content_size_bytes")),
        ("Crawl Depth", c("crawl_depth")), ("Source", c("source")), ("Discovered At", dates.iso8601(c("discovered_at"))),
    ]


def url_rows(crawled: DataFrame) -> DataFrame:
    """The 29 export columns as text, null as nothing."""
    return crawled.select(*[F.coalesce(v.cast("string"), F.lit("")).alias(k) for k, v in _url_columns()])


def issue_rows(issues: DataFrame) -> DataFrame:
    # The export's headings, in order.
    names = {"URL": "url", "Issue Key": "issue_key", "Severity": "severity", "Category": "category", "Title": "title", "Description": "description", "Remediation": "remediation"}
    return issues.select(*[F.coalesce(F.col(v), F.lit("")).alias(k) for k, v in names.items()])


def csv_lines(rows: DataFrame) -> DataFrame:
    """(line): fields quoted only where they hold a comma, a quote or a line feed."""
    return rows.select(F.concat_ws(",", *[text.csv_field(F.col(f"`{c}`")) for c in rows.columns]).alias("line"))


def csv_header(rows: DataFrame) -> str:
    return ",".join(rows.columns)


def write_csv(rows: DataFrame, path: str) -> None:
    """Part files with a header each, CRLF at line ends, quotes doubled, blanks and control characters at the ends of fields kept; no row limit."""
    rows.write.mode("overwrite").options(header=True, escape='"', lineSep="\r\n", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(crawled: DataFrame, path: str) -> None:
    """One object per line, null fields left out: the form for results of any size."""
    crawled.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def json_document(session_id: str, stats: DataFrame, crawled: DataFrame, issues: DataFrame) -> DataFrame:
    """(document): one JSON object of a session; for small sessions, as one row holds it all.

    URLs and issues are each aggregated to a sorted array; write_json() is for more.
    """
    u = crawled.agg(F.array_sort(F.collect_list(F.struct(*sorted(crawled.columns)))).alias("urls"))
    i = issues.agg(F.array_sort(F.collect_list(F.struct("url", "issue_key", "severity", "category", "title"))).alias("issues"))
    s = stats.where(F.col("session_id") == session_id).select(F.struct(*[c for c in stats.columns if c != "session_id"]).alias("stats"))
    one = s.join(u).join(i)  # one row each
    return one.select(F.to_json(F.struct(F.size("issues").alias("issueCount"), "issues", F.lit(session_id).alias("sessionID"), "stats", F.size("urls").alias("urlCount"), "urls")).alias("document"))


def sitemap_urls(crawled: DataFrame) -> DataFrame:
    """(loc) of what belongs in a sitemap: indexable, internal, status 200."""
    return crawled.where("is_indexable and is_internal and status_code = 200").select(F.col("normalized_url").alias("loc"))


def sitemap_lines(locs: DataFrame) -> DataFrame:
    """(loc, line): an escaped url element each."""
    return locs.select("loc", F.concat(F.lit("  <url>\n    <loc>"), text.xml_escaped(F.col("loc")), F.lit("</loc>\n  </url>")).alias("line"))


def write_sitemaps(crawled: DataFrame, path: str) -> None:
    """Sitemap files, each whole and of at most 50,000 URLs as the protocol asks."""
    rows = sitemap_urls(crawled)
    rows.write.mode("overwrite").option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').option("rowTag", "url").option("maxRecordsPerFile", 50_000).format("xml").save(path)
