"""Fetch observations: tables of them, from pages, from redirect edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlgrain.config import CrawlConfig
from crawlgrain.functions import urls
from crawlgrain.schemas import ERROR, FETCHES, REDIRECT_CHAIN

#: Redirects followed at most.
MAX_HOPS = 10
# Headers sent unless the settings say otherwise.
DEFAULT_HEADERS = {
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.5",
    "Accept-Encoding": "gzip, deflate, br",
}


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    """A table of observations by its fixed schema, session_id first among its partitions."""
    return spark.read.schema(FETCHES).parquet(path)


def request_headers(config: CrawlConfig = CrawlConfig()) -> dict[str, str]:
    """Default headers; custom ones win."""
    return DEFAULT_HEADERS | {"User-Agent": config.user_agent} | config.custom_headers


def response_headers(headers: Column) -> Column:
    """Header names in lower case; of names that fall together, the last holds."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"])))


def is_html(content_type: Column) -> Column:
    return F.lower(content_type).rlike("text/html|application/xhtml")


def fetch_error(code: Column, detail: Column) -> Column:
    """A failure's kind by its code: timeout, dns, refused, redirects, or unknown."""
    kind = F.when(code == "timeout", "timeout").when(code.isin("dns", "host_not_found"), "dns_failure").when(code.isin("refused", "cannot_connect"), "connection_refused").when(code == "too_many_redirects", "too_many_redirects").otherwise("unknown")
    return F.when(code.isNotNull(), F.struct(kind.alias("kind"), detail.alias("detail")))


def error_text(error: Column) -> Column:
    """An error as people read it."""
    return (
        F.when(error["kind"] == "timeout", "Timeout")
        .when(error["kind"] == "dns_failure", F.concat(F.lit("DNS failure: "), F.coalesce(error["detail"], F.lit(""))))
        .when(error["kind"] == "connection_refused", "Connection refused")
        .when(error["kind"] == "too_many_redirects", "Too many redirects")
        .when(error["kind"] == "response_too_large", "Response too large")
        .when(error["kind"] == "invalid_url", "Invalid URL")
        .when(error.isNotNull(), error["detail"])
    )


def decoded_body(raw: Column) -> Column:
    """A body's bytes as text: UTF-8 where they are valid UTF-8, else Latin-1."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(raw, "ISO-8859-1"))


def kept_body(body: Column, content_type: Column, config: CrawlConfig = CrawlConfig()) -> Column:
    """A body is analysed only if it is HTML and within the size limit."""
    return F.when(is_html(content_type) & (F.octet_length(body) <= config.max_response_body_bytes), body)


def from_pages(pages: DataFrame, session_id: str = "pages", config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """pages(page_id, url, html) as successful fetches at depth 0."""
    null = lambda kind: F.lit(None).cast(kind)
    at = F.timestamp_seconds(F.col("page_id"))
    return pages.select(
        F.lit(session_id).alias("session_id"),
        "url",
        urls.normalize(F.col("url"), config=config).alias("normalized_url"),
        F.lit(0).alias("crawl_depth"),
        F.lit("imported").alias("source"),
        at.alias("discovered_at"),
        at.alias("fetched_at"),
        F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"),
        null("string").alias("final_url"),
        F.array().cast(REDIRECT_CHAIN).alias("redirect_chain"),
        null("int").alias("response_time_ms"),
        F.octet_length("html").cast("bigint").alias("content_size_bytes"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.col("html").alias("body"),
        null(ERROR).alias("fetch_error"),
    )


def follow_redirects(starts: DataFrame, redirects: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(url, final_url, redirect_chain, looped) from starts(url) and redirects(from_url, location, status_code).

    Each hop is one equi-join; rows without a further hop drop out of the next. A
    Location is kept as it came and resolved for the request after it; one URL has one
    redirect. After max_hops the chain is cut and counts as a loop.
    """
    edges = redirects.where("location is not null").groupBy("from_url").agg(F.min(F.struct("location", "status_code")).alias("e"))
    edges = edges.select("from_url", "e.location", "e.status_code")
    going = starts.select("url").distinct().select("url", F.col("url").alias("at"), F.array().cast(REDIRECT_CHAIN).alias("redirect_chain"))
    done = None
    for _ in range(max_hops):
        hop = going.join(edges, going["at"] == edges["from_url"], "left")
        stop = hop.where("from_url is null").select("url", F.col("at").alias("final_url"), "redirect_chain", F.lit(False).alias("looped"))
        done = stop if done is None else done.unionByName(stop)
        step = F.struct(F.col("at").alias("from_url"), F.col("location").alias("to_url"), F.col("status_code").cast("int").alias("status_code"))
        going = hop.where("from_url is not null").select("url", urls.resolve(F.col("location"), F.col("at")).alias("at"), F.concat("redirect_chain", F.array(step)).alias("redirect_chain"))
    return done.unionByName(going.select("url", F.col("at").alias("final_url"), "redirect_chain", F.lit(True).alias("looped")))


def request_gaps(fetches: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """(host, fetched_at, gap_seconds, too_soon): how far apart a host's requests were, and whether nearer than the settings ask."""
    rows = fetches.select(urls.host(F.col("url")).alias("host"), "url", "fetched_at")
    order = Window.partitionBy("host").orderBy("fetched_at", "url")
    gaps = rows.select("host", "fetched_at", ((F.unix_micros("fetched_at") - F.unix_micros(F.lag("fetched_at").over(order))) / 1e6).alias("gap_seconds"))
    return gaps.withColumn("too_soon", F.coalesce(F.col("gap_seconds") < 1 / config.requests_per_second_per_host, F.lit(False)))
