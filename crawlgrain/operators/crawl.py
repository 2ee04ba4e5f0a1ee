"""From fetch observations to analysed URLs and links: gates, extraction, indexability.

The page is parsed once per row, in one Arrow function; all else is columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.config import CrawlConfig
from crawlgrain.functions import html, robots, text, urls
from crawlgrain.sources import fetches as S


def within_depth(df: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    return df if config.max_depth < 0 else df.where(F.col("crawl_depth") <= config.max_depth)


def within_scope(df: DataFrame, seeds: list[str], config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Rows in scope of any seed. Seeds are settings, so they are part of the plan."""
    return df.where(urls.is_internal(F.col("normalized_url"), F.array(*map(F.lit, seeds)), config))


def limited(df: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """At most max_urls rows, shallow and early ones first."""
    return df.orderBy("crawl_depth", "discovered_at", "normalized_url").limit(config.max_urls) if config.max_urls else df


def skip_reason(depth: Column, in_scope: Column, blocked: Column, config: CrawlConfig = CrawlConfig()) -> Column:
    """Why a URL isn't fetched, or null."""
    deep = F.lit(False) if config.max_depth < 0 else depth > config.max_depth
    return F.when(deep, "Exceeds max depth").when(~in_scope, "Out of crawl scope").when(blocked, "Blocked by robots.txt")


def with_robots(df: DataFrame, table: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Adds is_blocked_by_robots. Hosts without a file block nothing.

    Joined by host: rules aren't repeated per URL before the join, and whether the
    host table is broadcast is left to its measured size.
    """
    if not config.obey_robots:
        return df.withColumn("is_blocked_by_robots", F.lit(False))
    joined = df.withColumn("_host", urls.host(F.col("normalized_url"))).join(table.select(F.col("host").alias("_host"), F.col("robots").alias("_robots")), "_host", "left")
    fine = F.when(F.col("_robots").isNull(), True).otherwise(robots.allowed(F.col("_robots"), urls.robots_path(F.col("normalized_url")), F.lit(config.user_agent), config.reference_robots))
    return joined.withColumn("is_blocked_by_robots", ~fine).drop("_host", "_robots")


def directives(meta: Column, header: Column) -> Column:
    """Robots directives of a page's meta elements and its X-Robots-Tag header."""
    joined = F.concat_ws(",", meta, header)
    tokens = F.transform(F.split(joined, "[,;]"), lambda t: F.lower(urls.trimmed(t)))
    has = lambda name: F.array_contains(tokens, name)
    after = F.get(F.filter(tokens, lambda t: t.startswith("unavailable_after")), F.lit(0))
    date = F.try_to_timestamp(urls.trimmed(F.regexp_replace(after, r"^unavailable_after\s*:", "")), F.lit("yyyy-MM-dd")).cast("date")
    return F.struct(
        (has("noindex") | has("none")).alias("noindex"),
        (has("nofollow") | has("none")).alias("nofollow"),
        has("noarchive").alias("noarchive"),
        has("nosnippet").alias("nosnippet"),
        has("noimageindex").alias("noimageindex"),
        date.alias("unavailable_after"),
        F.when(header.isNotNull(), "header").otherwise("meta").alias("source"),
    )


def indexability_reason(status: Column, failed: Column, canonical: Column, noindex: Column, normalized: Column, final: Column, blocked: Column) -> Column:
    """Why a URL isn't indexable, or null: the last cause that the analysis meets."""
    elsewhere = canonical.isNotNull() & (canonical != normalized) & ~F.coalesce(canonical == final, F.lit(False))
    return (
        F.when(blocked, "blocked_robots")
        .when(elsewhere, "canonical_elsewhere")
        .when(noindex, "noindex")
        .when(failed | status.between(400, 599), "http_error")
        .when(status.between(300, 399), "redirect")
    )


def self_canonical(crawled: DataFrame) -> DataFrame:
    """crawled with is_self_canonical: no canonical, or the URL itself; the final URL doesn't count."""
    return crawled.withColumn("is_self_canonical", F.coalesce(F.col("canonical_url") == F.col("normalized_url"), F.lit(True)))


def crawled_urls(fetches: DataFrame, seeds: list[str] | None = None, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """One analysed row per observation, with its raw links in `page_links`.

    fetches may have is_blocked_by_robots; without seeds every URL is internal.
    """
    df = fetches if "is_blocked_by_robots" in fetches.columns else fetches.withColumn("is_blocked_by_robots", F.lit(False))
    df = df.withColumn("headers", S.response_headers(F.col("headers")))
    df = df.withColumn("page", html.page_facts(S.kept_body(F.col("body"), F.col("content_type"), config), config.bare_references))
    base = F.coalesce("final_url", "url")
    df = df.withColumn("canonical_url", F.when(F.col("page.canonical").isNotNull(), urls.resolve(F.col("page.canonical"), base)))
    df = df.withColumn("robots_directives", directives(F.col("page.robots"), F.col("headers").getItem("x-robots-tag")))
    failed = F.col("fetch_error").isNotNull()
    status = F.when(~failed, F.col("status_code"))
    final = F.when(F.col("final_url") != F.col("url"), F.col("final_url"))
    internal = F.lit(True) if seeds is None else urls.is_internal(F.col("normalized_url"), F.array(*map(F.lit, seeds)), config)
    reason = indexability_reason(status, failed, F.col("canonical_url"), F.col("robots_directives.noindex"), F.col("normalized_url"), F.col("final_url"), F.col("is_blocked_by_robots"))
    page = F.col("page")
    return df.select(
        F.sha2(F.concat_ws("|", "session_id", "normalized_url"), 256).alias("id"),
        "session_id", "url", "normalized_url", "discovered_at", "fetched_at", "crawl_depth", "source",
        internal.alias("is_internal"), status.alias("status_code"), "response_time_ms", "content_size_bytes", "content_type",
        final.alias("final_url"), "redirect_chain", "fetch_error",
        page["title"].alias("title"), F.length(page["title"]).alias("title_length"),
        page["meta_description"].alias("meta_description"), F.length(page["meta_description"]).alias("meta_description_length"),
        page["h1"].alias("h1"), F.coalesce(page["h1_count"], F.lit(0)).alias("h1_count"), F.coalesce(page["h2_count"], F.lit(0)).alias("h2_count"),
        "canonical_url", page["og_title"].alias("og_title"), page["og_description"].alias("og_description"),
        F.coalesce(page["image_count"], F.lit(0)).alias("image_count"), F.coalesce(page["bare_image_links"], F.lit(0)).alias("bare_image_links"), "robots_directives",
        F.transform(page["hreflang"], lambda h: F.struct(h["lang"].alias("lang"), urls.resolve(h["url"], base).alias("url"), h["region"].alias("region"))).alias("hreflang"),
        page["structured_data_types"].alias("structured_data_types"),
        text.word_count(page["body_text"]).alias("word_count"), text.content_hash(page["body_text"]).alias("content_hash"),
        reason.isNull().alias("is_indexable"), reason.alias("indexability_reason"), "is_blocked_by_robots",
        page["links"].alias("page_links"),
    )


