"""The link graph: edges of anchors, degrees, and what the graph lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.config import CrawlConfig
from crawlgrain.functions import urls


def rel_flags(rel: Column) -> Column:
    tokens = F.split(F.lower(F.coalesce(rel, F.lit(""))), r"[\s,]+")
    return F.struct(*[F.array_contains(tokens, n).alias(n) for n in ("nofollow", "ugc", "sponsored", "noopener", "noreferrer")])


def anchors(crawled: DataFrame, seeds: list[str] | None = None, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Every usable anchor, repeats included, with its place `pos` in the page.

    Targets are resolved against the final URL and normalised; others are dropped. All
    is done inside the array of a page's links, where each step is computed once, and
    the rows are filtered after the explode, beyond which no condition is pushed.
    """
    base = F.coalesce("final_url", "url")
    source = F.col("normalized_url")

    def one(link: Column, pos: Column, base_parts: Column) -> Column:
        def fields(target: Column) -> Column:
            internal = urls.in_scope(target, source, config) if seeds is None else urls.is_internal(target, F.array(*map(F.lit, seeds)), config)
            return F.struct(target.alias("target_url"), link["anchor"].alias("anchor_text"), rel_flags(link["rel"]).alias("rel"), link["tag"].alias("tag_name"), internal.alias("is_internal"), pos.alias("pos"))

        return urls.bound(urls.normalize_from(link["url"], base_parts, config), fields)

    found = urls.bound(urls.cut(base), lambda b: F.transform(F.filter("page_links", lambda x: x["tag"] == "a"), lambda link, pos: one(link, pos, b)))
    rows = crawled.select("session_id", source.alias("source_url"), F.explode_outer(found).alias("x"))
    return rows.where("x.target_url is not null").select("session_id", "source_url", "x.*")


def edges(all_anchors: DataFrame) -> DataFrame:
    """One edge per (session, source, target, tag): the first in the page holds.

    min_by combines on the map side, so a page with many repeats shuffles each edge once.
    """
    first = F.min_by(F.struct("anchor_text", "rel", "is_internal"), "pos")
    return all_anchors.groupBy("session_id", "source_url", "target_url", "tag_name").agg(first.alias("x")).select("session_id", "source_url", "target_url", "x.anchor_text", "x.rel", "tag_name", "x.is_internal")


def outlink_counts(all_anchors: DataFrame) -> DataFrame:
    """(session, url, internal, external): repeats count."""
    return all_anchors.groupBy("session_id", F.col("source_url").alias("normalized_url")).agg(F.count_if("is_internal").cast("int").alias("internal_outlink_count"), F.count_if(~F.col("is_internal")).cast("int").alias("external_outlink_count"))


def inlink_counts(edges_: DataFrame) -> DataFrame:
    """(session, url, inlinks): distinct internal edges to each target."""
    return edges_.where("is_internal").groupBy("session_id", F.col("target_url").alias("normalized_url")).agg(F.count("*").cast("int").alias("internal_inlink_count"))


def with_link_counts(crawled: DataFrame, all_anchors: DataFrame, edges_: DataFrame) -> DataFrame:
    """crawled with its three link counts; the sides are aggregated before the join."""
    keys = ["session_id", "normalized_url"]
    out = crawled.join(outlink_counts(all_anchors), keys, "left").join(inlink_counts(edges_), keys, "left")
    return out.fillna(0, ["internal_outlink_count", "external_outlink_count", "internal_inlink_count"])


def outlinks_of(edges_: DataFrame, session_id: str, source_url: str) -> DataFrame:
    return edges_.where((F.col("session_id") == session_id) & (F.col("source_url") == source_url))


def orphans(crawled: DataFrame, edges_: DataFrame) -> DataFrame:
    """Crawled pages that no internal edge from another page points at."""
    targets = edges_.where("is_internal and source_url <> target_url").select("session_id", F.col("target_url").alias("normalized_url"))
    return crawled.join(targets, ["session_id", "normalized_url"], "left_anti").select("session_id", "normalized_url")


def sitemap_discrepancy(crawled: DataFrame, entries: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """(url, status): URLs that only the crawl or only the sitemap knows."""
    a = crawled.select(F.col("normalized_url").alias("url")).distinct().withColumn("crawled", F.lit(True))
    b = entries.select(urls.normalize(F.col("loc"), config=config).alias("url")).where("url is not null").distinct().withColumn("listed", F.lit(True))
    both = a.join(b, "url", "full_outer")
    return both.where("crawled is null or listed is null").select("url", F.when(F.col("crawled").isNull(), "only_in_sitemap").otherwise("only_in_crawl").alias("status"))


def session_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, issue_key, change): new, fixed or persisting issues between two sessions."""
    a = before.select("url", "issue_key").distinct().withColumn("was", F.lit(True))
    b = after.select("url", "issue_key").distinct().withColumn("is", F.lit(True))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "fixed").otherwise("persisting")
    return a.join(b, ["url", "issue_key"], "full_outer").select("url", "issue_key", change.alias("change"))
