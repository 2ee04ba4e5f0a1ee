"""A whole site audit: observations in, analysed URLs, edges, issues and statistics out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from crawlgrain.config import CrawlConfig
from crawlgrain.cuts import durable
from crawlgrain.operators import crawl, links, reports, rules


@dataclass(frozen=True)
class Audit:
    urls: DataFrame
    links: DataFrame
    issues: DataFrame
    stats: DataFrame


def audit(fetches: DataFrame, seeds: list[str] | None = None, robots: DataFrame | None = None, config: CrawlConfig = CrawlConfig(), keep: str | None = None) -> Audit:
    """Audits fetch observations.

    Pages are parsed once, however many of the results are used: the analysed rows are
    written to `keep`, a folder that all executors share, or else checkpointed.
    """
    rows = crawl.within_depth(fetches, config)
    if seeds is not None:
        rows = crawl.within_scope(rows, seeds, config)
    rows = crawl.limited(rows, config)
    if robots is not None:
        rows = crawl.with_robots(rows, robots, config)
    crawled = crawl.crawled_urls(rows, seeds, config)
    if keep:
        crawled.write.mode("overwrite").parquet(keep)
        crawled = fetches.sparkSession.read.parquet(keep)
    else:
        crawled = durable(crawled)
    anchors = links.anchors(crawled, seeds, config)
    edges = links.edges(anchors)
    counted = links.with_link_counts(crawled, anchors, edges).drop("page_links")
    return Audit(counted, edges, rules.all_issues(counted), reports.session_stats(counted))
