"""What sites say of themselves: robots.txt and sitemaps; and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgrain.functions import robots as R
from crawlgrain.functions import sitemaps as M
from crawlgrain.functions import urls


def seeds(text: DataFrame, column: str = "text") -> DataFrame:
    """One seed per non-empty line."""
    return text.select(F.explode(F.split(column, r"\R")).alias("line")).select(urls.trimmed(F.col("line")).alias("url")).where("url != ''")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of robots or sitemap files under a folder; those ending in .gz are unpacked. url is the file's."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("body"))


def robots_table(raw: DataFrame, order: str | None = None) -> DataFrame:
    """(host, robots, crawl_delay, sitemaps) from (host, http_status, body): one row per host.

    Of several files of a host the last by the column `order` holds; without one, or
    among equal ones, that of the largest status and body, so that the result is stable.
    """
    file = F.struct("http_status", "body")
    one = raw.groupBy(F.lower("host").alias("host")).agg(F.max_by(file, F.struct(*([order] if order else []), "http_status", "body")).alias("r"))
    parsed = one.select("host", R.for_status(F.col("r.http_status"), F.col("r.body")).alias("robots"))
    return parsed.select("host", "robots", F.col("robots.crawl_delay").alias("crawl_delay"), F.col("robots.sitemaps").alias("sitemaps"))


def robots_sitemaps(table: DataFrame) -> DataFrame:
    """(host, url) of every Sitemap line."""
    return table.select("host", F.explode("sitemaps").alias("url"))


def cached_robots(urls_: DataFrame, table: DataFrame) -> DataFrame:
    """Adds robots of each URL's host and whether the host is known at all."""
    return urls_.withColumn("host", urls.host(F.col("url"))).join(table.withColumn("robots_known", F.lit(True)), "host", "left").withColumn("robots_known", F.coalesce("robots_known", F.lit(False)))


def sitemap_entries(raw: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(sitemap, loc, lastmod, changefreq, priority) from (url, body).

    Of an index, the children that are in the table are read, one level deep. roots
    (url) names where to start; without it every table row is a start.
    """
    parsed = raw.select("url", M.parse(F.col("body")).alias("p"))
    top = parsed if roots is None else parsed.join(roots.select("url").distinct(), "url", "left_semi")
    children = top.select(F.explode("p.children").alias("url")).distinct()
    below = parsed.join(children, "url", "left_semi")
    both = top.unionByName(below) if roots is not None else top
    entry = both.select(F.col("url").alias("sitemap"), F.explode("p.urls").alias("u"))
    return entry.select("sitemap", F.col("u.loc").alias("loc"), M.lastmod(F.col("u.lastmod")).alias("lastmod"), F.col("u.changefreq").alias("changefreq"), M.priority(F.col("u.priority")).alias("priority"))
