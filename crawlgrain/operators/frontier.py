"""The crawl frontier as a level-by-level search over the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.config import CrawlConfig
from crawlgrain.cuts import durable
from crawlgrain.functions import urls


def priority(depth: Column, discovered_at: Column) -> Column:
    """Smaller is sooner: depth first, then time, however long a crawl lasts."""
    return F.struct(depth.alias("depth"), discovered_at.alias("discovered_at"))


def enqueue(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """New URLs: the soonest row of each normalized_url that isn't seen."""
    one = candidates.groupBy("normalized_url").agg(F.min_by(F.struct("url", "crawl_depth", "discovered_at"), F.struct(priority(F.col("crawl_depth"), F.col("discovered_at")), "url")).alias("x"))
    return one.select("normalized_url", "x.*").join(seen, "normalized_url", "left_anti")


def starting(seeds: DataFrame, sitemap_entries: DataFrame | None = None, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """(normalized_url, url, source) at depth 0: seeds (url), then what sitemaps list (loc), if the settings import them."""
    rows = seeds.select("url", F.lit("seed").alias("source"), F.lit(0).alias("rank"))
    if sitemap_entries is not None and config.import_sitemap_at_start:
        rows = rows.unionByName(sitemap_entries.select(F.col("loc").alias("url"), F.lit("sitemap").alias("source"), F.lit(1).alias("rank")))
    rows = rows.withColumn("normalized_url", urls.normalize(F.col("url"), config=config)).where("normalized_url is not null")
    return rows.groupBy("normalized_url").agg(F.min(F.struct("rank", "url", "source")).alias("x")).select("normalized_url", "x.url", "x.source")


def counts(pending: DataFrame, seen: DataFrame) -> DataFrame:
    """(seen, pending): how many URLs are known, and how many wait."""
    n = lambda df, name: df.agg(F.count_distinct("normalized_url").alias(name))
    return n(seen.select("normalized_url").unionByName(pending.select("normalized_url")), "seen").join(n(pending, "pending"))


def next_batch(pending: DataFrame, n: int) -> DataFrame:
    """The n soonest; equal ones by URL."""
    return pending.orderBy(priority(F.col("crawl_depth"), F.col("discovered_at")), "normalized_url").limit(n)


def spill(pending: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(kept, spilled): the soonest `keep` rows and the others, none lost."""
    kept = durable(next_batch(pending, keep))
    return kept, pending.join(kept.select("normalized_url"), "normalized_url", "left_anti")


def breadth_first(seeds: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(normalized_url, crawl_depth): every URL within max_depth of a seed, at its least depth.

    seeds(normalized_url), edges(source_url, target_url). A level is one join with the
    edges and one anti-join with what is seen; levels are checkpointed in the shared
    folder, so neither lineage nor lost executors grow with depth. max_depth < 0: no limit.
    """
    pairs = durable(edges.select("source_url", "target_url").where("source_url <> target_url").distinct())
    level = durable(seeds.select("normalized_url").distinct())
    seen, depth = level.withColumn("crawl_depth", F.lit(0)), 0
    while (max_depth < 0 or depth < max_depth) and not level.isEmpty():
        depth += 1
        found = level.join(pairs, level["normalized_url"] == pairs["source_url"]).select(F.col("target_url").alias("normalized_url")).distinct()
        level = durable(found.join(seen, "normalized_url", "left_anti"))
        seen = durable(seen.unionByName(level.withColumn("crawl_depth", F.lit(depth))))
    return seen


def checkpoint_state(pending: DataFrame, seen: DataFrame, path: str) -> None:
    """Saves the frontier: pending with normalized and raw form, seen URLs."""
    pending.write.mode("overwrite").parquet(f"{path}/pending")
    seen.write.mode("overwrite").parquet(f"{path}/seen")


def restore_state(spark, path: str, crawled: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(pending, seen) as saved, without what has been crawled since."""
    pending, seen = spark.read.parquet(f"{path}/pending"), spark.read.parquet(f"{path}/seen")
    if crawled is not None:
        pending = pending.join(crawled.select("normalized_url"), "normalized_url", "left_anti")
    return pending, seen
