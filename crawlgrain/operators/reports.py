"""Filters, counts, orders and pages over analysed URLs and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.functions import text
from crawlgrain.operators.rules import SEVERITIES, severity_rank


def by_status(crawled: DataFrame, kind: str = "all") -> DataFrame:
    """kind: all, 2xx, 3xx, 4xx or 5xx; a null status is in all only."""
    return crawled if kind == "all" else crawled.where(F.col("status_code").between(int(kind[0]) * 100, int(kind[0]) * 100 + 99))


def status_label(status: Column) -> Column:
    """The class of a status: 2xx to 5xx, null for others."""
    return F.when(status.between(200, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx")))


def severity_label(severity: Column) -> Column:
    """A severity as people read it; null if it is unknown."""
    return F.when(severity.isin(*SEVERITIES), F.initcap(severity))


def by_indexable(crawled: DataFrame, wanted: bool | None = None) -> DataFrame:
    return crawled if wanted is None else crawled.where(F.col("is_indexable") == wanted)


def lookup(table: DataFrame, **equal: str) -> DataFrame:
    """The row, at most, whose columns have these values."""
    for column, value in equal.items():
        table = table.where(F.col(column) == value)
    return table.limit(1)


def search_urls(crawled: DataFrame, needle: str) -> DataFrame:
    return crawled.where(text.contains_fold(F.col("normalized_url"), needle) | text.contains_fold(F.col("title"), needle)) if needle else crawled


def filter_issues(issues: DataFrame, severity: str | None = None, category: str | None = None, needle: str = "", url: str | None = None) -> DataFrame:
    """Conditions that are given hold together; unknown severities are left out."""
    out = issues.where(F.col("severity").isin(*SEVERITIES))
    for column, value in (("severity", severity), ("category", category), ("url", url)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.where(text.contains_fold(F.col("title"), needle) | text.contains_fold(F.col("url"), needle)) if needle else out


def listed_urls(crawled: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Shallow and early first, then by URL, so pages never overlap."""
    out = crawled.orderBy("crawl_depth", "discovered_at", "normalized_url").offset(offset)
    return out if limit is None else out.limit(limit)


def sorted_urls(crawled: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """By a column, null text as the empty text."""
    c = F.coalesce(F.col(column), F.lit("")) if dict(crawled.dtypes)[column] == "string" else F.col(column)
    return crawled.orderBy(c.asc() if ascending else c.desc(), "normalized_url")


def listed_issues(issues: DataFrame) -> DataFrame:
    """In the stored list's order: severity as text, category, URL."""
    return issues.orderBy("severity", "category", "url", "issue_key")


def ranked_issues(issues: DataFrame) -> DataFrame:
    """The gravest first."""
    return issues.orderBy(severity_rank(F.col("severity")), "category", "url", "issue_key")


def issue_counts(issues: DataFrame) -> DataFrame:
    """(dimension, value, n): by category and by severity, in one pass."""
    g = issues.groupingSets([["category"], ["severity"]], "category", "severity").agg(F.count("*").alias("n"))
    return g.select(F.when(F.col("category").isNotNull(), "category").otherwise("severity").alias("dimension"), F.coalesce("category", "severity").alias("value"), "n")


def session_stats(crawled: DataFrame) -> DataFrame:
    """Counters of each session: totals, status classes, failures, rate per second."""
    status = F.col("status_code")
    seconds = (F.unix_micros(F.max("fetched_at")) - F.unix_micros(F.min("fetched_at"))) / 1e6
    return crawled.groupBy("session_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(status.between(k * 100, k * 100 + 99)).alias(f"n_{k}xx") for k in (2, 3, 4, 5)],
        F.count_if(F.col("fetch_error").isNotNull()).alias("n_failed"),
        F.count_if(F.col("is_blocked_by_robots")).alias("n_blocked"),
        F.count_if(F.col("is_indexable")).alias("n_indexable"),
        F.try_divide(F.count("*").cast("double"), seconds).alias("urls_per_second"),
    )


def distribution(crawled: DataFrame, column: str) -> DataFrame:
    """(value, n) of depth, status, indexability reason or any other column."""
    return crawled.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def recent(events: DataFrame, n: int = 5000) -> DataFrame:
    """The newest n events: a bounded sort per task, then one merge."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)
