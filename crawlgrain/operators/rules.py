"""The rule engine: a catalogue of issue definitions and what makes each one hold."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.cuts import durable
from crawlgrain.functions import text, urls


@dataclass(frozen=True)
class Definition:
    key: str
    severity: str
    category: str
    title: str
    description: str
    remediation: str


# The catalogue, whose texts stand in every report.
DEFINITIONS = tuple(
    Definition(*row)
    for row in (
        ("http_4xx", "error", "HTTP", "4xx Client Error", "This URL returned a 4xx status code, meaning it could not be found or access was denied.", "Fix or remove internal links to this URL. If the page was moved, add a permanent redirect."),
        ("http_5xx", "error", "HTTP", "5xx Server Error", "The server returned a 5xx error for this URL. The page is inaccessible to crawlers and users.", "Investigate server logs. Ensure the application handles errors gracefully and the URL resolves correctly."),
        ("redirect_chain", "warning", "Redirects", "Redirect Chain", "This URL passes through more than one redirect before reaching its destination. Redirect chains waste crawl budget and dilute link equity.", "Update internal links to point directly to the final destination URL and reduce intermediate redirects."),
        ("redirect_loop", "error", "Redirects", "Redirect Loop", "This URL is involved in a redirect loop — it eventually redirects back to itself or creates a cycle.", "Trace the redirect chain and fix the server-side redirect rules to eliminate the cycle."),
        ("missing_title", "error", "Titles", "Missing Title Tag", "This page has no <title> tag. Title tags are a primary on-page SEO signal and are displayed in SERPs.", "Add a descriptive, unique <title> tag to the page's <head> section."),
        ("title_too_short", "warning", "Titles", "Title Tag Too Short", "The title tag has fewer than 10 characters. Short titles may not adequately describe the page's content or keyword intent.", "Expand the title to be more descriptive of the page's primary topic."),
        ("title_too_long", "opportunity", "Titles", "Title Tag Too Long", "The title tag exceeds 65 characters. Long titles are typically truncated in search results.", "Trim the title to its most important keywords, keeping it under 65 characters."),
        ("missing_meta_description", "warning", "Meta Description", "Missing Meta Description", "This page has no meta description tag. While not a direct ranking factor, meta descriptions influence click-through rates in search results.", "Add a concise, compelling <meta name=\"description\"> tag (120–158 characters) summarising the page's content."),
        ("meta_description_too_long", "opportunity", "Meta Description", "Meta Description Too Long", "The meta description exceeds 160 characters and will likely be truncated in search results.", "Shorten the meta description to under 160 characters while retaining its key message."),
        ("missing_h1", "warning", "Headings", "Missing H1 Tag", "This page has no H1 heading. The H1 communicates the page's primary topic to both users and search engines.", "Add one descriptive H1 tag that reflects the page's main keyword focus."),
        ("multiple_h1", "opportunity", "Headings", "Multiple H1 Tags", "This page has more than one H1 tag. While not a hard rule, a single H1 provides a cleaner topical signal.", "Consolidate content under a single H1. Demote additional H1s to H2 or H3 as appropriate."),
        ("canonical_to_non_indexable", "warning", "Canonicals", "Canonical Points to Non-Indexable URL", "This page's canonical tag points to a URL that is itself non-indexable (e.g. a redirect, error, or noindex page).", "Ensure canonical tags point to the definitive, indexable version of the content."),
        ("broken_canonical", "warning", "Canonicals", "Broken Canonical URL", "This page's canonical tag contains a malformed or unresolvable URL.", "Fix the canonical tag to point to a valid, absolute URL."),
        ("noindex_in_sitemap", "warning", "Indexability", "Noindex Page in Sitemap", "This URL appears in the XML sitemap but contains a noindex directive. Sitemaps should only list pages you want indexed.", "Remove noindex pages from your sitemap, or remove the noindex directive if the page should be indexed."),
        ("blocked_robots_but_linked", "info", "Indexability", "Blocked by Robots.txt but Internally Linked", "This URL is blocked by robots.txt but is still linked from internal pages. Search engines can discover the URL via the internal links even though they cannot crawl it.", "If intentional, ensure the page is also protected by noindex (since robots.txt only prevents crawling, not indexing via discovered links). If unintentional, remove internal links or update robots.txt."),
        ("thin_content", "opportunity", "Content", "Thin Content", "This page contains fewer than 100 words of body text. Thin content pages may provide limited value to users and may receive less visibility in search results.", "Expand the page with original, useful content relevant to the page's topic."),
        ("excessive_crawl_depth", "opportunity", "Links", "Excessively Deep Page", "This page is more than 7 clicks from the crawl seed. Deep pages receive less crawl budget and less link equity.", "Improve internal linking architecture to surface important content from shallower pages."),
        ("insecure_canonical", "warning", "Security", "Canonical Points to HTTP Instead of HTTPS", "This HTTPS page has a canonical tag pointing to the HTTP version. This signals the HTTP version as canonical, undermining your HTTPS migration.", "Update the canonical tag to use the https:// URL."),
        ("missing_alt_anchor_image", "warning", "Images", "Image Link Missing Alt Text", "An <img> element within an <a> tag has no alt attribute. The alt text serves as the anchor text for image links and is important for accessibility and SEO.", "Add descriptive alt text to all images, especially those used as links."),
        ("duplicate_title", "warning", "Titles", "Duplicate Title Tag", "Multiple pages share the same title tag. Duplicate titles make it harder for search engines to differentiate pages.", "Ensure each page has a unique, descriptive title that reflects its specific content."),
        ("duplicate_meta_description", "warning", "Meta Description", "Duplicate Meta Description", "Multiple pages share the same meta description. Duplicate descriptions reduce the uniqueness of your SERP snippets.", "Write a unique meta description for each page that accurately reflects its content."),
        ("duplicate_content_exact", "warning", "Content", "Exact Duplicate Content", "This page's body text is identical to at least one other crawled page. Exact duplicates waste crawl budget and dilute ranking signals.", "Consolidate duplicate pages with a canonical tag or 301 redirect to the preferred version."),
    )
)
BY_KEY = {d.key: d for d in DEFINITIONS}
# Severities from the gravest down.
SEVERITIES = ("error", "warning", "opportunity", "info")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for k, s in enumerate(SEVERITIES):
        rank = F.when(severity == s, k).otherwise(rank)
    return rank.cast("int")


def is_html(content_type: Column, fetched_at: Column) -> Column:
    """By content type, where there is one; else whatever was fetched."""
    return F.when(content_type.isNull(), fetched_at.isNotNull()).otherwise(F.lower(content_type).contains("html"))


def _row_rules() -> dict[str, tuple[Column, dict[str, Column]]]:
    """Key -> (predicate, data), over a row of crawled URLs with link counts."""
    c, chain = F.col, F.col("redirect_chain")
    page = is_html(c("content_type"), c("fetched_at"))
    ih = page & c("is_indexable") & c("fetch_error").isNull() & c("status_code").isNotNull()
    hops = F.coalesce(F.size(chain), F.lit(0))
    froms = F.transform(chain, lambda h: h["from_url"])
    arrows = F.array_join(F.transform(chain, lambda h: F.concat(h["from_url"], F.lit(" → ["), h["status_code"].cast("string"), F.lit("] → "), h["to_url"])), "\n")
    canonical = c("canonical_url")
    same_host = urls.host(canonical) == urls.host(c("normalized_url"))
    title = {"length": c("title_length"), "title": F.coalesce("title", F.lit(""))}
    return {
        "http_4xx": (c("status_code").between(400, 499) & c("is_internal"), {"statusCode": c("status_code")}),
        "http_5xx": (c("status_code").between(500, 599) & c("is_internal"), {"statusCode": c("status_code")}),
        "redirect_chain": (hops >= 2, {"chainLength": hops, "chain": arrows}),
        "redirect_loop": ((c("fetch_error")["kind"] == "too_many_redirects") & (F.size(F.array_distinct(froms)) < F.size(froms)), {"chainLength": hops}),
        "missing_title": (ih & c("title").isNull(), {}),
        "title_too_short": (ih & c("title_length").between(1, 9), title),
        "title_too_long": (ih & (c("title_length") > 65), title),
        "missing_meta_description": (ih & c("meta_description").isNull(), {}),
        "meta_description_too_long": (ih & (c("meta_description_length") > 160), {"length": c("meta_description_length"), "description": F.substring("meta_description", 1, 200)}),
        "missing_h1": (ih & (c("h1_count") == 0), {}),
        "multiple_h1": (ih & (c("h1_count") > 1), {"h1Count": c("h1_count")}),
        "canonical_to_non_indexable": (page & (canonical != c("normalized_url")) & same_host & F.exists(chain, lambda h: h["from_url"] == canonical), {"canonical": canonical}),
        "broken_canonical": (page & ~urls.well_formed(canonical), {"canonical": canonical}),
        "noindex_in_sitemap": ((c("source") == "sitemap") & c("robots_directives")["noindex"], {}),
        "blocked_robots_but_linked": (c("is_blocked_by_robots") & (c("internal_inlink_count") > 0), {"inlinks": c("internal_inlink_count")}),
        "thin_content": (ih & c("word_count").between(1, 99), {"wordCount": c("word_count")}),
        "excessive_crawl_depth": (ih & (c("crawl_depth") > 7), {"depth": c("crawl_depth")}),
        "missing_alt_anchor_image": (page & (c("bare_image_links") > 0), {"images": c("bare_image_links")}),
        "insecure_canonical": (page & c("normalized_url").startswith("https://") & canonical.startswith("http://"), {"canonical": canonical}),
    }


#: Rules beyond the audit's own, held only where they are asked for by key.
EXTENSIONS = ("missing_alt_anchor_image",)
_COLUMNS = ("session_id", "url", "issue_key", "severity", "category", "title", "description", "remediation", "data")


def _hit(key: str, data: dict[str, Column]) -> Column:
    pairs = [x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]
    told = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(key).alias("issue_key"), told.alias("data"))


def _told(hits: DataFrame) -> DataFrame:
    """(session_id, url, issue_key, data) with the catalogue's texts."""
    names = ("severity", "category", "title", "description", "remediation")
    entries = [x for d in DEFINITIONS for x in (F.lit(d.key), F.struct(*[F.lit(getattr(d, n)).alias(n) for n in names]))]
    return hits.withColumn("d", F.element_at(F.create_map(*entries), F.col("issue_key"))).select("session_id", "url", "issue_key", *[f"d.{n}" for n in names], "data")


def _row_hits(keys: tuple[str, ...] | None) -> Column:
    """The issues that a row shows by itself, as one array."""
    found = [F.when(F.coalesce(p, F.lit(False)), _hit(k, data)) for k, (p, data) in _row_rules().items() if (k in keys if keys is not None else k not in EXTENSIONS)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def row_issues(crawled: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Issues that a row shows by itself: one scan, one array of structs, one explode."""
    return _told(crawled.select("session_id", F.col("normalized_url").alias("url"), F.explode(_row_hits(keys)).alias("i")).select("session_id", "url", "i.*"))


_SHARED = {"duplicate_title": ("title", lambda c: text.folded(c), "title"), "duplicate_meta_description": ("meta_description", lambda c: text.folded(c), "description"), "duplicate_content_exact": ("content_hash", lambda c: c, "contentHash")}


def _shared_values(keys: tuple[str, ...]) -> Column:
    """What an indexable row may share with others, as one array."""
    one = lambda key, column, fold, name: F.when(F.col("is_indexable") & F.col(column).isNotNull(), F.struct(F.lit(key).alias("issue_key"), F.sha2(fold(F.col(column)), 256).alias("k"), F.create_map(F.lit(name), F.col(column)).alias("data")))
    return F.filter(F.array(*[one(k, *_SHARED[k]) for k in keys]), lambda x: x.isNotNull())


def _repeated(entries: DataFrame) -> DataFrame:
    """Entries (session_id, url, issue_key, k, data) whose k others of their key have too.

    Values are counted by a pre-aggregated group-by and joined back, rather than by a
    window: a value in a third of all rows then costs a counter per task, and the
    skewed side of the join can be split.
    """
    keys = ["session_id", "issue_key", "k"]
    many = entries.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return entries.join(many, keys, "left_semi").select("session_id", "url", "issue_key", "data")


def duplicate_issues(crawled: DataFrame, *keys: str) -> DataFrame:
    """Indexable rows that share a folded title, description or content with another; the rows are computed once."""
    values = _shared_values(keys or tuple(_SHARED))
    rows = durable(crawled.select("session_id", F.col("normalized_url").alias("url"), F.explode(values).alias("s")).select("session_id", "url", "s.*"))
    return _told(_repeated(rows))


def duplicate_groups(crawled: DataFrame) -> DataFrame:
    """(content_hash, url) of exact copies, in the order of a report."""
    return duplicate_issues(crawled, "duplicate_content_exact").select(F.col("data")["contentHash"].alias("content_hash"), "url").orderBy("content_hash", "url")


def all_issues(crawled: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Row rules and whole-table rules; one issue per (session, url, key).

    The rows are computed once: what they show and what they may share is cut off as a
    narrow table in the shared folder.
    """
    shared = tuple(k for k in _SHARED if keys is None or k in keys)
    arrays = {}
    if keys is None or len(shared) < len(keys):
        arrays["hits"] = _row_hits(keys)
    if shared:
        arrays["shared"] = _shared_values(shared)
    rows = durable(crawled.select("session_id", F.col("normalized_url").alias("url"), *[c.alias(n) for n, c in arrays.items()]))
    each = lambda name: rows.select("session_id", "url", F.explode(name).alias("i")).select("session_id", "url", "i.*")
    found = [each("hits")] if "hits" in arrays else []
    found += [_repeated(each("shared"))] if shared else []
    return _told(reduce(DataFrame.unionByName, found)).select(*_COLUMNS)
